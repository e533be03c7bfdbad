"""Duplicates hidden by formatting differences.

Every text streams through a lookup table that folds letter case and skips blanks and
punctuation; what remains runs into rolling polynomial hashes, all in numpy over whole
Arrow batches, so no canonical string is built. Candidates share the hash of the whole
reference and a sum over the description's characters, which neither blanks nor the order
of fields change. Rows that collide are then verified: their fields are paired by hash and
compared with two pointers that skip what the table skips; rows that fail stand apart.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..session import spread

LETTER, DIGIT, POINT, BLANK = 1, 2, 3, 4


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the folded character (0: skipped) and its class; made from the character database."""
    fold, kind = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        if c.isalnum() or unicodedata.category(c)[0] == "M" or (cp > 127 and unicodedata.category(c)[0] == "S"):
            f = unicodedata.normalize("NFKC", c).casefold()
            fold[cp] = ord(f) if len(f) == 1 else cp
            kind[cp] = DIGIT if c.isdigit() else LETTER
        elif c.isspace():
            kind[cp] = BLANK
    fold[0x2E], kind[0x2E] = 0x2E, POINT
    return fold, kind


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64))
        down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    return up, down


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Streams:
    """What the table leaves of a batch of texts: ``chars`` (folded, in order), the ``row`` of each and, for fields, its ``field``.

    ``points``: a point between digits stays. Positions of skipped characters are never copied anywhere.
    """

    def __init__(self, texts: list[str | None], points: bool):
        fold, kind = _tables()
        self.rows = len(texts)
        joined = "\n".join(t or "" for t in texts)
        cps = np.frombuffer(joined.encode("utf-32-" + ("le" if sys.byteorder == "little" else "be"), "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        k = kind[cps]
        digit = k == DIGIT
        live = (k == LETTER) | digit
        if points and len(cps) > 2:
            inside = np.zeros(len(cps), bool)
            inside[1:-1] = digit[:-2] & digit[2:]
            live |= (k == POINT) & inside
        at = np.flatnonzero(live)
        self.chars = fold[cps[at]].astype(np.uint64)
        self.row = np.repeat(np.arange(len(texts)), lengths)[: len(cps)][at]
        self.count = np.bincount(self.row, minlength=self.rows)
        self.start = np.cumsum(self.count) - self.count
        self._cps, self._kind, self._at = cps, k, at

    def hashes(self, first: np.ndarray) -> np.ndarray:
        """Polynomial hashes of the runs of characters that begin at ``first`` (and end before the next one's)."""
        n = len(self.chars)
        up, down = _powers(1 << max(16, int(n).bit_length()))
        with np.errstate(over="ignore"):
            rolling = np.cumsum(_mix(self.chars + np.uint64(0x1234567)) * up[:n])
            stop = np.r_[first[1:], n] - 1
            run = (rolling[stop] - np.where(first > 0, rolling[first - 1], np.uint64(0))) * down[first]
            return _mix(run + (stop - first + 1).astype(np.uint64))

    def fields(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, number of characters, row) of every field that holds a character.

        Fields end at a comma, semicolon, bar, line break, or a dash, slash or bullet between blanks.
        """
        cps, k = self._cps, self._kind
        mark = np.isin(cps, _MARKS)
        dash = np.isin(cps, _DASHES)
        if len(cps) > 2 and dash.any():
            blank = k == BLANK
            dash[1:-1] &= blank[:-2] & blank[2:]
            dash[0] = dash[-1] = False
            mark |= dash
        field = np.cumsum(mark)[self._at]
        first = np.flatnonzero(np.r_[True, (field[1:] != field[:-1]) | (self.row[1:] != self.row[:-1])]) if len(field) else np.zeros(0, np.int64)
        return first, np.diff(np.r_[first, len(field)]), self.row[first]


_MARKS = np.array([ord(c) for c in ",;|\n"], np.uint32)
_DASHES = np.array([ord(c) for c in "-–/•"], np.uint32)


def text_hashes(texts: list[str | None], ordered: bool) -> np.ndarray:
    """One 64-bit hash a text (null as empty).

    ``ordered``: of the whole stream of a code, in which a point is punctuation. Else a sum over the
    characters, which neither blanks nor the order of fields change (fields are compared afterwards).
    """
    s = Streams(texts, not ordered)
    out = np.zeros(s.rows, np.uint64)
    filled = np.flatnonzero(s.count)
    if len(filled):
        first = s.start[filled]
        with np.errstate(over="ignore"):
            out[filled] = s.hashes(first) if ordered else np.add.reduceat(_mix(s.chars + np.uint64(0x1234567)), first)
    return out


def _all_equal(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By row of ``counts`` characters: whether all are equal."""
    same = np.ones(len(counts), bool)
    filled = np.flatnonzero(counts)
    if len(filled):
        same[filled] = np.logical_and.reduceat(a == b, (np.cumsum(counts) - counts)[filled])
    return same


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first .. first + count - 1`` of every range, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def same_codes(a: list[str], b: list[str]) -> np.ndarray:
    """Pairwise: the same letters and digits in the same order; points are punctuation in codes."""
    return _same_order(Streams(a, False), Streams(b, False))


def _same_order(x: Streams, y: Streams) -> np.ndarray:
    """Two pointers over the kept characters of both sides, side by side for all pairs of a batch."""
    same = x.count == y.count
    at = np.flatnonzero(same)
    same[at] = _all_equal(x.chars[_ranges(x.start[at], x.count[at])], y.chars[_ranges(y.start[at], y.count[at])], x.count[at])
    return same


def same_fields(a: list[str], b: list[str]) -> np.ndarray:
    """Pairwise: whether the fields of one text, each whole and in any order, make up the other.

    Equal streams are the same; else fields are paired by hash, as often as each occurs, and compared
    character by character; where the sides mark their fields differently, ``_made_up_of`` looks.
    """
    x, y = Streams(a, True), Streams(b, True)
    same = _same_order(x, y)
    open_ = np.flatnonzero(~same & (x.count == y.count) & (x.count > 0))
    if not len(open_):
        return same
    wanted = np.zeros(x.rows, bool)
    wanted[open_] = True
    sides = []
    for s in (x, y):
        first, count, row = s.fields()
        h = s.hashes(first)
        order = np.lexsort((h, row))
        order = order[wanted[row[order]]]
        sides.append((first[order], count[order], row[order], h[order]))
    (fx, cx, rx, hx), (fy, cy, ry, hy) = sides
    nx, ny = np.bincount(rx, minlength=x.rows), np.bincount(ry, minlength=x.rows)
    even = wanted & (nx == ny)
    keep_x, keep_y = even[rx], even[ry]
    alike = np.zeros(x.rows, bool)
    rows = np.flatnonzero(even)
    alike[rows] = _all_equal(hx[keep_x], hy[keep_y], nx[rows]) & _all_equal(cx[keep_x], cy[keep_y], nx[rows])
    keep_x, keep_y = alike[rx], alike[ry]
    rows = np.flatnonzero(alike)
    same[rows] = _all_equal(x.chars[_ranges(fx[keep_x], cx[keep_x])], y.chars[_ranges(fy[keep_y], cy[keep_y])], x.count[rows])
    for i in np.flatnonzero(wanted & ~same):
        same[i] = _made_up_of(a[i], b[i])
    return same


_MARKED = re.compile(r"[,;|\n]|(?<=\s)[-–/•](?=\s)")
_GAP = re.compile(r"\s{2,}")


def _made_up_of(a: str, b: str) -> bool:
    """Whether one text's fields make up the other, which marks them otherwise or not at all. The text with more marks gives the fields; without marks, wide gaps do."""
    if len(_MARKED.findall(b)) > len(_MARKED.findall(a)):
        a, b = b, a
    return any(_laid_out(parts.split(s), t) for parts, s, t in ((_MARKED, a, b), (_GAP, a, b), (_GAP, b, a)))


def _laid_out(fields: list[str], text: str) -> bool:
    """Whether the fields, each as often as it occurs, follow one another in some order in ``text``.

    Where one field begins another, the longer is tried first all the way, then the shorter; there is no
    search over orders, so the time is the length of the text times the number of different fields.
    """
    streams = Streams([*fields, text], True)
    parts = [streams.chars[streams.start[i] : streams.start[i] + streams.count[i]].tolist() for i in range(len(fields) + 1)]
    body = parts.pop()
    counted = Counter(tuple(p) for p in parts if p)
    for longest in (True, False):
        left, at = dict(counted), 0
        by_length = sorted(left, key=len, reverse=longest)
        while at < len(body):
            hit = next((f for f in by_length if left[f] and f[0] == body[at] and list(f) == body[at : at + len(f)]), None)
            if hit is None:
                break
            left[hit] -= 1
            at += len(hit)
        if at == len(body) and not any(left.values()):
            return True
    return False


def hashed(rows: DataFrame, key: str, text: str, reference: str) -> DataFrame:
    """``_id``, ``_h`` (hash of the reference), ``_g`` (order-free hash of the text), ``_t``, ``_r`` of rows that have both."""
    usable = rows.select(F.col(key).alias("_id"), F.col(text).alias("_t"), F.col(reference).alias("_r")).where(F.col("_t").rlike(r"[^\s]") & F.col("_r").rlike(r"[^\s]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, r = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            g, h = text_hashes(t, False).view(np.int64), text_hashes(r, True).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h), pa.array(g), batch.column(1), batch.column(2)], ["_id", "_h", "_g", "_t", "_r"])

    return spread(usable).mapInArrow(run, usable.select("_id").schema.simpleString()[7:-1].replace(":", " ") + ", _h bigint, _g bigint, _t string, _r string")


def format_copies(rows: DataFrame, key: str, text: str, reference: str) -> DataFrame:
    """(``first_id``, ``copy_id``): each row that repeats another apart from formatting, with the smallest id of its copies.

    Rows with a null or blank text or reference are no copies. ``key`` must be unique. Rows whose
    hashes collide without being copies are compared again among themselves until all are settled.
    """
    every = durable(hashed(rows, key, text, reference))
    out = None
    while True:
        heads = every.groupBy("_h", "_g").agg(F.min_by(F.struct("_id", "_t", "_r"), "_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")

        @F.pandas_udf("boolean")
        def verified(t: pd.Series, r: pd.Series, t0: pd.Series, r0: pd.Series) -> pd.Series:
            return pd.Series(same_codes(list(r), list(r0)) & same_fields(list(t), list(t0)))

        pairs = every.join(heads, ["_h", "_g"]).where("_id <> _first._id")
        same = (F.col("_t") == F.col("_first._t")) & (F.col("_r") == F.col("_first._r"))
        # of what is settled only the two ids are written, of what isn't the row as it was
        tested = pairs.withColumn("_ok", F.when(same, True).otherwise(verified("_t", "_r", "_first._t", "_first._r")))
        tested = durable(tested.select("_id", "_h", "_g", *[F.when(~F.col("_ok"), F.col(c)).alias(c) for c in ("_t", "_r")], F.when(F.col("_ok"), F.col("_first._id")).alias("_to")))
        found = tested.where("_to is not null").select(F.col("_to").alias("first_id"), F.col("_id").alias("copy_id"))
        out = found if out is None else out.unionByName(found)
        every = tested.where("_to is null").select("_id", "_h", "_g", "_t", "_r")
        if every.isEmpty():
            return out


def collapsed(rows: DataFrame, key: str, text: str, reference: str) -> DataFrame:
    """Every row's record once: ``first_id`` and ``copies`` (1 where nothing repeats it, and for rows lacking text or reference)."""
    copies = format_copies(rows, key, text, reference)
    counts = copies.groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
    ids = rows.select(F.col(key).alias("first_id"))
    return ids.join(copies.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti").join(counts, "first_id", "left").select("first_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
