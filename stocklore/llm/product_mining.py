"""Dictionary of product listings, mined from trusted listings with nothing given but the listings themselves.

A brand-model phrase (hint, series code and grade-like codes) stands for a product. The
fields of words beside it are of three kinds: nouns of the item, values of variant
attributes (mounting, finish, ...), and marketing. What tells them apart:

* a noun stands nearly always beside one type hint;
* wordings of one noun or value replace each other: they meet in listings of one product
  far more often than by chance, and hardly ever within one listing;
* a value is stated by most listings of a product, marketing comes and goes;
* values that never stand in one listing are values of one attribute.

All counts are over all trusted listings; a product's fields are combined before they are
paired. The dictionary is bounded by the support share, so pair counts fit on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable

SUPPORT = 2e-4  # a phrase occurs in at least this share of the trusted listings, so there are at most fields / SUPPORT phrases
PURITY = 0.8  # share of a noun's listings that have its hint
REPLACED = {True: 0.08, False: 0.45}  # share of a wording's products in which the other wording occurs too: nouns of one hint, values
LIFT = 1.5  # how much more often than by chance two wordings must meet in products; values of one attribute never do
TOGETHER = 0.02  # share of a wording's listings that may hold the other one as well (or a tenth of chance)
CONSTANT = 0.68  # mean share of a product's listings that state a value, where one does
MEETING = 0.1  # how often values of one attribute may stand in one listing, against chance

FIELD = r"[,;|\n]|[ \t\n\x0b\f\r][-–/][ \t\n\x0b\f\r]"
WORDS = r"^[a-z][a-z/]*( [a-z/]+){0,3}$"
MODEL = r"\b(?:series|type|model|sr)\b[ \t\n\x0b\f\r.:#-]*(?P<model>[a-z][0-9]{3})\b"
COUNTED = re.compile(r"\bcores?\b")  # numbers in words are read as measures
CODE = re.compile(r"(?<![a-z0-9])([a-z]{2,3}[0-9][0-9a-z]{2,4})\b", re.ASCII)


def _listings(rows: DataFrame, text: str, hint: str) -> DataFrame:
    """Trusted listings: ``hint``, ``product`` (null without a series code) and the distinct ``phrases`` of words.

    Texts are split by batch and each distinct field of a batch is read once. Codes never span a mark between fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pc.replace_substring_regex(batch.column(1), r"[ \t]{2,}|\t", " ")
            fields = pc.split_pattern_regex(t, FIELD)
            row = pc.list_parent_indices(fields).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = fields.flatten().dictionary_encode()
            place, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            bare = pc.utf8_trim(distinct, "\r .:!()\"'•–*-")
            wordy = pc.and_not(pc.match_substring_regex(bare, WORDS), pc.match_substring_regex(distinct, "[0-9]")).to_numpy(zero_copy_only=False)
            lists = [_distinct(row, place, len(t), len(bare), np.flatnonzero(wordy), bare.filter(pa.array(wordy)))]
            likely = np.flatnonzero(pc.match_substring_regex(distinct, "[a-z]{2}[0-9][0-9a-z]{2}").to_numpy(zero_copy_only=False))
            codes = [(i, c) for i, f in zip(likely, distinct.take(pa.array(likely)).to_pylist()) for c in CODE.findall(f)]
            lists.append(_distinct(row, place, len(t), len(bare), np.array([i for i, _ in codes], np.int64), pa.array([c for _, c in codes], pa.string())))
            model = pc.struct_field(pc.extract_regex(t, MODEL), "model")
            yield pa.RecordBatch.from_arrays([batch.column(0), model, lists[1], lists[0]], ["hint", "model", "codes", "phrases"])

    trusted = rows.where(f"trim({hint}) <> '' and {text} is not null").select(F.lower(F.trim(hint)).alias("hint"), F.lower(F.col(text)).alias("t"))
    found = trusted.mapInArrow(run, "hint string, model string, codes array<string>, phrases array<string>")
    return found.select("hint", F.when(F.col("model").isNotNull(), F.xxhash64("hint", "model", F.array_join("codes", " "))).alias("product"), "phrases")


def _distinct(row: np.ndarray, place: np.ndarray, rows: int, places: int, at: np.ndarray, values: pa.Array) -> pa.Array:
    """For each of ``rows`` the sorted distinct ``values`` of its fields: ``values[k]`` stands in the field numbered ``at[k]``, field ``place[i]`` in row ``row[i]``."""
    names = values.dictionary_encode()
    order = np.argsort(np.array(names.dictionary.to_pylist(), object), kind="stable") if len(names.dictionary) else np.zeros(0, np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[names.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
    first = np.searchsorted(at, np.arange(places + 1))  # ``at`` is sorted; a field may hold several values
    many = np.diff(first)[place]
    start = np.repeat(first[place] - np.r_[0, np.cumsum(many)[:-1]] if len(place) else many, many)
    code = np.unique(np.repeat(row, many) * max(1, len(order)) + ids[start + np.arange(len(start))])
    offsets = np.r_[0, np.cumsum(np.bincount(code // max(1, len(order)), minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), names.dictionary.take(pa.array(order[code % max(1, len(order))])))


def _numbered(listings: DataFrame, phrases: list[str]) -> DataFrame:
    """``product`` and the sorted numbers (places in ``phrases``) of its listing's phrases; others are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(phrases, pa.string())
        for batch in batches:
            lists = batch.column(1)
            ids = pc.index_in(lists.flatten(), value_set=known)
            row = pc.list_parent_indices(lists)
            kept = pc.is_valid(ids)
            flat, at = ids.filter(kept).to_numpy(zero_copy_only=False), row.filter(kept).to_numpy(zero_copy_only=False)
            order = np.lexsort((flat, at))
            offsets = np.r_[0, np.cumsum(np.bincount(at, minlength=len(lists)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[order].astype(np.int32)))], ["product", "ids"])

    return listings.select("product", "phrases").mapInArrow(run, "product bigint, ids array<int>")


def _pairs(rows: DataFrame, column: str = "ids") -> dict[tuple[int, int], int]:
    """How many rows hold both numbers of each pair, the smaller first. Counted by batch, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(batch.column(0)).to_numpy(zero_copy_only=False)
            codes = []
            for d in range(1, len(ids)):
                same = row[d:] == row[:-d]
                if not same.any():
                    break
                codes.append((ids[:-d][same] << 32) | ids[d:][same])
            code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

    counted = rows.select(column).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return {(r.code >> 32, r.code & 0xFFFFFFFF): r.n for r in counted.collect()}


def _shares(products: DataFrame, value: np.ndarray) -> dict[int, float]:
    """By value: the mean share of a product's listings that state it, over the products where one does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = pc.list_parent_indices(batch.column(1)).to_numpy(zero_copy_only=False)
            ids, times = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            listings = batch.column(0).to_numpy(zero_copy_only=False)
            code, at = np.unique(row.astype(np.int64) * len(value) + value[ids], return_inverse=True)
            share = np.minimum(1.0, np.bincount(at, weights=times, minlength=len(code)) / listings[code // len(value)])
            v = code % len(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(v).astype(np.int32)), pa.array(np.bincount(v, weights=share)[np.unique(v)]), pa.array(np.bincount(v)[np.unique(v)].astype(np.int64))], ["v", "s", "n"])

    found = products.select("listings", "ids", "times").mapInArrow(run, "v int, s double, n bigint").groupBy("v").agg((F.sum("s") / F.sum("n")).alias("s"))
    return {r.v: r.s for r in found.collect()}


def _plain(phrases: set[str]) -> set[str]:
    """The phrases without those that only add words to another one (an automaton finds that one inside them)."""

    def adds(p: str) -> bool:
        words = p.split()
        return len(words) > 2 and any(" ".join(words[i:j]) in phrases for i in range(len(words)) for j in range(i + 2, len(words) + 1) if j - i < len(words))

    return {p for p in phrases if not adds(p)}


class _Groups:
    """Union of phrases that mean the same."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def root(self, x: str) -> str:
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a


def mined_dictionary(rows: DataFrame, text: str, hint: str) -> dict[str, tuple[str, str]]:
    """Phrase -> (slot, value): slot ``kind`` for nouns of items, ``v1``, ``v2``, ... for the values of variant attributes."""
    trusted = durable(_listings(rows, text, hint))  # slim: words only
    total = trusted.count()
    counts = trusted.select("hint", F.explode("phrases").alias("p")).groupBy("p", "hint").agg(F.count("*").alias("n"))
    known = counts.groupBy("p").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("hint", F.struct("n", "hint")).alias("hint")).where(F.col("n") >= max(5.0, SUPPORT * total)).collect()
    plain = _plain({r.p for r in known if not COUNTED.search(r.p)})
    n, pure = {r.p: r.n for r in known if r.p in plain}, {r.p: r.hint for r in known if r.p in plain and r.most >= PURITY * r.n}
    if not n:
        return {}
    phrases = sorted(n)
    kept = durable(_numbered(trusted.where("product is not null"), phrases))
    stated = kept.select("product", F.explode("ids").alias("id")).groupBy("product", "id").agg(F.count("*").cast("int").alias("n"))
    held = stated.groupBy("product").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x"))  # at most one entry a phrase
    sizes = kept.groupBy("product").agg(F.count("*").alias("listings")).where("listings > 1")
    per = durable(sizes.join(held, "product").select("listings", F.col("x.id").alias("ids"), F.col("x.n").alias("times")))
    met, beside = _pairs(per), _pairs(kept)
    products = {r.id: r.n for r in per.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect()}
    many = per.count()

    same = _Groups()
    for (x, y), k in met.items():
        a, b = phrases[x], phrases[y]
        few, more = sorted((products[x], products[y]))
        noun = (a in pure) == (b in pure) and pure.get(a) == pure.get(b)
        if noun and k >= (2 if a in pure else 4) and k >= REPLACED[a in pure] * few and k >= LIFT * few * more / many and beside.get((x, y), 0) <= max(TOGETHER * min(n[a], n[b]), 0.1 * n[a] * n[b] / total):
            same.join(a, b)
    value = {p: same.root(p) for p in n}
    at = {p: i for i, p in enumerate(phrases)}
    place = np.array([at[value[p]] for p in phrases])
    shares = {phrases[v]: s for v, s in _shares(per, place).items()}
    size: dict[str, int] = {}
    for p in n:
        size[value[p]] = size.get(value[p], 0) + n[p]
    meet: dict[tuple[str, str], int] = {}
    for (x, y), k in beside.items():
        a, b = sorted((value[phrases[x]], value[phrases[y]]))
        if a != b:
            meet[a, b] = meet.get((a, b), 0) + k

    out = {p: ("kind", value[p]) for p in pure}
    slots: list[list[str]] = []
    variants = sorted({value[p] for p in n if p not in pure and shares.get(value[p], 0) >= CONSTANT}, key=lambda v: (-size.get(v, 0), v))
    for v in variants:
        apart = lambda other: meet.get((min(v, other), max(v, other)), 0) <= MEETING * size[v] * size[other] / total  # noqa: B023, E731
        home = next((s for s in slots if all(apart(o) for o in s)), None)
        if home is None:
            slots.append(home := [])
        home.append(v)
    named = {v: f"v{i}" for i, s in enumerate(slots, 1) for v in s}
    out |= {p: (named[value[p]], value[p]) for p in n if p not in pure and value[p] in named}
    return out
