"""Garbled text from a wrong character encoding.

Characters are mapped back to the bytes of a legacy code page, a byte-structure
automaton finds the maximal runs that are well-formed multibyte UTF-8, and only those
runs are decoded; this repeats until nothing changes, for text garbled more than once. Letter case may have
been changed after the damage, so each character stands for its own byte and for that
of its other case. Text damaged between two single-byte code pages has no byte
structure; it shows by characters that no written word holds, and is mapped back whole
words at a time, or, for Cyrillic, by phrases whose bytes are words of that page. Replacement characters are found but can't be restored.

Only rows with a character beyond ASCII reach Python; nothing is shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Code pages that readers assume, tried in this order.
PAGES = ("cp1252", "cp1251", "cp850", "cp437", "mac_roman")

# Ranges of two-byte characters that a text may be meant to hold (Latin, Greek, Cyrillic, Hebrew, Arabic).
_SCRIPTS = (("\x80", "ɏ"), ("Ͱ", "џ"), ("֐", "ۿ"))

_BOX = re.compile("[─-▟�\x80-\x9f]")
_RUN = re.compile("[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W\d_]*[^\x00-\x7f\s​][^\s,;|]*")
# Two or more words next to each other, of three letters or more and of accented letters only: no Latin spelling has them, but a list of letters may.
_ACCENTED_PHRASE = re.compile(r"(?<![^\s,;|(])[À-ÖØ-öø-ÿ]{3,}(?:[ \xa0][À-ÖØ-öø-ÿ]+)+(?![^\s,;|.)])")
# Vowels of the Cyrillic script as used for Russian, letters that begin no word, pairs that no word holds.
_VOWELS = frozenset("аеёиоуыэюя")
_NOT_FIRST = frozenset("ъьы")
_NEVER_PAIRED = re.compile("[аеёиоуыэюя]ь|[ъь]{2}|й[аиуыэюяй]|ъ[^еёюя]|(.)\\1\\1")
_GLUED = re.compile("[^\\W\\d_µ][¢¤-¨¬¯³´¶¸¼-¾][^\\W\\d_]|[A-Za-zÀ-ɏ]«(?!\\s*\\w)|(?<![^\\s,;|])[À-×Ù-÷ù-ÿ]\\d|(?<!\\d)(?<!\\d )¢(?! ?\\d)")


def _byte_table(page: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        table[c] = b
    if page == "cp1252":
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


def _alternatives(page: str) -> dict[str, tuple[int, ...]]:
    """Character -> the bytes it may have come from, its own first, then that of its other case.

    Only the Windows pages get other cases: in the others letters of both cases lie among the
    continuation bytes, and ordinary accented words would look like sequences.
    """
    own = _byte_table(page)
    if page not in ("cp1252", "cp1251"):
        return {c: (b,) for c, b in own.items()}
    out: dict[str, list[int]] = {}
    for c, b in own.items():
        out.setdefault(c, []).insert(0, b)
        for other in (c.lower(), c.upper()):
            if len(other) == 1 and other != c and other not in own:
                out.setdefault(other, []).append(b)
    for c, b in own.items():
        for other in (c.lower(), c.upper()):
            if len(other) == 1 and other != c and other in own and own[other] not in out[c]:
                out[c].append(own[other])
    return {c: tuple(v) for c, v in out.items()}


TABLES = {p: _alternatives(p) for p in PAGES}


def _well_formed(text: str, i: int, table: dict[str, tuple[int, ...]]) -> bytes | None:
    """The automaton: bytes of one multibyte sequence that starts at ``i``, own bytes before other-case bytes, or None."""
    for k, lead in enumerate(table.get(text[i], ())):
        n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if not n or i + n > len(text):
            continue
        seq = [lead]
        for c in text[i + 1 : i + n]:
            blank = (0xA0,) if c == " " and n > 2 and not k and "\x81" in table else ()  # a no-break blank that became a plain one
            tail = [b for b in table.get(c, blank) if 0x80 <= b <= 0xBF]
            if not tail:
                break
            seq.append(tail[0])
        if len(seq) == n:
            raw = bytes(seq)
            try:
                c = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if n == 4 or (n == 3 and not "\ue000" <= c <= "\uf8ff") or any(lo <= c <= hi for lo, hi in _SCRIPTS):
                return raw
    return None


def _spans(text: str, page: str) -> tuple[str, int]:
    """``text`` with the maximal well-formed spans of one code page decoded, and how many characters these held.

    In the Cyrillic page a lone pair of letters is ordinary spelling; only runs of sequences count there.
    """
    table = TABLES[page]
    out, i, held = [], 0, 0
    while i < len(text):
        start, raws = i, []
        while i < len(text) and text[i] > "\x7f" and (raw := _well_formed(text, i, table)):
            raws.append(raw)
            i += len(raw)
        lone = len(raws) == 1 and page == "cp1251" and all("Ѐ" <= c <= "џ" for c in text[start:i] + raws[0].decode("utf-8"))
        if lone:
            out.append(text[start:i])
        elif raws:
            out.append(b"".join(raws).decode("utf-8"))
            held += i - start
        if not raws:
            out.append(text[i])
            i += 1
    return "".join(out), held


def _single_byte(word: str) -> str | None:
    """A word whose bytes were read by another single-byte page, mapped back."""
    if "�" in word:
        return None
    for read_as, meant in (("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850")):
        try:
            back = word.encode(read_as).decode(meant)
        except UnicodeError:
            continue
        if back != word and not _BOX.search(back) and not _GLUED.search(back) and any(c.isalpha() or c in "±°²½€®µ" for c in back if c > "\x7f"):
            return back
    return None


def _cyrillic(phrase: str) -> str | None:
    """A phrase of accented letters as Cyrillic, if its bytes in that page are written words: with vowels, no impossible beginnings or pairs, and letter case as words have it.

    None for phrases that are well-formed UTF-8 of some page as a whole, and where the bytes spell nothing (a list of accented letters).
    """
    try:
        back = phrase.encode("cp1252").decode("cp1251")
    except UnicodeError:
        return None
    words = back.split()
    low = [w.lower() for w in words]
    spelt = all(w.isalpha() and (w.isupper() or len(w) == 1 or w[1:].islower()) and w_low[0] not in _NOT_FIRST and not _NEVER_PAIRED.search(w_low) for w, w_low in zip(words, low))
    voiced = all(_VOWELS & set(w) for w in low if len(w) > 1)
    if not spelt or not voiced or any(_spans(phrase, p)[1] == len(phrase) for p in PAGES):
        return None
    return back


def _decoded(text: str, first: str | None) -> tuple[str, bool]:
    """``text`` with well-formed spans decoded until none is left (each round shortens it), and whether there were any. ``first``: the page that wins ties."""
    pages = sorted(PAGES, key=lambda p: p != first)
    found = False
    while True:
        best = max(((_spans(text, p), p) for p in pages), key=lambda x: x[0][1])[0]
        if not best[1]:
            return text, found
        found, text = True, best[0]


# The names by which readers note the pages.
NOTED = {"cp1252": "cp1252", "windows-1252": "cp1252", "latin-1": "cp1252", "latin1": "cp1252", "iso-8859-1": "cp1252", "cp1251": "cp1251", "windows-1251": "cp1251", "cp850": "cp850", "cp437": "cp437", "mac_roman": "mac_roman", "macroman": "mac_roman"}


def repair(text: str | None, noted: str | None = None) -> tuple[bool, str | None, bool]:
    """(garbled, restored text, wholly restored). Null and ASCII texts are sound; unrecoverable characters stay as they are.

    ``noted``: the encoding that the reader believed in; among pages that explain a text equally well its page counts.
    """
    if not text or text.isascii():
        return False, text, True
    page = NOTED.get((noted or "").strip().lower())
    parts: list[str] = []
    garbled = False
    at = 0
    for m in _ACCENTED_PHRASE.finditer(text):
        back = _cyrillic(m[0])
        if back:
            between, hit = _settled(text[at : m.start()], page)
            garbled = True
            parts += [between, back]
            at = m.end()
    rest, hit = _settled(text[at:], page)
    parts.append(rest)
    if not garbled:
        garbled = hit
    now = "".join(parts)
    left = bool(_BOX.search(now) or _GLUED.search(now))
    return garbled or left, now, not left


def _settled(text: str, page: str | None) -> tuple[str, bool]:
    """``text`` with multibyte spans decoded and words of damaged single bytes mapped back, and whether anything was garbled."""
    now, garbled = _decoded(text, page)

    def whole(m: re.Match) -> str:
        nonlocal garbled
        if _BOX.search(m[0]) or _GLUED.search(m[0]):
            garbled = True
            return _single_byte(m[0]) or m[0]
        return m[0]

    return _WORD.sub(whole, now), garbled


def repaired(text: Column, noted: Column | None = None) -> Column:
    """STRUCT<garbled BOOLEAN, restored STRING, complete BOOLEAN> of a text column; ``noted``: see ``repair``."""

    @F.pandas_udf("garbled boolean, restored string, complete boolean")
    def udf(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(x, e) for x, e in zip(s, n)], columns=["garbled", "restored", "complete"])

    return udf(text, F.lit(None).cast("string") if noted is None else noted)


def garbled_rows(rows: DataFrame, key: str, text: str, source: str | None = None, encodings: DataFrame | None = None) -> DataFrame:
    """Affected rows: ``key``, the text as read, the restored text, whether nothing damaged is left, and the ``noted_encoding``.

    Rows with null, empty or plain ASCII text are no cases; repeated rows come out each. ``encodings``:
    (``source_path``, ``encoding``) as readers noted them, for the file in column ``source``; the notes
    may be missing or wrong, so they only decide between pages that explain a text equally well.
    """
    wide = rows.select(F.col(key), F.col(text).alias("as_read"), *([F.col(source).alias("_source")] if source else [])).where(F.col("as_read").rlike(r"[^\x00-\x7F]"))
    wide = spread(wide)
    if source and encodings is not None:
        notes = encodings.select(F.col("source_path").alias("_source"), F.lower("encoding").alias("_note")).groupBy("_source").agg(F.min("_note").alias("noted_encoding"))
        wide = wide.join(notes, "_source", "left").drop("_source")
    else:
        wide = wide.drop("_source").withColumn("noted_encoding", F.lit(None).cast("string"))
    fixed = wide.withColumn("_r", repaired(F.col("as_read"), F.col("noted_encoding")))
    return fixed.where("_r.garbled").select(key, "as_read", F.col("_r.restored").alias("restored"), F.col("_r.complete").alias("complete"), "noted_encoding")
