"""Mapping free-entered values to a canonical list.

Values are deduplicated before anything is scored. A character n-gram inverted index of
the reference list gives the candidates of a value and their weighted cosine (rare n-grams
weigh more); an entry that stands literally among a value's words scores by its share of
the value's characters or words. The best candidate is accepted above a threshold and with a margin over the
next. Where the next lies within the margin, the smaller edit distance decides; equal
distances leave the value ambiguous, and it is reported with the candidates.

The reference list is handled in blocks of at most ``block`` entries, each broadcast; the
n-gram weights are those of the whole list, and a value's candidates of all blocks are
judged together, so the result does not depend on the blocks.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import width

BLOCK = 20_000
# Characters that scanning and typing confuse.
_LOOKALIKE = str.maketrans("0158346", "OISBEAG")
THRESHOLD, MARGIN = 0.31, 0.12


def folded(s: str) -> str:
    """Letters and digits only, compatibility forms unified, upper case."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s)).upper()


def grams(s: str) -> Counter:
    """Character n-grams of ``s`` between end marks, look-alike characters unified: pairs, triples and pairs with a gap, the same without order (for swapped neighbours), and single characters as typed."""
    t = f"^{s.translate(_LOOKALIKE)}$"
    out = Counter(s)
    for i in range(len(t) - 1):
        pair, triple = t[i : i + 2], t[i : i + 3]
        out["=" + pair] += 1
        out["/" + "".join(sorted(pair))] += 1
        if len(triple) == 3:
            out["=" + triple] += 1
            out["/" + "".join(sorted(triple))] += 1
            out["=" + triple[0] + "~" + triple[2]] += 1
    for c in t[1:-1]:
        out["=" + c] += 1
    return out


def edits(a: str, b: str, most: float) -> float:
    """Edit distance with swapped neighbours as one edit and look-alike characters as half; stops beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0.0 if x == y else 0.5 if x.translate(_LOOKALIKE) == y.translate(_LOOKALIKE) else 1.0
            v = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + cost)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        before, row = row, now
        if min(row) > most:
            return most + 1
    return row[-1]


def gram_counts(entries: Iterable[str]) -> tuple[Counter, int]:
    """Number of distinct folded entries that hold each n-gram, and of these entries."""
    keys = {folded(e) for e in entries} - {""}
    return Counter(g for k in keys for g in grams(k)), len(keys)


class Index:
    """Inverted n-gram index of one block of the reference list. ``counts``: n-gram counts of the whole list, where it has several blocks."""

    def __init__(self, entries: Iterable[str], counts: tuple[Counter, int] | None = None):
        self.exact: dict[str, str] = {}
        for e in sorted(set(entries)):
            if folded(e):
                self.exact.setdefault(folded(e), e)
        self.keys = list(self.exact)
        df, n = counts or gram_counts(self.exact)
        self.idf = {g: math.log(1 + n / k) for g, k in df.items()}
        self.unseen = math.log(1 + n)
        self.words = max((len(_WORDS.findall(e)) for e in self.exact.values()), default=0)
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, key in enumerate(self.keys):
            for g, w in self._weights(key).items():
                self.postings[g].append((i, w))

    def _weights(self, key: str) -> dict[str, float]:
        bag = {g: k * self.idf.get(g, self.unseen) for g, k in grams(key).items()}
        norm = math.sqrt(sum(w * w for w in bag.values()))
        return {g: w / norm for g, w in bag.items()} if norm else {}

    def candidates(self, value: str, threshold: float, margin: float) -> list[tuple[float, str]]:
        """(score, entry) above the threshold and within the margin of this block's best, best first."""
        plain = unicodedata.normalize("NFKC", value).upper()
        whole = folded(plain)
        if not whole:
            return []
        if whole in self.exact:
            return [(1.0, self.exact[whole])]
        scores: dict[str, float] = defaultdict(float)
        for g, w in self._weights(whole).items():
            for i, x in self.postings.get(g, ()):
                scores[self.keys[i]] += w * x
        words = _WORDS.findall(plain)
        for n in range(1, min(self.words, len(words) - 1) + 1):
            for i in range(len(words) - n + 1):
                span = "".join(words[i : i + n])
                if span in self.exact:
                    scores[span] = max(scores[span], len(span) / len(whole), n / len(words))
        best = max(scores.values(), default=0.0)
        near = [(round(s, 9), self.exact[k]) for k, s in scores.items() if s >= threshold and s >= best - margin]
        return sorted(near, key=lambda x: (-x[0], x[1]))


_WORDS = re.compile(r"[^\W_]+")


def decided(value: str, candidates: list[tuple[float, str]], margin: float) -> tuple[str | None, float, str]:
    """(entry or None, score, how): ``exact``, ``margin``, ``edits``, ``ambiguous`` or ``unmatched``."""
    if not candidates:
        return None, 0.0, "unmatched"
    ranked = sorted(candidates, key=lambda x: (-x[0], x[1]))
    score, entry = ranked[0]
    rivals = [e for s, e in ranked if s >= score - margin]
    if len(rivals) == 1 or score >= 1.0:
        return entry, score, "exact" if score >= 1.0 else "margin"
    key = folded(value)
    far = sorted((edits(key, folded(e), float(max(len(key), len(e)))), e) for e in rivals)
    if far[0][0] == far[1][0]:
        return None, score, "ambiguous"
    return far[0][1], next(s for s, e in ranked if e == far[0][1]), "edits"


def map_values(values: DataFrame, value: str, entries: DataFrame, entry: str, threshold: float = THRESHOLD, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """Distinct non-empty values with ``reference_entry``, its ``score`` and ``how`` it was decided; unmatched and ambiguous values have a null entry.

    ``how``: ``exact`` (equal apart from case, blanks and punctuation), ``margin``, ``edits`` (within the
    margin, by edit distance), ``ambiguous`` or ``unmatched``. Null and blank values have no row.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(value).alias("value")).where(F.trim("value") != "").distinct().repartition(width(spark))  # few short values, costly to score
    listed = entries.select(F.col(entry).alias("e")).where("e is not null").distinct()
    blocks = max(1, math.ceil(listed.count() / block))
    parts = [listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("e"), F.lit(blocks)) == k) for k in range(blocks)]
    counts = None
    if blocks > 1:  # one block at a time on the driver; the n-grams are far fewer than the entries
        every, n = Counter(), 0
        for part in parts:
            found, k = gram_counts(r.e for r in part.collect())
            every.update(found)
            n += k
        counts = every, n
    out = None
    for part in parts:
        index = spark.sparkContext.broadcast(Index([r.e for r in part.collect()], counts))

        def score(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [index.value.candidates(v, threshold, margin) for v in pdf["value"]]
                yield pd.DataFrame({"value": pdf["value"], "candidates": [[{"score": s, "entry": e} for s, e in c] for c in found]})

        scored = distinct.mapInPandas(score, "value string, candidates array<struct<score:double,entry:string>>")
        out = scored if out is None else out.unionByName(scored)
    if blocks > 1:
        out = out.groupBy("value").agg(F.flatten(F.collect_list("candidates")).alias("candidates"))

    @F.pandas_udf("reference_entry string, score double, how string")
    def decide(v: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decided(x, [(k["score"], k["entry"]) for k in near], margin) for x, near in zip(v, c)], columns=["reference_entry", "score", "how"])

    return out.withColumn("_d", decide("value", "candidates")).select("value", "_d.*", F.transform("candidates", lambda k: k["entry"]).alias("candidates"))


def mapped_rows(rows: DataFrame, key: str, value: str, entries: DataFrame, entry: str) -> DataFrame:
    """(``entry_id``, ``value``, ``reference_entry``, ``how``) of every row whose value is neither null nor empty nor literally listed; ``-`` where none resembles it or several do alike."""
    listed = entries.select(F.col(entry).alias("_e")).distinct()
    loose = rows.select(F.col(key).alias("entry_id"), F.col(value).alias("value")).where("value <> ''")
    loose = loose.join(listed, F.col("value") == F.col("_e"), "left_anti")
    mapped = map_values(loose, "value", entries, entry).select("value", "reference_entry", "how")
    return loose.join(mapped, "value", "left").select("entry_id", "value", F.coalesce("reference_entry", F.lit("-")).alias("reference_entry"), F.coalesce("how", F.lit("unmatched")).alias("how"))


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """Values without an entry: ``value``, ``how`` (unmatched or ambiguous), ``rows``."""
    return mapped.where("reference_entry = '-'").groupBy("value", "how").agg(F.count("*").alias("rows"))
