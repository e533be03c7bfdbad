"""Filling fixed-capacity containers with items of varying length.

Only the number of items of each length matters for a packing, and there are at most
``capacity`` lengths, so the histogram of lengths is the whole problem, however many
items there are. The plan works on that histogram: the largest length opens a container,
and its gap is looked up among single, pair and triple length sums; a combination that
fills it exactly is used for as many containers as the counts of its lengths allow. Where
none fills it, the largest length that fits goes in (best fit) and the new gap is looked
up again. Items are then numbered within their length in a distributed way (hot lengths
are salted) and the plan tells each number its container.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable

SALTED_ROWS = 500_000  # a length is numbered in runs of about this many items


@dataclass(frozen=True)
class Use:
    """Items ``first .. first + containers * each - 1`` of ``length`` go, ``each`` a container, into ``containers`` from ``base`` on."""

    length: int
    first: int
    each: int
    base: int
    containers: int


class ExactComplement:
    """Index of the sums of one, two and three available lengths, kept up as counts change.

    ``pairs[s]`` is the number of pairs of available lengths with sum ``s`` (a length twice needs two items);
    a triple of sum ``s`` is a length ``a`` with ``pairs[s - a]``. A length that runs out or comes back
    changes one slice of the index.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.one = counts > 0
        self.two = counts > 1
        n = len(counts)
        self.pairs = np.zeros(2 * n, np.int64)
        for length in np.flatnonzero(self.one):
            self.pairs[length + 1 + length : length + n] += self.one[length + 1 :]
        self.pairs[2 * np.flatnonzero(self.two)] += 1

    def add(self, length: int, items: int) -> None:
        """``items`` more (or, if negative, fewer) of a length."""
        self.counts[length] += items
        one, two = self.counts[length] > 0, self.counts[length] > 1
        if one != self.one[length]:
            self.one[length] = False
            self.pairs[length : length + len(self.one)] += self.one if one else -self.one.astype(np.int64)
            self.one[length] = one
        if two != self.two[length]:
            self.two[length] = two
            self.pairs[2 * length] += 1 if two else -1

    def find(self, gap: int) -> tuple[int, ...] | None:
        """One to three available lengths that fill ``gap`` exactly, the fewest and largest first."""
        if gap < 1:
            return None
        if gap < len(self.one) and self.one[gap]:
            return (gap,)
        pair = self._pair(gap)
        if pair:
            return pair
        here = np.flatnonzero(self.one[: gap + 1])
        largest = here[here * 3 >= gap][::-1]
        for a in largest[self.pairs[gap - largest] > 0]:
            self.add(a, -1)
            rest = self._pair(int(gap - a))
            self.add(a, 1)
            if rest:
                return (int(a), *rest)
        return None

    def _pair(self, gap: int) -> tuple[int, int] | None:
        if gap < 2 or gap >= len(self.pairs) or not self.pairs[gap]:
            return None
        low = np.arange(max(1, gap - len(self.one) + 1), gap // 2 + 1)
        ok = self.one[low] & self.one[gap - low] & ((low * 2 != gap) | self.two[low])
        k = int(low[np.flatnonzero(ok)[-1]])
        return gap - k, k


def plan(histogram: dict[int, int], capacity: int) -> list[Use]:
    """Uses that place every item of the histogram (lengths 1 .. capacity) into containers."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    total = counts.copy()
    exact = ExactComplement(counts)
    uses: list[Use] = []
    base = 0
    while True:
        here = np.flatnonzero(counts)
        if not len(here):
            return uses
        top = int(here[-1])
        content: Counter[int] = Counter()
        gap, pick = capacity, (top,)
        while pick:
            for length in pick:
                content[length] += 1
                exact.add(length, -1)
                gap -= length
            if not gap:
                break
            pick = exact.find(gap)
            if not pick:
                fits = np.flatnonzero(counts[: gap + 1])
                pick = (int(fits[-1]),) if len(fits) else None
        containers = 1 + int(min(counts[length] // k for length, k in content.items()))
        for length, k in content.items():
            uses.append(Use(length, int(total[length] - counts[length] - k), k, base, containers))
            exact.add(length, -k * (containers - 1))
        base += containers


def _numbered(pieces: DataFrame, salts: int) -> DataFrame:
    """``pos``: 0-based number within ``length``; each length is cut into salted runs whose offsets are added up."""
    salted = durable(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    offsets = sizes.selectExpr("length", "_salt", "sum(_n) over (partition by length order by _salt) - _n as _before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, _salt order by doc_id, piece) - 1 as _k")
    return ranked.join(offsets, ["length", "_salt"]).withColumn("pos", F.col("_k") + F.col("_before")).drop("_k", "_before", "_salt")


def pieces_of(sized: DataFrame, capacity: int) -> DataFrame:
    """Items no longer than ``capacity``: (``doc_id``, ``piece``, ``start``, ``length``). Only longer items are split; items of length 0 or null are left out."""
    cut = sized.select("doc_id", F.col("n_tokens").cast("int").alias("_n")).where("_n > 0")
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / capacity).cast("int") - 1)))
    return cut.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("_n") - F.col("piece") * capacity).alias("length"))


def pack(sized: DataFrame, capacity: int) -> DataFrame:
    """(``container_id``, ``doc_id``, ``piece``, ``start``, ``length``) of items (``doc_id`` unique, ``n_tokens``).

    Every item has its rows; no container holds more than ``capacity``; same input, same packing.
    """
    pieces = pieces_of(sized, capacity)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    uses = [(u.length, u.first, u.first + u.containers * u.each, u.each, u.base) for u in plan(histogram, capacity)]
    spark = sized.sparkSession
    table = spark.createDataFrame(uses, "length int, first long, past long, each long, base long")
    # at most a few uses a length: the plan's size is bounded by the capacity, not by the items
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "past", "each", "base"))).alias("uses"))
    placed = _numbered(pieces, 1 + max(histogram.values(), default=0) // SALTED_ROWS).join(F.broadcast(by_length), "length")
    mine = F.element_at(F.filter("uses", lambda u: (u["first"] <= F.col("pos")) & (F.col("pos") < u["past"])), 1)
    return placed.withColumn("_u", mine).select((F.col("_u.base") + F.floor((F.col("pos") - F.col("_u.first")) / F.col("_u.each"))).cast("bigint").alias("container_id"), "doc_id", "piece", "start", "length")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: items, containers, tokens, unused share, and the least number of containers any packing needs."""
    per = packed.groupBy("container_id").agg(F.sum("length").alias("_t"), F.count("*").alias("_n"))
    sums = per.agg(F.sum("_n").alias("pieces"), F.count("*").alias("containers"), F.sum("_t").alias("tokens"), F.max("_t").alias("fullest"))
    return sums.select("pieces", "containers", "tokens", "fullest", (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"), F.ceil(F.col("tokens") / capacity).alias("least_containers"))
