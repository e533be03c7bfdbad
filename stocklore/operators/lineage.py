"""Signal graphs, crawl frontiers and leader clusters."""

from __future__ import annotations

import difflib
import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import width
from .durable import durable, release


def signal_graph(signals: DataFrame, source: str, target: str, value: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): a vertex for every distinct end, an edge for every signal with a value."""
    ends = signals.select(F.explode(F.array(F.struct(F.col(source).cast("string").alias("id"), F.lit(source).alias("kind")), F.struct(F.col(target).cast("string").alias("id"), F.lit(target).alias("kind")))).alias("v"))
    edges = signals.where(F.col(value).isNotNull()).select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"), F.col(value).alias("value"), F.col(unit).alias("unit"))
    return ends.select("v.id", "v.kind").where("id is not null").distinct(), edges


def frontier(links: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(``url``, ``depth``) of pages reached from ``seeds`` (url) over ``links`` (source, target) in at most ``depth`` steps, each at its least depth."""
    edges = links.select("source", "target").where("source is not null and target is not null").distinct()
    seen = durable(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        last = seen.where(F.col("depth") == step - 1).select(F.col("url").alias("source"))
        new = edges.join(last, "source").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step))
        more = durable(seen.unionByName(new))
        if more.where(F.col("depth") == step).isEmpty():
            return more
        release(seen)
        seen = more
    return seen


def similarity(a: str, b: str) -> float:
    """Matching-blocks ratio of two texts, ignoring case."""
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def _first_leaders(texts: list[str], leaders: list[str], threshold: float, grow: bool) -> list[int]:
    """For every text the place of the first leader similar enough, else -1; with ``grow`` such a text leads from then on, and places are those of ``texts``.

    Lengths and letter counts bound the ratio from above (letters fall into buckets, which only raises the bound), so only pairs that can reach the threshold are compared.
    """
    room = len(leaders) + (len(texts) if grow else 0)
    lead = [(t.lower(), i) for i, t in enumerate(leaders)]
    counts, sizes = np.zeros((room, BUCKETS), np.int32), np.zeros(room, np.int64)
    for i, (t, _) in enumerate(lead):
        counts[i], sizes[i] = _letters(t), len(t)
    out = []
    for at, text in enumerate(texts):
        low, n = text.lower(), len(lead)
        mine = _letters(low)
        both = sizes[:n] + len(low)
        bound = np.where(both > 0, 2.0 * np.minimum(counts[:n], mine).sum(axis=1) / np.maximum(both, 1), 1.0)
        matcher, found = difflib.SequenceMatcher(None, "", low), -1
        for i in np.flatnonzero(bound >= threshold):
            matcher.set_seq1(lead[i][0])
            if matcher.ratio() >= threshold:
                found = lead[i][1]
                break
        else:
            if grow:
                counts[n], sizes[n], found = mine, len(low), at
                lead.append((low, at))
        out.append(found)
    return out


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % BUCKETS, minlength=BUCKETS)


def leader_clusters(rows: DataFrame, key: str, text: str, block: str, threshold: float = 0.75) -> DataFrame:
    """(``key``, ``leader``): in order of ``key`` a text joins the first cluster of its block whose first member is similar enough.

    Equal texts are combined first. The rule holds over whole blocks, in rounds: the first ``PART_ROWS`` texts
    left of every block are settled one after the other, then all later ones are compared with the leaders found, in parallel
    parts; what no leader takes is left for the next round. Earlier leaders come first, so sizes of rounds and parts don't change the result.
    """
    base = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(block).cast("string"), F.lit("")).alias("b")).where("t is not null")
    left = durable(base.groupBy("b", "t").agg(F.min("k").alias("k")))
    key_type = dict(rows.dtypes)[key]
    cores = width(rows.sparkSession)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "t"], ignore_index=True)
        found = _first_leaders(list(pdf["t"]), [], threshold, True)
        return pdf.assign(leads=[f == i for i, f in enumerate(found)], leader=pdf["k"].take(found).array)[["b", "t", "k", "leads", "leader"]]

    def compare(pdf: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        leaders = leaders.sort_values(["k", "t"], ignore_index=True)
        found = _first_leaders(list(pdf["t"]), list(leaders["t"]), threshold, False)
        keys = list(leaders["k"])
        return pdf.assign(joins=[f >= 0 for f in found], leader=[keys[f] if f >= 0 else None for f in found])[["b", "t", "k", "joins", "leader"]]

    settled = []
    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy("b").orderBy(F.asc_nulls_last("k"), "t"))
        head = left.withColumn("_n", rank).where(F.col("_n") <= PART_ROWS).select("b", "t", "k")
        now = durable(head.repartition(cores, "b").groupBy("b").applyInPandas(settle, f"b string, t string, k {key_type}, leads boolean, leader {key_type}"))
        settled.append(now.select("b", "t", "leader"))
        later = left.join(now.select("b", "t"), ["b", "t"], "left_anti")
        parts = later.groupBy("b").agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
        texts = later.join(parts, "b").select("b", "t", "k", F.pmod(F.xxhash64("t"), F.col("_parts")).alias("p"))
        found = now.where("leads").join(parts, "b").select("b", "t", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("p"))
        sides = [s.repartition(cores, "b", "p").groupBy("b", "p") for s in (texts, found)]
        compared = durable(sides[0].cogroup(sides[1]).applyInPandas(compare, f"b string, t string, k {key_type}, joins boolean, leader {key_type}"))
        settled.append(compared.where("joins").select("b", "t", "leader"))
        release(left)
        left = compared.where("not joins").select("b", "t", "k")
    placed = functools.reduce(DataFrame.unionByName, settled) if settled else left.select("b", "t", F.col("k").alias("leader"))
    return base.join(placed, ["b", "t"]).select(F.col("k").alias(key), "leader")


# Texts settled in one task a round and block, or compared in one part (up to 1,000 the planner limits rows before it shuffles them); counters of a text's letters.
PART_ROWS = 1000
BUCKETS = 64
