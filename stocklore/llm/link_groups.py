"""Consolidating pairwise matches into groups.

Minimum labels travel along the edges, pointer jumping flattens the label chains,
and the edges are then contracted to their labels, so that every round works on a
graph of at most half the nodes. Each round is checkpointed; the rounds end when no
edge joins two labels. Work is DataFrame joins and map-side combined aggregates
only: a hub that a third of all pairs touch is reduced before the shuffle, and joins
on its key are split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import durable, release


def record_key(c: Column) -> Column:
    """Identifier without outer blanks of any kind and without letter case."""
    return F.upper(F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""))


def _jump(parents: DataFrame) -> DataFrame:
    """Pointer jumping, written after each round, until every node points at a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved"))
        jumped = durable(jumped)
        done = jumped.where("moved").isEmpty()
        release(parents)
        parents = jumped
        if done:
            return parents


def consolidate(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (``node``, ``label``) per record of ``pairs``; ``label`` is the smallest record linked directly or indirectly.

    Pairs with a null side and pairs of a record with itself link nothing; repeated
    pairs count once; an empty input gives an empty result; other columns are ignored.
    """
    sides = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null and _a <> _b")
    edges = durable(sides.select(F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("near")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("near"))))
        near = edges.select(ends.alias("e")).groupBy(F.col("e.node").alias("node")).agg(F.min("e.near").alias("parent"))
        parents = _jump(durable(near))
        levels.append(parents)
        lo = parents.select(F.col("node").alias("lo"), F.col("parent").alias("p_lo"))
        hi = parents.select(F.col("node").alias("hi"), F.col("parent").alias("p_hi"))
        contracted = edges.join(lo, "lo").join(hi, "hi").where("p_lo <> p_hi").select(F.least("p_lo", "p_hi").alias("lo"), F.greatest("p_lo", "p_hi").alias("hi")).distinct()
        contracted = durable(contracted)
        release(edges)
        edges = contracted
    if not levels:
        return edges.select(F.col("lo").alias("node"), F.col("lo").alias("label"))
    labels = levels.pop().select("node", F.col("parent").alias("label"))
    while levels:
        # the labels of a level's roots are the level above's; its other roots keep their own
        top = labels.select(F.col("node").alias("parent"), "label")
        labels = durable(levels.pop().select("node", "parent").join(top, "parent", "left").select("node", F.coalesce("label", "parent").alias("label")))
    return labels


def material_groups(events: DataFrame, corpus: DataFrame) -> DataFrame:
    """Groups of accepted feedback events; ids come out as the corpus writes them (unknown ids folded), the smallest names the group.

    Events with ``accepted`` false or null, or a null or blank side, join nothing.
    """
    pairs = events.where("accepted").select(record_key(F.col("material_a")).alias("a"), record_key(F.col("material_b")).alias("b")).where("a <> '' and b <> ''")
    labels = consolidate(pairs, "a", "b")
    spelt = corpus.select(record_key(F.col("corpus_id")).alias("node"), "corpus_id").where("node is not null").groupBy("node").agg(F.min("corpus_id").alias("corpus_id"))
    named = durable(labels.join(spelt, "node", "left").select("label", F.coalesce("corpus_id", "node").alias("material_id")))
    first = named.groupBy("label").agg(F.min("material_id").alias("group_id"))
    return named.join(first, "label").select("group_id", "material_id")
