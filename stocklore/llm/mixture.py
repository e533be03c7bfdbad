"""Mixing sources to target weights by hash-seeded Poisson replication.

Each document's number of copies inverts a Poisson distribution at a uniform number
hashed from its id, so a rerun or a lost executor gives the same mixture. A source's
mean is its target repetition rate, capped at its allowed repeats. What a draw lacks or
has too much by chance is corrected by single copies in hash order, found by sums over
buckets of the hash, so that every source ends within one document of its target, mostly far closer.
Documents are exploded by their counts and shuffled globally by a hash.
Sizes only are planned; texts are joined at the end. Only sums by source (one row a
source) reach the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import durable, release

MAX_SOURCES = 10_000


def _capped_mean(lam: float, cap: int) -> float:
    """Mean of a Poisson number that is cut at ``cap``."""
    p, mean, seen = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        seen += p
        p *= lam / (k + 1)
    return mean + cap * max(0.0, 1 - seen)


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose capped mean is ``mean`` (bisection)."""
    lo, hi = 0.0, 700.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _capped_mean(mid, cap) < mean else (lo, mid)
    return (lo + hi) / 2


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) hashed from the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, lam: Column, cap: Column) -> Column:
    """Smallest k <= cap with Poisson CDF(k) >= u, with built-in expressions only."""
    start = F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("c"), F.lit(0).alias("k"))
    step = lambda acc, i: F.when(
        (acc["c"] >= u) | (acc["k"] >= cap), acc
    ).otherwise(F.struct((acc["p"] * lam / (acc["k"] + 1)).alias("p"), (acc["c"] + acc["p"] * lam / (acc["k"] + 1)).alias("c"), (acc["k"] + 1).alias("k")))
    return F.when(cap < 1, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(cap, F.lit(1))), start, step, lambda acc: acc["k"]))


def plan(sized: DataFrame, weights: DataFrame, headroom: float) -> pd.DataFrame:
    """One row a source: ``source``, ``target_share``, ``cap``, ``available`` tokens, ``wanted`` tokens, ``rate``.

    The total is the largest at which no source must repeat its documents more than
    ``headroom`` x its cap on average. Sources without a share or without tokens are left out;
    the shares of the others are scaled to sum to 1.
    """
    if weights.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError("the list of sources is too long to be planned on the driver")
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available")).join(F.broadcast(weights), "source").toPandas()
    have = have[(have.available > 0) & (have.target_share > 0) & (have.max_repeats > 0)].rename(columns={"max_repeats": "cap"}).reset_index(drop=True)
    if not len(have):
        return have.assign(wanted=[], rate=[])
    share = have.target_share / have.target_share.sum()
    total = float((have.available * have.cap * headroom / share).min())
    have["wanted"] = share * total
    have["rate"] = [rate_for(w / a, int(c)) for w, a, c in zip(have.wanted, have.available, have.cap)]
    return have


def _corrected(drawn: DataFrame, wanted: pd.DataFrame, seed: int, tolerance: float) -> DataFrame:
    """``drawn`` (doc_id, source, n_tokens, cap, n) with ``n`` one up or down for the first documents of each source in hash order, until its tokens are within ``tolerance`` of those wanted or no document brings them nearer.

    Documents too long to bring the sum nearer are passed over. Sums over 2^16 buckets of the hash tell the bucket where the missing (or surplus) tokens are used up;
    only that bucket's documents, about one in 65,536, are ranked. A round changes a document by one copy,
    so sources of few documents may take several; each is written to the shared folder.
    """
    spark = drawn.sparkSession
    target = F.broadcast(spark.createDataFrame(wanted[["source", "wanted"]]))
    order = F.struct("_h", "doc_id")
    aims = dict(zip(wanted.source, wanted.wanted))
    best: dict[str, float] = {}
    before = None
    while True:
        drawn = durable(drawn)
        if before is not None:
            release(before)
        off = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("_t")).join(target, "source").select("source", (F.col("wanted") - F.col("_t")).alias("_off"))
        distance = {r.source: r._off for r in off.collect()}
        going = {s: d for s, d in distance.items() if abs(d) > tolerance * aims[s] and abs(d) < best.get(s, float("inf"))}
        if not going:
            return drawn
        best |= {s: abs(d) for s, d in going.items()}
        aim = F.broadcast(spark.createDataFrame([(s, float(d)) for s, d in going.items()], f"source {dict(drawn.dtypes)['source']}, _off double"))
        movable = drawn.join(aim, "source").where(F.when(F.col("_off") > 0, F.col("n") < F.col("cap")).otherwise(F.col("n") > 0))
        movable = movable.where(F.col("n_tokens") <= 2 * F.abs("_off")).select("doc_id", "source", "n_tokens", "_off", F.xxhash64(F.lit(seed), "doc_id").alias("_h")).withColumn("_bucket", F.shiftright("_h", 48))
        sums = movable.groupBy("source", "_bucket", "_off").agg(F.sum("n_tokens").alias("_t"))
        upto = sums.withColumn("_upto", F.sum("_t").over(Window.partitionBy("source").orderBy("_bucket")))
        edge = upto.where(F.col("_upto") >= F.abs("_off")).groupBy("source").agg(F.min("_bucket").alias("_edge"), F.min(F.col("_upto") - F.col("_t")).alias("_before"))
        near = movable.join(F.broadcast(edge), "source").where("_bucket = _edge")
        ranked = near.withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("_h", "doc_id")))
        # a document counts if it brings the sum nearer
        within = ranked.where(F.col("_upto") - F.col("n_tokens") / 2 <= F.abs("_off")).groupBy("source").agg(F.max(order).alias("_last"))
        cut = edge.join(within, "source", "left").select("source", "_edge", "_last")
        moved = drawn.join(aim, "source", "left").join(F.broadcast(cut), "source", "left").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
        step = F.signum("_off").cast("int")
        first = F.col("_edge").isNull() | (F.shiftright("_h", 48) < F.col("_edge")) | F.coalesce(order <= F.col("_last"), F.lit(False))
        able = (F.col("n_tokens") <= 2 * F.abs("_off")) & F.when(F.col("_off") > 0, F.col("n") < F.col("cap")).when(F.col("_off") < 0, F.col("n") > 0).otherwise(False)
        before, drawn = drawn, moved.select("doc_id", "source", "n_tokens", "cap", (F.col("n") + F.when(able & first, step).otherwise(0)).alias("n"))


def mixed_sizes(sized: DataFrame, weights: DataFrame, headroom: float = 0.6, seed: int = 17, tolerance: float = 1e-3) -> DataFrame:
    """Rows (``doc_id``, ``copy``, ``source``, ``n_tokens``, ``order_key``) of the mixture, without texts and order.

    ``sized``: doc_id (unique), source, n_tokens. Numbers of copies are Poisson numbers inverted at hashed
    uniform numbers; what a source's draw then lacks or has too much is corrected by single copies in hash
    order, so every source ends within ``tolerance`` of its target or one document of it. No document comes more than its
    source's ``max_repeats`` times; documents without tokens and of unknown or null sources don't come.
    """
    usable = sized.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")).where("n_tokens > 0 and source is not null")
    rates = plan(usable, weights.select("source", "target_share", "max_repeats"), headroom)
    if not len(rates):
        return usable.limit(0).select("doc_id", F.lit(1).alias("copy"), "source", "n_tokens", F.lit(0).cast("bigint").alias("order_key"))
    table = usable.sparkSession.createDataFrame(rates[["source", "rate", "cap"]])
    drawn = usable.join(F.broadcast(table), "source").withColumn("n", poisson_inverse(uniform(seed, "doc_id"), F.col("rate"), F.col("cap")).cast("int"))
    counted = _corrected(drawn.select("doc_id", "source", "n_tokens", "cap", "n"), rates, seed + 2, tolerance).where("n > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return copies.select("doc_id", "copy", "source", "n_tokens", F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("order_key"))


def mixture(documents: DataFrame, sized: DataFrame, weights: DataFrame, headroom: float = 0.6, seed: int = 17, tolerance: float = 1e-3) -> DataFrame:
    """Rows (``doc_id``, ``copy``, ``source``, ``n_tokens``, ``order_key``, ``text``) in global random order: ``mixed_sizes`` with the texts of ``documents`` (doc_id, text)."""
    mixed = mixed_sizes(sized, weights, headroom, seed, tolerance).join(documents.select("doc_id", "text"), "doc_id")
    return mixed.select("doc_id", "copy", "source", "n_tokens", "order_key", "text").repartitionByRange("order_key").sortWithinPartitions("order_key")


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Per source of ``weights``: documents, rows, tokens, reached and target share, largest number of repeats."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("_n"), F.sum("n_tokens").alias("_t"))
    got = per_doc.groupBy("source").agg(F.count("*").alias("documents"), F.sum("_n").alias("rows"), F.sum("_t").alias("tokens"), F.max("_n").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("_all"))
    filled = weights.join(got, "source", "left").fillna(0, ["documents", "rows", "tokens", "most_repeats"])
    return filled.join(F.broadcast(total), F.lit(True), "left").select("source", "target_share", (F.col("tokens") / F.col("_all")).alias("reached_share"), "documents", "rows", "tokens", "most_repeats", "max_repeats")
