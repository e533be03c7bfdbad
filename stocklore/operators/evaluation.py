"""Splits, ranking and classification metrics, and score calibration."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_share(group: Column, seed: str = "42") -> Column:
    """A share in [0, 1] hashed from a group's name: the first 16 hex digits of SHA-256 over ``seed:group``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group.cast("string")), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))


def group_split(rows: DataFrame, group: str, test_share: float = 0.2, seed: str = "42") -> DataFrame:
    """Adds ``partition``: whole groups go to ``test`` or ``train``.

    If no group falls to the test side the one with the largest hash does; if all do, the
    one with the smallest stays in training. Null groups count as one group named ''.
    """
    keyed = rows.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("")))
    shares = keyed.select("_g").distinct().withColumn("_s", hash_share(F.col("_g"), seed))
    edge = shares.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), F.count("*").alias("_n"), F.count_if(F.col("_s") < test_share).alias("_t"))
    test = (
        F.when(F.col("_t") == 0, F.col("_s") == F.col("_hi")).when((F.col("_t") == F.col("_n")) & (F.col("_n") > 1), F.col("_s") != F.col("_lo")).otherwise(F.col("_s") < test_share)
    )
    placed = shares.crossJoin(F.broadcast(edge)).select("_g", F.when(test, "test").otherwise("train").alias("partition"))
    return keyed.join(placed, "_g").drop("_g")


def classification(rows: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: true and false positives and negatives, precision, recall and F1 at a threshold (a score at it counts as positive); 0 where undefined."""
    yes, hit = F.col(label) == 1, F.col(score) >= threshold
    counts = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def average_precision(rows: DataFrame, label: str, score: str, order: str) -> DataFrame:
    """One row: ``positives`` and ``average_precision``; equal scores keep the order of ``order``.

    The rows are range-partitioned by score; each partition counts on from the sums of those
    before it, so no task ranks the whole table.
    """
    from .durable import durable

    kept = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(score).alias("s"), F.col(order).alias("o"))
    placed = durable(kept.repartitionByRange(F.desc("s"), F.asc("o")).withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("y").alias("_y"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_y").over(before), F.lit(0)).alias("_y0"))
    inside = Window.partitionBy("_p").orderBy(F.desc("s"), "o")
    ranked = placed.join(F.broadcast(offsets), "_p").withColumn("_r", F.row_number().over(inside) + F.col("_n0")).withColumn("_tp", F.sum("y").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_y0"))
    return ranked.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("positives"), F.sum(F.when(F.col("y") == 1, F.col("_tp") / F.col("_r"))).alias("_a")).select("positives", F.coalesce(F.col("_a") / F.col("positives"), F.lit(0.0)).alias("average_precision"))


def calibration_bins(rows: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """One row a bin that holds rows: ``bin``, ``rows``, mean probability and share of positives; the last bin includes 1."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    kept = rows.where(F.col(probability).between(0, 1) & F.col(label).isNotNull())
    return kept.groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), F.avg(probability).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def calibration_error(rows: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """One row: Brier score and expected calibration error."""
    per = calibration_bins(rows, label, probability, bins)
    ece = per.agg(F.sum(F.col("rows") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("e"), F.sum("rows").alias("n"))
    brier = rows.where(F.col(probability).between(0, 1) & F.col(label).isNotNull()).agg(F.avg(F.pow(F.col(probability) - F.col(label), F.lit(2))).alias("brier"))
    return brier.crossJoin(ece.select(F.coalesce(F.try_divide("e", "n"), F.lit(0.0)).alias("ece")))


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: queries, recall at 1, 5 and 10, mean reciprocal rank, NDCG.

    ``retrieved``: query, doc, rank; ``relevant``: query, doc. Queries without relevant
    documents don't count; queries without results count 0.
    """
    wanted = relevant.select("query", "doc").distinct().groupBy("query").agg(F.count("*").alias("n"))
    got = retrieved.join(relevant.select("query", "doc").distinct().withColumn("hit", F.lit(1)), ["query", "doc"], "left")
    gain = F.when(F.col("hit") == 1, 1.0 / F.log2(F.col("rank") + 1.0))
    per = got.groupBy("query").agg(*[F.count_if((F.col("hit") == 1) & (F.col("rank") <= k)).alias(f"h{k}") for k in (1, 5, 10)], F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.max("rank").alias("len"))
    joined = wanted.join(per, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.col("len").cast("bigint")), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.agg(F.count("*").alias("queries"), *[F.avg(zero(F.col(f"h{k}") / F.col("n"))).alias(f"recall_at_{k}") for k in (1, 5, 10)], F.avg(zero(1.0 / F.col("first"))).alias("mrr"), F.avg(zero(F.col("dcg") / ideal)).alias("ndcg"))


class Calibrator:
    """A fitted score calibration: ``platt`` (logistic) or ``isotonic`` (clipped, linear between steps)."""

    def __init__(self, method: str, parameters: dict):
        self.method, self.parameters = method, parameters

    @classmethod
    def fit(cls, rows: DataFrame, label: str, score: str, method: str = "platt") -> Calibrator:
        """Fitted by the ML library over all rows; needs at least four rows, both classes and scores within 0 and 1."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import IsotonicRegression

        kept = rows.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("s")).where("label is not null and s is not null")
        n, classes, lo, hi = kept.agg(F.count("*"), F.countDistinct("label"), F.min("s"), F.max("s")).first()
        if n < 4 or classes != 2 or lo < 0 or hi > 1:
            raise ValueError("calibration needs four rows, both classes and scores within 0 and 1")
        data = VectorAssembler(inputCols=["s"], outputCol="features").transform(kept)
        if method == "platt":
            model = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=200, tol=1e-10).fit(data)
            return cls(method, {"slope": float(model.coefficients[0]), "intercept": float(model.intercept)})
        if method != "isotonic":
            raise ValueError("method is platt or isotonic")
        model = IsotonicRegression().fit(data)
        return cls(method, {"boundaries": [float(x) for x in model.boundaries], "predictions": [float(x) for x in model.predictions]})

    def apply(self, score: Column) -> Column:
        """Probability of a score column."""
        p = self.parameters
        if self.method == "platt":
            z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), score * p["slope"] + p["intercept"]))
            return 1.0 / (1.0 + F.exp(-z))
        xs, ys = np.array(p["boundaries"]), np.array(p["predictions"])

        @F.pandas_udf("double")
        def between(s: pd.Series) -> pd.Series:
            """The step is found by binary search, so the plan doesn't grow with the number of steps."""
            return pd.Series(np.interp(s.to_numpy(float), xs, ys)).where(s.notna().to_numpy())

        return between(score.cast("double"))

    def dumps(self) -> str:
        """JSON with a 16-digit checksum of the parameters as its version."""
        body = json.dumps({"method": self.method, "parameters": self.parameters}, sort_keys=True, separators=(",", ":"))
        return json.dumps({"method": self.method, "parameters": self.parameters, "version": hashlib.sha256(body.encode()).hexdigest()[:16]}, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Calibrator:
        """The inverse of ``dumps``; a checksum that doesn't fit raises ValueError."""
        found = json.loads(text)
        out = cls(found["method"], found["parameters"])
        if json.loads(out.dumps())["version"] != found.get("version"):
            raise ValueError("the calibration was altered")
        return out


# Fixed value: the origin of labels that may judge or calibrate a score.
GOLD = "expert_gold"


def gold_only(rows: DataFrame, origin: str = "label_source") -> DataFrame:
    """``rows``, if every one is an expert's label; weak, unlabelled and null origins raise ValueError."""
    if not rows.where(~F.col(origin).eqNullSafe(F.lit(GOLD))).isEmpty():
        raise ValueError(f"{origin} must be {GOLD} on every row")
    return rows


def _filled(rows: DataFrame, column: str) -> None:
    if column not in rows.columns or not rows.where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "").isEmpty():
        raise ValueError(f"{column} must be filled on every row")


def evaluated(rows: DataFrame, label: str, score: str, group: str, threshold: float = 0.5, origin: str = "label_source", test_share: float = 0.2) -> DataFrame:
    """Metrics of the test partition of expert labels, split by whole groups: the figures of ``classification``, ``training_rows``, ``test_rows``.

    Other labels, blank groups and splits with an empty side raise ValueError.
    """
    _filled(rows, group)
    split = group_split(gold_only(rows, origin), group, test_share)
    sizes = {r.partition: r["count"] for r in split.groupBy("partition").count().collect()}
    if len(sizes) < 2:
        raise ValueError("the split leaves a side empty")
    found = classification(split.where("partition = 'test'"), label, score, threshold)
    return found.withColumn("training_rows", F.lit(sizes["train"])).withColumn("test_rows", F.lit(sizes["test"]))


def calibrated(rows: DataFrame, label: str, score: str, method: str = "platt", group: str = "validation_group", origin: str = "label_source") -> Calibrator:
    """A calibration fitted on expert labels of at least two validation groups; anything else raises ValueError."""
    _filled(rows, group)
    if gold_only(rows, origin).select(group).distinct().limit(2).count() < 2:
        raise ValueError("calibration needs several independent validation groups")
    return Calibrator.fit(rows, label, score, method)
