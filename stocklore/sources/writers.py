"""Sinks: JSON lines, CSV, quality bundles, upserts and retrieval indexes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, retrieval
from ..operators.corpus import union_all


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with keys in alphabetical order; nulls are left out."""
    rows.select(*sorted(rows.columns)).write.mode(mode).json(path)


def write_csv(path: str, *parts: DataFrame) -> None:
    """All parts under one header, the union of their columns."""
    union_all(*parts).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_quality_bundle(flags: DataFrame, path: str) -> None:
    """``report`` (JSON), ``issues``, ``clean`` and ``quarantine`` (CSV; the checks joined by bars)."""
    clean, quarantined = quality.split(flags)
    flat = lambda d: d.withColumn("checks", F.array_join("checks", "|"))
    write_jsonl(quality.file_report(flags), f"{path}/report")
    write_csv(f"{path}/issues", quality.findings(flags))
    write_csv(f"{path}/clean", flat(clean))
    write_csv(f"{path}/quarantine", flat(quarantined))


def upserted(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows, with those of ``incoming`` in place of equal keys; of repeated incoming keys the last by ``order`` wins.

    Pre-aggregated by key, so a key repeated without bound doesn't meet in one task. Rows with a null key stay apart.
    """
    others = [c for c in incoming.columns if c != key]
    last = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
    kept = stored.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.select(*[c for c in stored.columns if c in last.columns]), allowMissingColumns=True)


def replaced_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Child rows of all parents; those of parents in ``incoming`` are replaced as a whole."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming, allowMissingColumns=True)


def save_index(docs: DataFrame, key: str, text: str, path: str, model: str) -> None:
    """Postings, documents and a metadata row with a checksum and the model's name."""
    docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).write.mode("overwrite").parquet(f"{path}/documents")
    retrieval.postings(docs, key, text).repartition("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    retrieval.index_checksum(docs, key, text).withColumn("model", F.lit(model)).write.mode("overwrite").json(f"{path}/metadata")


def load_index(spark: SparkSession, path: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(documents, postings); a checksum or model that doesn't fit raises ValueError."""
    docs, postings = spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings")
    noted = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    now = retrieval.index_checksum(docs, "doc", "text").first()
    if noted["model"] != model or (noted["documents"], noted["checksum"]) != (now["documents"], now["checksum"]):
        raise ValueError("the index doesn't fit its metadata or the model")
    return docs, postings
