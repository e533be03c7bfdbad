"""Hash-chained audit logs: append, verify, read.

Every event's hash covers the event and the hash of the event before it in its log, so an
edit breaks every later link until all of them are redone. Making a chain is sequential by
nature: a log's events are streamed in order through one task, batch by batch, with no more
than the last hash in memory; logs are spread over the tasks. Verifying is parallel: an
event is rehashed with the link it states, and that link is compared with the stated hash of
the event before, which range partitions hand on (one row a partition).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import width
from .durable import durable

# What an event's hash covers, and the form of its id.
COVERED = ("entity_type", "entity_id", "event_type", "actor", "details", "timestamp", "input_hash", "output_hash", "model_version", "previous_event_hash")
EVENT = "entity_type string, entity_id string, event_type string, actor string, details map<string,string>, timestamp string, model_version string"
EVENT_ID, ID_DIGITS = "evt_", 24


def payload_hash(value) -> str:
    """SHA-256 of the canonical JSON: keys sorted, no blanks, characters as they are."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode("utf-8", "surrogatepass")).hexdigest()


def _payload(row, previous: str) -> dict:
    details = {k: v for k, v in (row["details"] or {}).items()}
    text = lambda c: row[c] if isinstance(row[c], str) else ""
    return {
        "entity_type": text("entity_type"), "entity_id": text("entity_id"), "event_type": text("event_type"), "actor": text("actor"), "details": details, "timestamp": text("timestamp"),
        "input_hash": payload_hash(details.get("input")), "output_hash": payload_hash(details.get("output")), "model_version": str(details.get("model_version", "")), "previous_event_hash": previous,
    }


def _types(df: DataFrame, *names: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def appended(events: DataFrame, log: str, order: str, heads: DataFrame | None = None) -> DataFrame:
    """Events (``log``, ``order``, entity_type, entity_id, event_type, actor, details MAP, timestamp) with input_hash, output_hash, model_version, previous_event_hash, event_hash, event_id.

    ``order`` orders a log's events and must be unique in it; null text counts as empty, null details as none.
    ``heads`` (``log``, ``event_hash``): the last hash of logs that go on. Other columns are ignored.
    """
    given = ("entity_type", "entity_id", "event_type", "actor", "details", "timestamp")
    rows = events.select(log, order, *given)
    rows = rows.join(heads.select(F.col(log), F.col("event_hash").alias("_head")), log, "left") if heads is not None else rows.withColumn("_head", F.lit(None).cast("string"))
    placed = rows.repartition(width(events.sparkSession), log).sortWithinPartitions(log, order)
    made = ("input_hash", "output_hash", "model_version", "previous_event_hash", "event_hash", "event_id")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = object(), ""
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = None if pd.isna(row[log]) else row[log]
                if key != at:
                    at, last = key, row["_head"] if isinstance(row["_head"], str) else ""
                payload = _payload(row, last)
                last = payload_hash(payload)
                out.append((payload["input_hash"], payload["output_hash"], payload["model_version"], payload["previous_event_hash"], last, EVENT_ID + last[:ID_DIGITS]))
            yield pd.concat([pdf[[log, order, *given]].reset_index(drop=True), pd.DataFrame(out, columns=list(made))], axis=1)

    return placed.mapInPandas(chain, f"{_types(rows, log, order, *given)}, " + ", ".join(f"{m} string" for m in made))


def with_previous(rows: DataFrame, log: str, order: str, column: str, name: str) -> DataFrame:
    """Adds ``name``: ``column`` of the row before within the log, empty for its first. A log is spread over range partitions, however long it is;
    a partition's first row looks at the last one of the partition before (one row a partition is exchanged)."""
    ranged = rows.repartitionByRange(F.col(log), F.col(order)).withColumn("_part", F.spark_partition_id())
    placed = durable(ranged)
    inside = Window.partitionBy("_part").orderBy(log, order)
    here = F.struct(F.col(log).alias("l"), F.col(column).alias("c"))
    near = placed.withColumn("_log", F.lag(here).over(inside))
    last = placed.groupBy("_part").agg(F.max_by(here, F.struct(log, order)).alias("_last"))
    before = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))
    joined = near.join(F.broadcast(before), "_part").withColumn("_b", F.coalesce("_log", "_edge"))
    return joined.withColumn(name, F.when(F.col("_b.l").eqNullSafe(F.col(log)) & F.col("_b").isNotNull(), F.coalesce("_b.c", F.lit(""))).otherwise("")).drop("_part", "_log", "_edge", "_b")


def rehashed(events: DataFrame) -> Column:
    """The hash that an event must have, with the link it states."""

    @F.pandas_udf("string")
    def again(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([payload_hash(_payload(r, r["previous_event_hash"] or "")) for r in rows.to_dict("records")], dtype="object")

    return again(F.struct("entity_type", "entity_id", "event_type", "actor", F.col("details"), "timestamp", "previous_event_hash"))


def checked(chain: DataFrame, log: str, order: str) -> DataFrame:
    """Adds ``sound``: the event's hash and id fit its content, and its link is the hash of the event before in its log."""
    linked = with_previous(chain, log, order, "event_hash", "_before")
    hashed = linked.withColumn("_again", rehashed(linked))
    fits = (F.col("event_hash") == F.col("_again")) & (F.col("event_id") == F.concat(F.lit(EVENT_ID), F.substring("_again", 1, ID_DIGITS)))
    return hashed.withColumn("sound", F.coalesce(fits & (F.col("previous_event_hash") == F.col("_before")), F.lit(False))).drop("_before", "_again")


def verified(chain: DataFrame, log: str, order: str) -> DataFrame:
    """One row a log: ``events``, ``broken`` (events whose hash, id or link is wrong), ``first_broken`` (its order), ``valid``."""
    bad = F.when(~F.col("sound"), F.col(order))
    return checked(chain, log, order).groupBy(log).agg(F.count("*").alias("events"), F.count(bad).alias("broken"), F.min(bad).alias("first_broken")).withColumn("valid", F.col("broken") == 0)


def history(chain: DataFrame, order: str, entity_type: str | None = None, entity_id: str | None = None) -> DataFrame:
    """Events of an entity (or of all of a type), in order."""
    found = chain
    if entity_type is not None:
        found = found.where(F.col("entity_type") == entity_type)
    if entity_id is not None:
        found = found.where(F.col("entity_id") == entity_id)
    return found.orderBy(order)


def heads(chain: DataFrame, log: str, order: str) -> DataFrame:
    """The last hash of every log, from which it goes on."""
    return chain.groupBy(log).agg(F.max_by("event_hash", order).alias("event_hash"))
