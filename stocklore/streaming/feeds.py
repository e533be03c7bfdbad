"""Structured Streaming over incoming feeds and events: the batch operators with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feed_stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _timed(events: DataFrame, time: str, lateness: str) -> DataFrame:
    """Events with a watermark; times without a zone count as the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def first_arrivals(events: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Events without repeats of a key; state older than the watermark is dropped. Null keys are one key."""
    return _timed(events, time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """Rows and sum of ``value`` by window and key; works on batches too. Null times fall in no window."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = _timed(events, time, lateness).groupBy(window.alias("w"), F.col(by)).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "events", "value")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Activity sessions of a key: start, end (last event plus gap), events."""
    counted = _timed(events, time, lateness).groupBy(F.session_window(time, gap).alias("w"), F.col(by)).agg(F.count("*").alias("events"))
    return counted.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


STATE = T.StructType([T.StructField("accepted", T.LongType()), T.StructField("rejected", T.LongType()), T.StructField("last", T.StringType())])
VERDICT = "entity_id string, accepted bigint, rejected bigint, last_event string"


def running_verdicts(events: DataFrame) -> DataFrame:
    """Running acceptance of each entity of a feedback stream (``entity_id``, ``accepted``, ``created_at``), one state row a key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        yes, no, last = state.get if state.exists else (0, 0, "")
        for pdf in batches:
            yes += int((pdf["accepted"] == True).sum())  # noqa: E712
            no += int((pdf["accepted"] == False).sum())  # noqa: E712
            last = max([last, *pdf["created_at"].dropna()])
        state.update((yes, no, last))
        yield pd.DataFrame({"entity_id": [key[0]], "accepted": [yes], "rejected": [no], "last_event": [last]})

    keyed = events.where("entity_id is not null").select("entity_id", "accepted", "created_at")
    return keyed.groupBy("entity_id").applyInPandasWithState(update, VERDICT, STATE, "update", "NoTimeout")


def run_once(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what has arrived and hands each micro-batch to ``sink(batch, id)``; restarts go on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
