"""Numbers in an order, without sorting anything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable


def numbered(rows: DataFrame, order: list[str], name: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of ``order`` (nulls first), over all rows or within each ``group``.

    Range partitions are numbered apart and moved on by the sizes of those before (one row a
    partition is exchanged); a group's numbers start at its first row's. A group may span any
    number of partitions. Rows that are equal in ``order`` come in any order.
    """
    columns = [*group, *order]
    ranged = rows.repartitionByRange(*[F.col(c) for c in columns]).sortWithinPartitions(*columns).withColumn("_p", F.spark_partition_id())
    placed = durable(ranged.withColumn("_k", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_from"))
    offsets = sizes.select("_p", "_from", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row a partition
    every = placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_k") - F.col("_from") + F.col("_before") + 1).drop("_p", "_k", "_from", "_before")
    if not group:
        return every
    first = every.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min(name).alias("_first"))
    met = every.join(first, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    return met.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", *[f"_g{i}" for i in range(len(group))])
