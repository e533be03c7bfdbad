"""Session helpers: the settings the library expects, and shipping its code to Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def builder(name: str = "stocklore") -> SparkSession.Builder:
    """A builder with adaptive execution, skew handling and UTC; sizes are left to the cluster."""
    return (
        SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    )


def ship(spark: SparkSession) -> None:
    """Hands this package to the context's Python workers once, so that they find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_stocklore_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stocklore-code-")) / "stocklore_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._stocklore_shipped = True


def width(spark: SparkSession) -> int:
    """Number of partitions that keeps every core busy, and no less than the session asks for."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in at least as many partitions as there are cores, for work that costs far more than moving a row.

    Only plans without a shuffle are looked at (asking others for their partitions would run them),
    and only inputs of fewer partitions than cores are moved; large tables stay where they are.
    """
    if "Adaptive" in rows._jdf.queryExecution().executedPlan().getClass().getSimpleName():
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
