"""Releases that hide individuals, and flood levels over elevation cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flooded(cells: DataFrame, level_m: float) -> DataFrame:
    return cells.filter(F.col("elevation_m") <= level_m).withColumn("depth_m", F.round(F.lit(level_m) - F.col("elevation_m"), 3))


def release(rows: DataFrame, keys: list[str], k: int, epsilon: float, seed: str) -> DataFrame:
    """Counts of groups with at least k true rows, plus Laplace(1/epsilon) noise, rounded, not below 0.

    The noise comes from a hash of seed and group, so it doesn't depend on how rows are partitioned.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    digest = F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(c).cast("string") for c in keys)), 256)
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48) - 0.5
    noise = -F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon
    return counts.select(*keys, F.greatest(F.lit(0.0), F.round(F.col("n") + noise)).cast("long").alias("report_count"))
