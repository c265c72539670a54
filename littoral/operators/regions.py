"""Connected regions of occupied cells: what can never meet by steps to neighbouring cells is in different regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import ring
from ..lineage import cut


def regions(cells: DataFrame, group: list[str]) -> DataFrame:
    """Distinct (group, row, col) with region, the least cell of all that connect with it. Each round takes the least
    label of the neighbours and then that label's own label, so rounds grow with the logarithm of a region's extent."""
    cell = F.struct("row", "col")
    labels = cut(cells.select(*group, "row", "col").distinct().withColumn("region", cell))
    while True:
        near = labels.select(*group, F.explode(ring(F.col("row"), F.col("col"))).alias("c"), "region")
        low = near.groupBy(*group, F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.min("region").alias("low"))
        new = labels.join(low, [*group, "row", "col"])
        jump = new.select(*group, F.struct("row", "col").alias("low"), F.col("low").alias("lower"))
        new = new.join(jump, [*group, "low"], "left").select(*group, "row", "col", F.coalesce("lower", "low").alias("low"), "region")
        new = cut(new)
        labels = new.select(*group, "row", "col", F.col("low").alias("region"))
        if new.filter("low <> region").isEmpty():
            return labels


def with_region(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds region as text to rows with row and col."""
    known = regions(rows, group).select(*group, "row", "col", F.concat_ws(":", "region.row", "region.col").alias("region"))
    return rows.join(known, [*group, "row", "col"])
