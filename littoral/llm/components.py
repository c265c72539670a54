"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (u, label): label is the least vertex of u's component. Vertices without edges don't appear.

    Each round takes the least label among a vertex and its neighbours, then jumps to that label's own label, so the
    rounds grow with the logarithm of a component's length or so. Rounds are checkpointed; only a count reaches the
    driver. Hubs are summed map-side, and their rows in joins can be split.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct()
    both = cut(both)
    labels = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("low"))
        low = cut(low)
        jump = low.select(F.col("u").alias("low"), F.col("low").alias("lower"))
        new = cut(low.join(jump, "low", "left").select("u", F.coalesce("lower", "low").alias("label"), (F.coalesce("lower", "low") != F.col("label")).alias("moved")))
        labels = new.select("u", "label")
        if not new.filter("moved").limit(1).count():
            return labels
