"""Tables of merged incidents: what their reports say together, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import ring


def table(reports: DataFrame, merged: DataFrame) -> DataFrame:
    """One row for each incident: its hazard, reports, first and last time, centroid, cells and status, from reports (id, t,
    row, col, status) and what ``kernels.merge_incidents`` made of them. An incident is rejected if all its reports are,
    verified if any is, else corroborated if any is, else new. Cells are as many as an incident has, each once."""
    r = merged.select("id", "incident", "hazard_type", "n", "lat", "lon").join(reports.select("id", "t", "row", "col", "status"), "id")
    is_ = lambda s: F.col("status") == s
    status = F.when(F.every(is_("rejected")), "rejected").when(F.some(is_("verified")), "verified").when(F.some(is_("corroborated")), "corroborated").otherwise("new")
    facts = [F.first("n").alias("n"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen")]
    return r.groupBy("incident", "hazard_type").agg(*facts, F.sort_array(F.collect_set(F.struct("row", "col"))).alias("cells"), status.alias("status"))


def to_project(incidents: DataFrame, since: int) -> DataFrame:
    """Those seen since a time that aren't rejected, with the cells about their own: what a forecast of spread is made for
    and what an alert takes over from it when it is issued."""
    seen = incidents.filter((F.col("last_seen") >= since) & (F.col("status") != "rejected"))
    about = F.array_distinct(F.flatten(F.transform("cells", lambda c: ring(c["row"], c["col"]))))
    return seen.withColumn("ahead", F.sort_array(F.array_except(about, F.col("cells"))))
