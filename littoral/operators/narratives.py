"""Rumours, messages and relayed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import HAZARDS


def overlapping(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_set: str, right_set: str, least: float) -> DataFrame:
    """Pairs whose sets share at least ``least`` of the smaller list. Only sets with a common element meet."""
    l = left.select(left_key, F.size(left_set).alias("_n"), F.explode(F.array_distinct(left_set)).alias("_x"))  # noqa: E741
    r = right.select(right_key, F.size(right_set).alias("_m"), F.explode(F.array_distinct(right_set)).alias("_x"))
    both = l.join(r, "_x").groupBy(left_key, right_key, "_n", "_m").agg(F.count("*").alias("both"))
    return both.filter(F.col("both") / F.least("_n", "_m") >= least).select(left_key, right_key)


def contradicted(hazard: Column, flat: Column, rejected: Column) -> Column:
    """An analyst rejected such a report, or instruments that could show the hazard show nothing."""
    measured = hazard.isin(*(k for k, variables, *_ in HAZARDS if variables))
    return (rejected > 0) | (measured & flat)


def correction(hazard: Column, place: Column, rejected: Column) -> Column:
    """Struct of a standard and a short text: what is claimed where, that it isn't confirmed, and why."""
    label = F.replace(hazard, F.lit("_"), F.lit(" "))
    why = F.when(rejected > 0, "an analyst looked at such reports and found no hazard").otherwise("instruments nearby show nothing unusual")
    return F.struct(
        F.format_string("Not confirmed: %s near %s. Reason: %s. Please check official channels before sharing.", label, place, why).alias("standard"),
        F.format_string("Not confirmed: %s near %s. Please don't share.", label, place).alias("short"),
    )


def route(directive: Column, has_vector: Column, score: Column, least: float = 0.28) -> Column:
    return F.when(directive, "directive").when(~has_vector, "no_model").when(score < least, "fallback").otherwise("answer")


def flatten_messages(raw: DataFrame, message: str) -> DataFrame:
    """Payloads entry[].changes[].value.messages[] to one row a message; payloads that don't parse give none."""
    schema = f"entry array<struct<changes:array<struct<value:struct<messages:array<struct<{message.replace(' ', ':').replace(',:', ',')}>>>>>>>"
    e = raw.select(F.explode(F.from_json("payload", schema)["entry"]).alias("e"))
    return e.select(F.explode("e.changes").alias("c")).select(F.explode("c.value.messages").alias("m")).select("m.*")


def relayed(bundles: DataFrame, most_hops: int) -> DataFrame:
    return bundles.filter(F.col("hops") <= most_hops).select("bundle", F.explode("items").alias("item"))
