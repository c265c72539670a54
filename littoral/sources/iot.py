"""Telemetry messages of sensor nodes: topic and JSON payload to readings, with broken messages apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = "name string, lat string, lon string, readings array<struct<variable:string,value:string,time:string>>"


def node_of(topic: Column, prefix: str = "sensors/iot") -> Column:
    """Null unless the topic is prefix/<node>/telemetry."""
    node = F.regexp_extract(topic, f"^{prefix}/([^/]+)/telemetry$", 1)
    return F.when(node != "", node)


def observed(raw: Column, now: Column, skew_minutes: int = 5) -> Column:
    """Missing times are now; future ones end at now plus the skew."""
    return F.least(F.coalesce(F.try_to_timestamp(raw), now), now + F.expr(f"INTERVAL {skew_minutes} MINUTES"))


def checked(messages: DataFrame, prefix: str = "sensors/iot") -> DataFrame:
    """(id, topic, payload) with p, the parsed payload, node, dlat, dlon and error. One bad reading fails its message."""
    p = messages.withColumn("p", F.from_json("payload", PAYLOAD)).withColumn("node", node_of(F.col("topic"), prefix))
    lat, lon = (F.expr(f"try_cast(p.{c} as double)") for c in ("lat", "lon"))
    bad_value = F.exists("p.readings", lambda r: r["variable"].isNull() | r["value"].isNull() | r["value"].try_cast("double").isNull() | F.isnan(r["value"].try_cast("double")))
    error = (
        F.when(F.col("node").isNull(), "topic")
        .when(F.col("p").isNull() | F.col("p.readings").isNull() | (F.size("p.readings") == 0), "payload")
        .when((F.col("p.lat").isNotNull() & (lat.isNull() | (F.abs(lat) > 90))) | (F.col("p.lon").isNotNull() & (lon.isNull() | (F.abs(lon) > 180))), "place")
        .when(bad_value, "reading")
    )
    return p.withColumns({"error": error, "dlat": lat, "dlon": lon})


def parse(messages: DataFrame, now: Column, prefix: str = "sensors/iot") -> tuple[DataFrame, DataFrame]:
    """(id, topic, payload) to readings (id, station_id, lat, lon, variable, time, value) and rejected messages
    (id, topic, payload, error). One bad reading rejects its whole message."""
    all_rows = checked(messages, prefix)
    good = all_rows.filter("error is null").select("id", F.concat(F.lit("iot-"), "node").alias("station_id"), F.col("dlat").alias("lat"), F.col("dlon").alias("lon"), F.explode("p.readings").alias("r"))
    readings = good.select("id", "station_id", "lat", "lon", F.col("r.variable").alias("variable"), observed(F.col("r.time"), now).alias("time"), F.col("r.value").cast("double").alias("value"))
    return readings, all_rows.filter("error is not null").select("id", "topic", "payload", "error")


def messages(raw: DataFrame, now: Column, prefix: str = "sensors/iot") -> DataFrame:
    """(id, topic, payload) to station_id, id, name, lat, lon, readings, error, topic, payload, whole messages each. Those
    with an error have no readings, and where the topic names no station, one of 64 made-up keys spreads them."""
    reading = lambda r: F.struct(r["variable"].alias("variable"), observed(r["time"], now).alias("time"), r["value"].try_cast("double").alias("value"))
    key = F.coalesce(F.concat(F.lit("iot-"), "node"), F.concat(F.lit("rejected-"), F.pmod(F.col("id"), F.lit(64)).cast("string")))
    readings = F.when(F.col("error").isNull(), F.transform("p.readings", reading))
    return checked(raw, prefix).select(key.alias("station_id"), "id", "p.name", F.col("dlat").alias("lat"), F.col("dlon").alias("lon"), readings.alias("readings"), "error", "topic", "payload")


def stations(readings: DataFrame) -> DataFrame:
    """station_id, lat, lon (last known) and the sorted set of variables; stations never placed are left out."""
    place = F.max_by(F.struct("lat", "lon"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("time")))
    return readings.groupBy("station_id").agg(place.alias("at"), F.sort_array(F.collect_set("variable")).alias("variables")).filter("at.lat is not null").select("station_id", "at.*", "variables")
