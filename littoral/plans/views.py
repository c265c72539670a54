"""Domain views over the driver's tables, each as DataFrame and as the SQL of any engine.

The tables hold no places, hazards or states, so these come from integer arithmetic on keys. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = {"click": "water_level", "error": "wave_height", "purchase": "air_pressure", "signup": "wind", "view": "temperature"}
HAZARDS = {"click": "coastal_flooding", "error": "storm_surge", "purchase": "high_waves", "signup": "tsunami", "view": "oil_spill"}
STATUS = ["new", "corroborated", "verified", "rejected"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def _case(values: dict[str, str]) -> F.Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("event_type")]


def _sql_case(values: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def readings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("st-"), (F.col("user_id") % 2).cast("string")).alias("station_id"), _case(VARIABLES).alias("variable"), micros("ts").alias("t"), "value")


def reports(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    row, col = 1300 + F.col("user_id") % 10, F.expr("8000 + user_id div 10 % 5")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("reporter_id"),
        micros("ts").alias("t"),
        _case(HAZARDS).alias("hazard_type"),
        F.array(*map(F.lit, STATUS))[(F.col("event_id") % 4).cast("int")].alias("status"),
        (F.col("event_id") % 5).alias("source"),
        row.cast("int").alias("row"),
        col.cast("int").alias("col"),
        (row / 100).alias("lat"),
        (col / 100).alias("lon"),
        "value",
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").alias("station_id"),
        ((1280 + F.col("s_suppkey") % 40) / 100).alias("slat"),
        ((7990 + F.expr("s_suppkey div 40") % 40) / 100).alias("slon"),
        F.array(*map(F.lit, ["water_level", "wave_height", "air_pressure"]))[(F.col("s_suppkey") % 3).cast("int")].alias("variable"),
        (F.col("s_acctbal") / 1000).alias("z"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category"), ((1280 + F.col("c_custkey") % 60) / 100).alias("lat"), ((7990 + F.col("c_custkey") % 37) / 100).alias("lon"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'fulfilled' ELSE 'open' END").alias("status"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def offers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("offer_id"), F.array(*map(F.lit, SEGMENTS))[(F.col("s_suppkey") % 5).cast("int")].alias("category"), ((1280 + F.col("s_suppkey") * 7 % 60) / 100).alias("rlat"), ((7990 + F.col("s_suppkey") * 3 % 37) / 100).alias("rlon"))


def advisories(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("long").alias("advisory_id"),
        F.array(*map(F.lit, HAZARDS.values()))[(k % 5).cast("int")].alias("hazard_type"),
        ((1300 + k * 2) / 100).alias("clat"),
        ((8000 + k % 3) / 100).alias("clon"),
        (k % 4 * 2 + 2).cast("double").alias("radius_km"),
        F.array(*map(F.lit, ["Observed", "Likely", "Possible", "Unknown"]))[(k % 4).cast("int")].alias("certainty"),
        (k % 6 == 5).alias("expired"),
    )


def elevation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("cell"), (F.col("p_size") / 10).alias("elevation_m"))


def persons(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 2).alias("kind"), (F.col("p_size") * 10).alias("age_days"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1 END").alias("matched_id"))


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("subscription_id"), (k % 3).alias("min_rank"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: k % 50 + i).alias("cells"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select(k.alias("alert_id"), (k % 3).alias("tier_rank"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: k * 2 + i).alias("cells"), F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: k * 2 + 4 + i).alias("projected"))


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    envelope = F.concat_ws("|", F.lit("order.created"), F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"), envelope.alias("envelope"))


def checkins(spark: SparkSession, d: str) -> DataFrame:
    """Safety check-ins, made of orders: one in three people needs help."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), micros("o_orderdate").alias("t"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'need_help' ELSE 'safe' END").alias("status"), (1290 + F.col("o_custkey") % 20).alias("row"), (8010 + F.col("o_custkey") % 15).alias("col"))


def damages(spark: SparkSession, d: str) -> DataFrame:
    """Damage assessments, made of orders with image statistics from their keys."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), micros("o_orderdate").alias("t"), (F.col("o_orderkey") % 100 / 100).alias("water"), (F.col("o_custkey") % 40 / 100).alias("edges"), (1290 + F.col("o_custkey") % 20).alias("row"), (8010 + F.col("o_custkey") % 15).alias("col"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'reviewed' ELSE 'pending' END").alias("status"))


def shelters(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("shelter_id"), F.col("s_name").alias("name"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'full' ELSE 'closed' END").alias("status"), F.expr("CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 10 END").alias("capacity"), ((1280 + k % 40) / 100).alias("lat"), ((7990 + F.expr("s_suppkey div 40") % 40) / 100).alias("lon"))


def narratives(spark: SparkSession, d: str) -> DataFrame:
    """Stored narratives, made of parts: hazard, cells, state and the report that leads each."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    cells = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: k % 60 + i)
    return p.select(k.alias("narrative_id"), F.array(*map(F.lit, HAZARDS.values()))[(k % 5).cast("int")].alias("hazard_type"), cells.alias("cells"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' ELSE 'dismissed' END").alias("status"), (k % 7 + 2).alias("n"))


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Stored water-level forecasts, made of orders: issue time, and points one to four hours on."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("forecast_id"), (k % 2).alias("station"), micros("o_orderdate").alias("issued"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda h: F.struct(h.cast("long").alias("hours"), ((k * 7 + h * 13) % 50 / 10).alias("level"))).alias("points"))


_SEG = "['" + "', '".join(SEGMENTS) + "']"
_HAZ = "['" + "', '".join(HAZARDS.values()) + "']"
SQL: dict[str, str] = {
    "readings": f"SELECT event_id, 'st-' || (user_id % 2) AS station_id, {_sql_case(VARIABLES)} AS variable, epoch_us(ts) AS t, value FROM events",
    "reports": f"""SELECT event_id AS id, user_id AS reporter_id, epoch_us(ts) AS t, {_sql_case(HAZARDS)} AS hazard_type,
        ['new', 'corroborated', 'verified', 'rejected'][event_id % 4 + 1] AS status, event_id % 5 AS source,
        1300 + user_id % 10 AS row, 8000 + user_id // 10 % 5 AS col, (1300 + user_id % 10) / 100 AS lat,
        (8000 + user_id // 10 % 5) / 100 AS lon, value FROM events""",
    "stations": """SELECT s_suppkey AS station_id, (1280 + s_suppkey % 40) / 100 AS slat, (7990 + s_suppkey // 40 % 40) / 100 AS slon,
        ['water_level', 'wave_height', 'air_pressure'][s_suppkey % 3 + 1] AS variable, s_acctbal / 1000 AS z FROM supplier""",
    "requests": """SELECT c_custkey AS id, c_mktsegment AS category, (1280 + c_custkey % 60) / 100 AS lat,
        (7990 + c_custkey % 37) / 100 AS lon, CASE WHEN c_custkey % 3 = 0 THEN 'fulfilled' ELSE 'open' END AS status FROM customer""",
    "offers": f"""SELECT s_suppkey AS offer_id, {_SEG}[s_suppkey % 5 + 1] AS category, (1280 + s_suppkey * 7 % 60) / 100 AS rlat,
        (7990 + s_suppkey * 3 % 37) / 100 AS rlon FROM supplier""",
    "advisories": f"""SELECT n_nationkey AS advisory_id, {_HAZ}[n_nationkey % 5 + 1] AS hazard_type, (1300 + n_nationkey * 2) / 100 AS clat,
        (8000 + n_nationkey % 3) / 100 AS clon, (n_nationkey % 4 * 2 + 2)::DOUBLE AS radius_km,
        ['Observed', 'Likely', 'Possible', 'Unknown'][n_nationkey % 4 + 1] AS certainty, n_nationkey % 6 = 5 AS expired FROM nation""",
    "elevation": "SELECT p_partkey AS cell, p_size / 10 AS elevation_m FROM part",
    "persons": """SELECT p_partkey AS id, p_name AS name, p_partkey % 2 AS kind, p_size * 10 AS age_days,
        CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1 END AS matched_id FROM part""",
    "subscriptions": "SELECT c_custkey AS subscription_id, c_custkey % 3 AS min_rank, [c_custkey % 50, c_custkey % 50 + 1, c_custkey % 50 + 2] AS cells FROM customer",
    "alerts": """SELECT n_nationkey::BIGINT AS alert_id, n_nationkey % 3 AS tier_rank, [n_nationkey * 2, n_nationkey * 2 + 1, n_nationkey * 2 + 2, n_nationkey * 2 + 3] AS cells,
        [n_nationkey * 2 + 4, n_nationkey * 2 + 5] AS projected FROM nation""",
    "checkins": "SELECT o_orderkey AS id, o_custkey AS person, epoch_us(o_orderdate) AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'need_help' ELSE 'safe' END AS status, 1290 + o_custkey % 20 AS row, 8010 + o_custkey % 15 AS col FROM orders",
    "damages": "SELECT o_orderkey AS id, epoch_us(o_orderdate) AS t, o_orderkey % 100 / 100 AS water, o_custkey % 40 / 100 AS edges, 1290 + o_custkey % 20 AS row, 8010 + o_custkey % 15 AS col, CASE WHEN o_orderkey % 4 = 0 THEN 'reviewed' ELSE 'pending' END AS status FROM orders",
    "shelters": "SELECT s_suppkey AS shelter_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'full' ELSE 'closed' END AS status, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 10 END AS capacity, (1280 + s_suppkey % 40) / 100 AS lat, (7990 + s_suppkey // 40 % 40) / 100 AS lon FROM supplier",
    "narratives": f"SELECT p_partkey AS narrative_id, {_HAZ}[p_partkey % 5 + 1] AS hazard_type, [p_partkey % 60, p_partkey % 60 + 1, p_partkey % 60 + 2, p_partkey % 60 + 3] AS cells, CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' ELSE 'dismissed' END AS status, p_partkey % 7 + 2 AS n FROM part",
    "forecasts": "SELECT o_orderkey AS forecast_id, o_orderkey % 2 AS station, epoch_us(o_orderdate) AS issued, list_transform(range(1, 5), lambda h: {'hours': h, 'level': (o_orderkey * 7 + h * 13) % 50 / 10}) AS points FROM orders",
    "audit_events": """SELECT o_custkey AS subject, o_orderkey AS id,
        'order.created|' || o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority AS envelope FROM orders""",
}

KM = "2 * 6371.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


def km(a: str, b: str, c: str, d: str) -> str:
    return KM.format(a=a, b=b, c=c, d=d)


def oracle(views: list[str], final: str, **ctes: str) -> str:
    parts = [f"{v} AS ({SQL[v]})" for v in views] + [f"{k} AS ({q})" for k, q in ctes.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + final


Query = Callable[[SparkSession, str], DataFrame]
