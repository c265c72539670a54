"""Registered queries over listings, messages, narratives and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.geo import DEGREE_KM
from ..operators import narratives as N
from ..operators import reports as R
from ..operators import series as S
from ..operators import spatial as P
from . import views as V
from .catalog_reports import _MARKS
from .views import Query, km, oracle

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("narrative_overlap", oracle(["alerts", "subscriptions"], "SELECT alert_id, max(subscription_id) AS newest FROM (SELECT alert_id, subscription_id, count(*) AS shared FROM (SELECT alert_id, unnest(cells) AS c FROM alerts) JOIN (SELECT subscription_id, unnest(cells) AS c FROM subscriptions) USING (c) GROUP BY ALL) WHERE shared / 3 >= 0.5 GROUP BY ALL"))
def narrative_overlap(spark, d):
    """For each set of cells the newest other set that shares at least half of the smaller one."""
    a = V.alerts(spark, d).select("alert_id", "cells")
    s = V.subscriptions(spark, d).select("subscription_id", F.col("cells").alias("others"))
    return N.overlapping(a, s, "alert_id", "subscription_id", "cells", "others", 0.5).groupBy("alert_id").agg(F.max("subscription_id").alias("newest"))


@query(
    "station_map",
    oracle(
        ["stations", "reports"],
        f"SELECT s.station_id, s.variable, round(s.z, 3) AS z, abs(s.z) >= 3 AS anomalous, coalesce(sum(n), 0)::BIGINT AS reports FROM stations s LEFT JOIN r ON {km('r.lat', 'r.lon', 's.slat', 's.slon')} <= 5 GROUP BY ALL",
        r=f"SELECT lat, lon, count(*) AS n FROM reports WHERE t >= (SELECT max(t) FROM reports) - {S.DAY} GROUP BY ALL",
    ),
)
def station_map(spark, d):
    """Stations with their anomaly and the reports of the last day within five kilometres. Places are counted first."""
    r = V.reports(spark, d)
    now = r.agg(F.max("t").alias("now"))
    places = r.crossJoin(F.broadcast(now)).filter(F.col("t") >= F.col("now") - S.DAY).groupBy("lat", "lon").agg(F.count("*").alias("n"))
    near = P.within_km(places, V.stations(spark, d), 5.0, at=("lat", "lon", "slat", "slon")).groupBy("station_id").agg(F.sum("n").alias("n"))
    s = V.stations(spark, d).join(near, "station_id", "left")
    return s.select("station_id", "variable", F.round("z", 3).alias("z"), (F.abs("z") >= 3).alias("anomalous"), F.coalesce("n", F.lit(0)).alias("reports"))


@query("delivery_status", oracle([], "SELECT o.o_orderkey AS delivery_id, coalesce(c.c_name, 'unknown') AS name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 1) c ON c.c_custkey = o.o_custkey"))
def delivery_status(spark, d):
    c = V.table(spark, d, "customer").filter("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return V.table(spark, d, "orders").join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("delivery_id"), F.coalesce("c_name", F.lit("unknown")).alias("name"))


@query("alerts_issued", oracle(["alerts"], "SELECT tier_rank, count(*) AS n, string_agg(alert_id::VARCHAR, ',' ORDER BY alert_id) AS ids FROM alerts GROUP BY ALL"))
def alerts_issued(spark, d):
    a = V.alerts(spark, d).groupBy(F.col("tier_rank").cast("long").alias("tier_rank"))
    return a.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("alert_id")).cast("array<string>"), ",").alias("ids"))


@query("newest_per_variable", oracle(["readings"], "SELECT variable, event_id, t FROM (SELECT * FROM readings ORDER BY t DESC, event_id DESC LIMIT 50) QUALIFY row_number() OVER (PARTITION BY variable ORDER BY t DESC, event_id DESC) = 1"))
def newest_per_variable(spark, d):
    """The newest reading of each variable among the newest fifty of all: the cap comes before the choice."""
    top = R.newest(V.readings(spark, d), 50, ["t", "event_id"])
    return R.first_of(top, ["variable"], [F.desc("t"), F.desc("event_id")]).select("variable", "event_id", "t")


@query(
    "front_ahead",
    oracle(
        ["reports"],
        f"SELECT DISTINCT hazard_type, day, floor((lat + vy * h / {DEGREE_KM}) * 100 + 1e-6)::BIGINT AS row, floor((lon + vx * h / ({DEGREE_KM} * cos(radians(lat0)))) * 100 + 1e-6)::BIGINT AS col FROM (SELECT DISTINCT hazard_type, day, lat, lon FROM r) JOIN fit USING (hazard_type, day), (VALUES (24.0), (48.0)) v(h) WHERE sqrt(vx * vx + vy * vy) >= 0.001",
        r=f"SELECT *, t // {S.DAY} AS day FROM reports",
        c="SELECT hazard_type, day, avg(lat) AS lat0, avg(lon) AS lon0, min(t) AS t0, max(t) AS t1 FROM r GROUP BY ALL HAVING count(*) >= 4 AND max(t) > min(t)",
        fit=f"""SELECT hazard_type, day, any_value(lat0) AS lat0, regr_slope((lon - lon0) * {DEGREE_KM} * cos(radians(lat0)), (t - t0) / {float(S.HOUR)}) AS vx,
      regr_slope((lat - lat0) * {DEGREE_KM}, (t - t0) / {float(S.HOUR)}) AS vy FROM r JOIN c USING (hazard_type, day) GROUP BY hazard_type, day""",
    ),
)
def front_ahead(spark, d):
    """Cells that the places of each hazard and day move to with its front, one and two days on."""
    r = V.reports(spark, d).withColumn("day", F.floor(F.col("t") / S.DAY))
    f = S.front(r, ["hazard_type", "day"], least_kmh=0.001).select("hazard_type", "day", "vx", "vy", "lat0")
    moved = r.select("hazard_type", "day", "lat", "lon").distinct().join(f, ["hazard_type", "day"]).withColumn("h", F.explode(F.array(F.lit(24.0), F.lit(48.0))))
    lat = F.col("lat") + F.col("vy") * F.col("h") / DEGREE_KM
    lon = F.col("lon") + F.col("vx") * F.col("h") / (DEGREE_KM * F.cos(F.radians("lat0")))
    cell = lambda x: F.floor(x * 100 + 1e-6).cast("long")
    return moved.select("hazard_type", "day", cell(lat).alias("row"), cell(lon).alias("col")).distinct()


@query("contradictions", oracle(["reports"], "SELECT *, rejected > 0 OR (hazard_type <> 'oil_spill' AND flat) AS contradicted FROM (SELECT hazard_type, row, count(*) FILTER (WHERE status = 'rejected') AS rejected, max(value) < 150 AS flat FROM reports GROUP BY hazard_type, row)"))
def contradictions(spark, d):
    g = V.reports(spark, d).groupBy("hazard_type", F.col("row").cast("long").alias("row"))
    seen = g.agg(F.count_if(F.col("status") == "rejected").alias("rejected"), (F.max("value") < 150).alias("flat"))
    return seen.withColumn("contradicted", N.contradicted(F.col("hazard_type"), F.col("flat"), F.col("rejected")))


@query("question_routes", oracle([], "SELECT doc_id, CASE WHEN contains(lower(text), 'the ') AND doc_id % 7 = 0 THEN 'directive' WHEN doc_id % 5 = 0 THEN 'no_model' WHEN doc_id % 100 / 100 < 0.28 THEN 'fallback' ELSE 'answer' END AS route FROM documents"))
def question_routes(spark, d):
    """Directives first, then questions without a vector, then those whose best match is too far."""
    docs = V.table(spark, d, "documents")
    directive = text.any_of(F.col("text"), ["the "]) & (F.col("doc_id") % 7 == 0)
    return docs.select("doc_id", N.route(directive, F.col("doc_id") % 5 != 0, F.col("doc_id") % 100 / 100).alias("route"))


@query("message_flatten", oracle([], "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS from_users FROM conversations GROUP BY ALL"))
def message_flatten(spark, d):
    """Webhook payloads of nested entries, changes and messages, made of conversations and flattened again."""
    c = V.table(spark, d, "conversations")
    message = F.struct(F.col("conv_id").alias("from"), "turn", "role")
    payload = c.groupBy("conv_id", F.floor(F.col("turn") / 4).alias("part")).agg(F.collect_list(message).alias("messages"))
    entry = F.array(F.struct(F.array(F.struct(F.struct("messages").alias("value"))).alias("changes")))
    raw = payload.select(F.to_json(F.struct(entry.alias("entry"))).alias("payload"))
    flat = N.flatten_messages(raw, "from long, turn long, role string")
    return flat.groupBy(F.col("from").alias("conv_id")).agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("from_users"))


@query("bundle_relay", oracle([], "SELECT o_orderkey % 500 AS item, min(o_orderkey) AS first_bundle FROM orders WHERE o_orderkey % 6 <= 4 GROUP BY ALL"))
def bundle_relay(spark, d):
    """Items of relayed bundles of at most four hops, each once."""
    o = V.table(spark, d, "orders").select((F.col("o_orderkey") % 6).alias("hops"), F.array(F.col("o_orderkey") % 500).alias("items"), F.col("o_orderkey").alias("bundle"))
    return N.relayed(o, 4).groupBy("item").agg(F.min("bundle").alias("first_bundle"))


@query("reporters", oracle(["reports"], "SELECT sha256(source || ':' || reporter_id) AS reporter, min(t) AS since, count(*) AS n, CASE WHEN reporter_id % 10 = 0 THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS trust FROM reports GROUP BY source, reporter_id"))
def reporters(spark, d):
    """First sight of each source's reporters; every tenth is of a trusted role and starts higher."""
    r = V.reports(spark, d).groupBy("source", "reporter_id").agg(F.min("t").alias("since"), F.count("*").alias("n"))
    key = F.sha2(F.concat_ws(":", F.col("source").cast("string"), F.col("reporter_id").cast("string")), 256)
    return r.select(key.alias("reporter"), "since", "n", F.when(F.col("reporter_id") % 10 == 0, 0.65).otherwise(0.5).alias("trust"))


@query("incident_ratchet", oracle(["reports"], "SELECT id, max(value) OVER (PARTITION BY hazard_type, row ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS best FROM reports"))
def incident_ratchet(spark, d):
    """An incident's confidence only rises: the running maximum over its reports."""
    up = Window.partitionBy("hazard_type", "row").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return V.reports(spark, d).select("id", F.max("value").over(up).alias("best"))


@query("incident_list", oracle(["reports"], "SELECT hazard_type, row, max(t) AS last_seen, count(*) AS n FROM reports GROUP BY ALL ORDER BY last_seen DESC, hazard_type, row LIMIT 20"))
def incident_list(spark, d):
    g = V.reports(spark, d).groupBy("hazard_type", F.col("row").cast("long").alias("row")).agg(F.max("t").alias("last_seen"), F.count("*").alias("n"))
    return g.orderBy(F.desc("last_seen"), "hazard_type", "row").limit(20)


@query("zones_open", oracle([], "SELECT s_suppkey, n_name, round(s_acctbal, 2) AS distance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0 AND n_regionkey = 2"))
def zones_open(spark, d):
    n = V.table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return V.table(spark, d, "supplier").filter("s_suppkey % 4 <> 0").join(n, "s_nationkey").select("s_suppkey", "n_name", F.round("s_acctbal", 2).alias("distance"))


@query("satellite_due", oracle(["reports"], "SELECT hazard_type, count(DISTINCT row) AS incidents, CASE hazard_type WHEN 'oil_spill' THEN 'sentinel1_sar_dark_slick' ELSE 'sentinel1_water_extent' END AS recipe FROM reports WHERE status <> 'rejected' AND hazard_type IN ('coastal_flooding', 'storm_surge', 'oil_spill') GROUP BY ALL"))
def satellite_due(spark, d):
    recipes = spark.createDataFrame([(k, r) for k, _, r, _, _ in fixed.HAZARDS if r], "hazard_type string, recipe string")
    r = V.reports(spark, d).filter("status <> 'rejected'").join(F.broadcast(recipes), "hazard_type")
    return r.groupBy("hazard_type", "recipe").agg(F.countDistinct("row").alias("incidents"))


_NEAR = f"SELECT hazard_type, row, contradicted, rejected, (SELECT arg_min(name, (round({km('row / 100', '80.0', 'mlat', 'mlon')}, 9), name)) FROM marks) AS place FROM c"
_WHY = "CASE WHEN rejected > 0 THEN 'an analyst looked at such reports and found no hazard' ELSE 'instruments nearby show nothing unusual' END"


@query(
    "corrections",
    oracle(
        ["reports"],
        f"SELECT hazard_type, row, 'Not confirmed: ' || replace(hazard_type, '_', ' ') || ' near ' || place || '. Reason: ' || {_WHY} || '. Please check official channels before sharing.' AS standard, 'Not confirmed: ' || replace(hazard_type, '_', ' ') || ' near ' || place || '. Please don''t share.' AS short FROM n WHERE contradicted",
        c="SELECT *, rejected > 0 OR (hazard_type <> 'oil_spill' AND flat) AS contradicted FROM (SELECT hazard_type, row, count(*) FILTER (WHERE status = 'rejected') AS rejected, max(value) < 150 AS flat FROM reports GROUP BY hazard_type, row)",
        marks=_MARKS,
        n=_NEAR,
    ),
)
def corrections(spark, d):
    """Texts that set contradicted narratives right, each at the landmark nearest to it."""
    c = contradictions(spark, d).filter("contradicted")
    place = P.nearest_of(F.col("row") / 100, F.lit(80.0), fixed.LANDMARKS)["name"]
    m = N.correction(F.col("hazard_type"), place, F.col("rejected"))
    return c.select("hazard_type", "row", m["standard"].alias("standard"), m["short"].alias("short"))
