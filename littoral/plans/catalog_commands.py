"""Registered queries over write commands and life cycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring
from ..functions.geo import ring
from ..operators import audit
from ..operators import commands as C
from ..operators import reports as R
from ..operators import series as S
from . import catalog_reports
from . import views as V
from .catalog_listings import recent
from .views import Query, oracle

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query(
    "checkin_created",
    oracle([], "SELECT person, key, status FROM a WHERE key IS NULL UNION ALL SELECT person, key, status FROM (SELECT * FROM a WHERE key IS NOT NULL AND key % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY person, status) = 1)", a="SELECT o_custkey AS person, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey // 3 END AS key, CASE o_orderkey % 5 WHEN 0 THEN 'lost' WHEN 1 THEN 'need_help' ELSE 'safe' END AS status FROM orders WHERE o_orderkey % 5 <> 0"),
)
def checkin_created(spark, d):
    """Check-ins to append: of the allowed states, and no replays of a client's key; every tenth key is stored already."""
    o = V.table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("person"), F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey div 3 END").alias("key"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'lost' WHEN 1 THEN 'need_help' ELSE 'safe' END").alias("status"))
    stored = o.select(F.expr("o_orderkey div 3").alias("key")).filter("key % 10 = 0")
    return C.created(stored, rows, "key", "status", ["safe", "need_help"])


@query("relief_created", oracle([], "SELECT c_custkey AS id, c_mktsegment AS category FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)"))
def relief_created(spark, d):
    """Requests of known categories that aren't stored yet; offers are checked alike."""
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category"))
    stored = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return C.created(stored, rows, "id", "category", V.SEGMENTS[:4])


@query(
    "shelter_created",
    oracle(["shelters"], "SELECT name, lat, lon, capacity, coalesce(status, 'open') AS status FROM a UNION ALL SELECT name, lat::DOUBLE, lon::DOUBLE, capacity, status FROM shelters",
           a="SELECT c_name AS name, (1280 + c_custkey % 60) / 100 AS lat, (7990 + c_custkey % 37) / 100 AS lon, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 500 END AS capacity, CASE c_custkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'closed' END AS status FROM customer WHERE c_mktsegment = 'BUILDING'"),
)
def shelter_created(spark, d):
    """The table of shelters after new ones were added: open unless they say otherwise, capacity as far as it is known."""
    c, k = V.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("c_custkey")
    asks = c.select(F.col("c_name").alias("name"), ((1280 + k % 60) / 100).alias("lat"), ((7990 + k % 37) / 100).alias("lon"), F.when(k % 3 == 0, k % 500).alias("capacity"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'closed' END").alias("status"))
    return V.shelters(spark, d).select("name", "lat", "lon", "capacity", "status").unionByName(asks.fillna("open", ["status"]))


@query(
    "sitreps_newest",
    oracle(["reports"], "SELECT station, day, last AS issued, n, verified FROM (SELECT source % 2 AS station, t // " + str(S.DAY) + " AS day, max(t) AS last, count(*) AS n, count(*) FILTER (WHERE status = 'verified') AS verified FROM reports GROUP BY ALL) ORDER BY issued DESC, station LIMIT 200"),
)
def sitreps_newest(spark, d):
    """The newest situation reports, one a day and station, two hundred at most."""
    g = V.reports(spark, d).groupBy((F.col("source") % 2).alias("station"), F.floor(F.col("t") / S.DAY).alias("day"))
    runs = g.agg(F.max("t").alias("issued"), F.count("*").alias("n"), F.count_if(F.col("status") == "verified").alias("verified"))
    return runs.orderBy(F.desc("issued"), "station").limit(200)


@query("shelter_deleted", oracle(["shelters"], "SELECT shelter_id FROM shelters WHERE shelter_id NOT IN (SELECT n_nationkey FROM nation)"))
def shelter_deleted(spark, d):
    gone = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("shelter_id"))
    return C.deleted(V.shelters(spark, d), gone, "shelter_id").select("shelter_id")


@query(
    "subscription_upsert",
    oracle(["subscriptions"], "SELECT coalesce(a.id, s.subscription_id) AS subscription_id, coalesce(a.lang, 'en') AS lang, CASE WHEN a.id IS NULL THEN 3 ELSE 441 END AS cells FROM subscriptions s FULL JOIN a ON a.id = s.subscription_id",
           a="SELECT id, arg_max(lang, t) AS lang FROM (SELECT o_custkey * 2 AS id, o_orderkey AS t, ['en', 'hi', 'ta'][o_orderkey % 3 + 1] AS lang FROM orders) GROUP BY id"),
)
def subscription_upsert(spark, d):
    """Fences of all cells within ten steps, for new subscriptions and for those that moved."""
    asks = V.table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("subscription_id"), F.col("o_orderkey").alias("t"), (F.col("o_custkey") % 50).alias("row"), (F.col("o_custkey") % 40).alias("col"), F.array(*map(F.lit, ["en", "hi", "ta"]))[(F.col("o_orderkey") % 3).cast("int")].alias("lang"))
    kind = "array<struct<row:bigint,col:bigint>>"
    table = V.subscriptions(spark, d).select("subscription_id", F.lit("en").alias("lang"), F.transform("cells", lambda c: F.struct(c.alias("row"), F.lit(0).cast("long").alias("col"))).cast(kind).alias("cells"))
    return C.subscribed(table, asks, "subscription_id").select("subscription_id", "lang", F.size("cells").alias("cells"))


@query("unsubscribed", oracle(["subscriptions"], "SELECT subscription_id, min_rank FROM subscriptions WHERE subscription_id NOT IN (SELECT s_suppkey FROM supplier)"))
def unsubscribed(spark, d):
    gone = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("subscription_id"))
    return C.deleted(V.subscriptions(spark, d), gone, "subscription_id").select("subscription_id", "min_rank")


@query(
    "persons_resolved",
    oracle(
        [],
        "SELECT p.id, CASE WHEN s.partner IS NOT NULL THEN 'resolved' ELSE p.status END AS status, s.partner FROM p LEFT JOIN s ON s.id = p.id",
        p="SELECT p_partkey AS id, p_partkey % 2 AS kind, CASE WHEN p_partkey % 9 = 0 THEN 'closed' ELSE 'open' END AS status FROM part",
        f="SELECT a.id, b.id AS partner FROM p a JOIN p b ON b.id = a.id + a.id % 4 WHERE a.id % 5 < 2 AND a.status = 'open' AND b.status = 'open' AND a.kind <> b.kind",
        b="SELECT id, min(partner) AS partner FROM (SELECT * FROM f UNION ALL SELECT partner, id FROM f) GROUP BY id",
        s="SELECT x.id, x.partner FROM b x JOIN b y ON y.id = x.partner AND y.partner = x.id",
    ),
)
def persons_resolved(spark, d):
    """Missing and found people resolved in pairs, guarded on both sides."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2).alias("kind"), F.expr("CASE WHEN p_partkey % 9 = 0 THEN 'closed' ELSE 'open' END").alias("status"))
    pairs = p.filter("id % 5 < 2").select("id", (F.col("id") + F.col("id") % 4).alias("partner"))
    return C.crosslinked(p, pairs).select("id", "status", "partner")


@query("person_audit", oracle(["persons"], """SELECT id, sha256('{"event_type":"missing.created","payload":{"age_days":' || age_days || ',"kind":' || kind || '},"subject_id":"' || id || '","subject_type":"missing_person"}') AS digest FROM persons"""))
def person_audit(spark, d):
    """Digests of the entries that a report of a missing person leaves: its payload has no name."""
    p = V.persons(spark, d)
    return p.select("id", F.sha2(C.envelope("missing.created", "missing_person", F.col("id"), kind=F.col("kind"), age_days=F.col("age_days")), 256).alias("digest"))


@query("report_created_events", oracle(["reports"], """SELECT id, sha256('{"event_type":"report.created","payload":{"hazard_type":"' || hazard_type || '","nlp_mode":' || CASE WHEN source = 4 THEN 'null' ELSE '"keyword"' END || ',"source":' || source || '},"subject_id":"' || id || '","subject_type":"report"}') AS digest FROM reports"""))
def report_created_events(spark, d):
    """Digests of the canonical envelopes of all reports' first entries; a missing mode stays in as null."""
    r = V.reports(spark, d)
    mode = F.when(F.col("source") != 4, "keyword")
    return r.select("id", F.sha2(C.envelope("report.created", "report", F.col("id"), hazard_type=F.col("hazard_type"), nlp_mode=mode, source=F.col("source")), 256).alias("digest"))


@query(
    "narratives_merged",
    oracle(
        ["narratives"],
        "SELECT narrative_id, status, CASE WHEN status = 'draft' AND m IS NOT NULL THEN m ELSE n END AS n, CASE WHEN m IS NULL THEN 'kept' WHEN status = 'draft' THEN 'refreshed' ELSE 'skipped' END AS change FROM narratives LEFT JOIN (SELECT home, max(n) AS m FROM c WHERE home IS NOT NULL GROUP BY home) x ON x.home = narrative_id UNION ALL SELECT cluster, 'draft', n, 'created' FROM c WHERE home IS NULL",
        c="SELECT 1000000 + n_nationkey AS cluster, n_nationkey % 11 + 3 AS n, CASE WHEN n_nationkey % 4 <> 3 THEN (SELECT max(narrative_id) FROM narratives v WHERE v.cells[1] = n_nationkey * 2 % 60 AND v.hazard_type <> 'oil_spill') END AS home FROM nation",
    ),
)
def narratives_merged(spark, d):
    """New clusters against stored narratives: each goes to the newest of those that it overlaps, or becomes a draft."""
    stored = V.narratives(spark, d)
    k = F.col("n_nationkey").cast("long")
    c = V.table(spark, d, "nation").select((k + 1_000_000).alias("cluster"), (k % 11 + 3).alias("n"), F.when(k % 4 != 3, k * 2 % 60).alias("cell"))
    home = stored.filter("hazard_type <> 'oil_spill'").groupBy(F.col("cells")[0].alias("cell")).agg(F.max("narrative_id").alias("narrative_id"))
    return C.merged_narratives(stored, c.join(home, "cell", "left").select("cluster", "narrative_id", "n"))


@query("corrections_delivered", oracle(["narratives", "subscriptions"], "SELECT narrative_id, count(DISTINCT subscription_id) AS due FROM (SELECT narrative_id, unnest(cells) AS c FROM narratives WHERE status = 'approved') JOIN (SELECT subscription_id, unnest(cells) AS c FROM subscriptions) USING (c) GROUP BY ALL"))
def corrections_delivered(spark, d):
    """On approval a correction goes to every subscription whose fence has one of its cells, whatever the tier. What each
    cell has is counted once for all narratives over it."""
    n = V.narratives(spark, d).filter("status = 'approved'").groupBy("cells").agg(F.collect_list("narrative_id").alias("ids"))
    from ..operators.spatial import sets_overlap

    keyed = n.withColumn("area", F.to_json("cells"))
    met = sets_overlap(keyed, V.subscriptions(spark, d), "area", "subscription_id", "cells").groupBy("area").agg(F.count("*").alias("due"))
    return keyed.join(met, "area").select(F.explode("ids").alias("narrative_id"), "due")


@query(
    "sitrep_tiles",
    oracle(["reports"], "SELECT p.station, p.run, p.start, count(r.id) AS reports FROM p LEFT JOIN reports r ON r.source % 2 = p.station AND r.t < p.run AND (p.start IS NULL OR r.t >= p.start) GROUP BY ALL",
           p=f"SELECT station, run, lag(run) OVER (PARTITION BY station ORDER BY run) AS start FROM (SELECT DISTINCT source % 2 AS station, max(t) OVER (PARTITION BY source % 2, t // {5 * S.DAY}) AS run FROM reports)"),
)
def sitrep_tiles(spark, d):
    """Reports between one situation report and the next: periods begin where the last one ended, whenever that was. A run
    is the last time of five days, so all but the reports of that very time belong to it, and those to the next one:
    counts by time are all that is needed, and no report is sorted."""
    r = V.reports(spark, d).select((F.col("source") % 2).alias("station"), "t", F.floor(F.col("t") / (5 * S.DAY)).alias("bin"))
    at = r.groupBy("station", "bin", "t").agg(F.count("*").alias("k"))
    runs = at.groupBy("station", "bin").agg(F.max("t").alias("run"), F.sum("k").alias("n"), F.max_by("k", "t").alias("late")).drop("bin")
    w = Window.partitionBy("station").orderBy("run")
    tiles = C.tiled(runs, "run", ["station"]).withColumn("before", F.coalesce(F.lag("late").over(w), F.lit(0)))
    return tiles.select("station", "run", F.col("period_start").alias("start"), (F.col("n") - F.col("late") + F.col("before")).alias("reports"))


_LIFE = """SELECT station_id, variable, t, z, CASE WHEN high AND was AND NOT silent THEN 'refreshed' WHEN high AND was THEN 'expired,opened' WHEN high THEN 'opened' WHEN was AND NOT silent THEN 'resolved' WHEN was THEN 'expired' END AS state
  FROM (SELECT *, coalesce(lag(high) OVER w, false) AS was, coalesce(t - lag(t) OVER w > {stale}, false) AS silent FROM (SELECT *, coalesce(abs(z) >= 2, false) AS high FROM scored) WINDOW w AS (PARTITION BY station_id, variable ORDER BY t))"""


@query(
    "anomaly_state",
    oracle(
        ["readings"],
        "SELECT station_id, variable, t, round(z, 4) AS z, state FROM (" + _LIFE.format(stale=2 * S.HOUR) + ") WHERE state IS NOT NULL",
        based=f"SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM readings WINDOW w AS (PARTITION BY station_id, variable ORDER BY t RANGE BETWEEN {7 * S.DAY} PRECEDING AND 1 PRECEDING)",
        scored="SELECT station_id, variable, t, CASE WHEN n >= 30 AND s > 1e-9 THEN (value - m) / s END AS z FROM based",
    ),
)
def anomaly_state(spark, d):
    """The life of every series' anomalies: opened, refreshed, resolved, or expired after two silent hours."""
    keys = ["station_id", "variable"]
    score = F.when((F.col("n") >= 30) & (F.col("std") > 1e-9), (F.col("value") - F.col("mean")) / F.col("std"))
    scored = S.trailing_stats(V.readings(spark, d), keys).select(*keys, "t", score.alias("z"))
    return C.anomaly_life(scored, keys, 2.0, 2 * S.HOUR).withColumn("z", F.round("z", 4))


LEADS, NEAR = (1, 2, 3, 6), 20 * R.MINUTE


def _issued(spark, d):
    """Stored sensor forecasts: each water level foretells itself, a fiftieth more for each hour ahead. One in three has been scored."""
    r = V.readings(spark, d).filter("variable = 'water_level'")
    points = F.array(*(F.struct(F.lit(h).alias("hours"), (F.col("t") + h * S.HOUR).alias("due"), (F.col("value") * (1 + h / 50)).alias("level")) for h in LEADS))
    return r.select(F.col("event_id").alias("forecast_id"), "station_id", "variable", (F.col("event_id") % 3 == 0).alias("validated"), points.alias("points"))


_DUE = f"""SELECT event_id AS forecast_id, station_id, variable, h AS hours, t + h * {S.HOUR} AS due, value * (1 + h / 50.0::DOUBLE) AS level
  FROM readings, (VALUES {", ".join(f"({h})" for h in LEADS)}) l(h)
  WHERE variable = 'water_level' AND event_id % 3 <> 0 AND t + {max(LEADS) * S.HOUR} <= (SELECT max(t) FROM readings)"""


@query(
    "forecasts_validated",
    oracle(
        ["readings"],
        "SELECT forecast_id, count(actual) AS scored_points, round(avg(abs(actual - level)), 4) AS mean_abs_error FROM met GROUP BY forecast_id",
        due=_DUE,
        met=f"SELECT d.forecast_id, d.hours, d.level, arg_min(r.value, (abs(r.t - d.due), r.event_id)) AS actual FROM due d LEFT JOIN readings r ON r.station_id = d.station_id AND r.variable = d.variable AND r.t BETWEEN d.due - {NEAR} AND d.due + {NEAR} GROUP BY ALL",
    ),
)
def forecasts_validated(spark, d):
    """Forecasts whose last point has passed and that weren't scored before, each point against the reading nearest to it
    in time within the tolerance. Without any reading a forecast has no points scored and no error."""
    now = V.readings(spark, d).agg(F.max("t").alias("now"))
    ripe = _issued(spark, d).filter("NOT validated").crossJoin(F.broadcast(now)).filter(F.element_at("points", -1)["due"] <= F.col("now"))
    points = ripe.select("forecast_id", "station_id", "variable", F.explode("points").alias("p")).select("forecast_id", "station_id", "variable", F.col("p.hours").alias("hours"), F.col("p.due").alias("t"), F.col("p.level").alias("level"))
    met = S.nearest_in_time(points, V.readings(spark, d), ["station_id", "variable"], NEAR, "value", "event_id")
    errors = met.groupBy("forecast_id").agg(F.count("*").alias("scored_points"), F.avg(F.abs(F.col("actual") - F.col("level"))).alias("error"))
    out = ripe.select("forecast_id").join(errors, "forecast_id", "left")
    return out.select("forecast_id", F.coalesce("scored_points", F.lit(0)).alias("scored_points"), F.round("error", 4).alias("mean_abs_error"))


@query("forecast_inundation", oracle(["forecasts", "elevation"], "SELECT l.station, e.cell, round(l.level - e.elevation_m, 3) AS depth_m FROM l JOIN elevation e ON e.elevation_m <= l.level", l="SELECT station, points[2].level AS level FROM forecasts QUALIFY row_number() OVER (PARTITION BY station ORDER BY issued DESC, forecast_id DESC) = 1"))
def forecast_inundation(spark, d):
    """Cells under the level that each station's newest forecast has two hours ahead."""
    newest = R.first_of(V.forecasts(spark, d), ["station"], [F.desc("issued"), F.desc("forecast_id")])
    level = newest.select("station", F.element_at(F.filter("points", lambda p: p["hours"] == 2), 1)["level"].alias("level"))
    met = V.elevation(spark, d).join(F.broadcast(level), F.col("elevation_m") <= F.col("level"))  # one level for each station
    return met.select("station", "cell", F.round(F.col("level") - F.col("elevation_m"), 3).alias("depth_m"))


@query("projected_latest", oracle(["forecasts"], f"SELECT station, forecast_id, (3 * {S.HOUR} - (n.now - issued)) // {S.HOUR} AS lead FROM forecasts, n WHERE issued >= n.now - 2 * {S.DAY} QUALIFY row_number() OVER (PARTITION BY station ORDER BY issued DESC, forecast_id DESC) = 1", n="SELECT max(issued) AS now FROM forecasts"))
def projected_latest(spark, d):
    """Each station's newest forecast, if it isn't too old, and the lead that stands for three hours from its issue."""
    f = V.forecasts(spark, d)
    fresh = f.crossJoin(F.broadcast(f.agg(F.max("issued").alias("now")))).filter(F.col("issued") >= F.col("now") - 2 * S.DAY)
    top = R.first_of(fresh, ["station"], [F.desc("issued"), F.desc("forecast_id")])
    return top.select("station", "forecast_id", F.floor((3 * S.HOUR - (F.col("now") - F.col("issued"))) / S.HOUR).alias("lead"))


@query("incidents_to_project", oracle(["reports"], f"SELECT hazard_type, row, count(*) AS n, max(t) AS seen FROM reports WHERE t >= (SELECT max(t) FROM reports) - {6 * S.HOUR} GROUP BY ALL HAVING count(*) FILTER (WHERE status = 'rejected') < count(*)"))
def incidents_to_project(spark, d):
    """Incidents seen within six hours that aren't rejected as a whole: those that a propagation forecast is made for."""
    g = recent(V.reports(spark, d), 6).groupBy("hazard_type", F.col("row").cast("long").alias("row"))
    return g.agg(F.count("*").alias("n"), F.max("t").alias("seen"), F.count_if(F.col("status") == "rejected").alias("no")).filter("no < n").drop("no")


@query("projected_cells", oracle(["reports"], f"SELECT DISTINCT hazard_type, row + dr AS row, col + dc AS col FROM (SELECT DISTINCT hazard_type, row, col FROM reports WHERE status = 'corroborated' AND t >= (SELECT max(t) FROM reports) - {6 * S.HOUR}), (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc)"))
def projected_cells(spark, d):
    """What an alert takes over from its forecast when it is issued: the cells about the incident's own."""
    r = recent(V.reports(spark, d), 6).filter("status = 'corroborated'").select("hazard_type", "row", "col").distinct()
    cells = r.select("hazard_type", F.explode(ring(F.col("row"), F.col("col"))).alias("c"))
    return cells.select("hazard_type", F.col("c.row").cast("long").alias("row"), F.col("c.col").cast("long").alias("col")).distinct()


@query("rescored", oracle(["reports", "stations", "advisories"], "SELECT r.id, round(c.confidence, 4) AS confidence, abs(round(c.confidence, 4) - r.id % 100 / 100) >= 0.01 AS audited FROM c JOIN reports r ON r.id = c.id WHERE r.status NOT IN ('verified', 'rejected') AND r.t >= (SELECT max(t) FROM reports) - " + str(6 * S.HOUR), **catalog_reports._CONF_CTES, c=catalog_reports._CONFIDENCE))
def rescored(spark, d):
    """Reports of six hours that aren't final, scored again; a change of 0.01 and more against the stored score leaves
    an audit entry."""
    r = recent(V.reports(spark, d), 6).filter("status NOT IN ('verified', 'rejected')").select("id")
    c = catalog_reports.confidence_table(spark, d)
    total = F.round(F.round(scoring.clamp(sum((F.col(k) * w for k, w in fixed.WEIGHTS.items()), F.lit(0.0))), 9), 4)
    return c.join(r, "id", "left_semi").select("id", total.alias("confidence"), (F.abs(total - F.col("id") % 100 / 100) >= 0.01).alias("audited"))


@query("snapshot_digest", oracle(["reports"], """SELECT hazard_type, sha256('{"rejected":' || rejected || ',"total":' || n || ',"verified":' || verified || '}') AS digest FROM (SELECT hazard_type, count(*) AS n, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM reports GROUP BY ALL)"""))
def snapshot_digest(spark, d):
    """Digests of canonical snapshots, one for each hazard."""
    g = V.reports(spark, d).groupBy("hazard_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "verified").alias("v"), F.count_if(F.col("status") == "rejected").alias("x"))
    return g.select("hazard_type", F.sha2(C.canonical(total=F.col("n"), verified=F.col("v"), rejected=F.col("x")), 256).alias("digest"))


@query("dataset_releases", oracle(["reports"], f"SELECT period, count(*) AS groups, sum(n)::BIGINT AS reports, sha256(string_agg(hazard_type || ':' || row || ':' || n, ',' ORDER BY hazard_type, row)) AS checksum FROM (SELECT t // {7 * S.DAY} AS period, hazard_type, row, count(*) AS n FROM reports WHERE status = 'verified' GROUP BY ALL HAVING count(*) >= 5) GROUP BY period"))
def dataset_releases(spark, d):
    """Frozen releases by week: groups of at least five, their counts, and a checksum over the rows in order."""
    r = V.reports(spark, d).filter("status = 'verified'").groupBy(F.floor(F.col("t") / (7 * S.DAY)).alias("period"), "hazard_type", "row").agg(F.count("*").alias("n")).filter("n >= 5")
    row = F.struct("hazard_type", "row", F.concat_ws(":", "hazard_type", F.col("row").cast("string"), F.col("n").cast("string")).alias("text"))
    rows = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["text"])
    return r.groupBy("period").agg(F.count("*").alias("groups"), F.sum("n").alias("reports"), F.sha2(F.array_join(rows, ","), 256).alias("checksum"))


@query("relay_pending", oracle(["checkins"], f"SELECT id, CASE WHEN id % 5 = 0 AND (SELECT max(t) FROM checkins) - t > {2 * S.HOUR} THEN 'pending' WHEN id % 5 = 0 THEN 'relayed' ELSE 'sent' END AS state FROM checkins"))
def relay_pending(spark, d):
    """Items handed to a relay that weren't confirmed within two hours are sent again."""
    c = V.checkins(spark, d)
    now = c.agg(F.max("t").alias("now"))
    state = F.when((F.col("id") % 5 == 0) & (F.col("now") - F.col("t") > 2 * S.HOUR), "pending").when(F.col("id") % 5 == 0, "relayed").otherwise("sent")
    return c.crossJoin(F.broadcast(now)).select("id", state.alias("state"))


@query("role_upgrades", oracle(["reports"], "SELECT reporter_id, CASE WHEN n > 0 THEN round(trust, 6) ELSE 0.65 END::DOUBLE AS trust FROM (SELECT r.reporter_id, coalesce(x.n, 0) AS n, x.trust FROM (SELECT DISTINCT reporter_id FROM reports WHERE reporter_id % 10 = 0) r LEFT JOIN x USING (reporter_id))", e=catalog_reports._TRUST_EVENTS, x=catalog_reports._TRUST))
def role_upgrades(spark, d):
    """Reporters who take a trusted role: the higher start counts only for those without a history."""
    r = V.reports(spark, d).filter("reporter_id % 10 = 0").select("reporter_id").distinct()
    t = catalog_reports._trust(spark, d)
    return r.join(t, "reporter_id", "left").select("reporter_id", F.coalesce("trust", F.lit(0.65)).alias("trust"))


@query("zones_refreshed", oracle([], "SELECT s_suppkey AS zone, s_nationkey AS sector, s_acctbal AS distance, 'new' AS batch FROM supplier WHERE s_suppkey % 2 = 1 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal, 'old' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"))
def zones_refreshed(spark, d):
    """A sector's new batch replaces its old one; other sectors keep theirs."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("zone"), F.col("s_nationkey").alias("sector"), F.col("s_acctbal").alias("distance"))
    sectors = V.table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("sector"))
    new = s.filter("zone % 2 = 1").join(F.broadcast(sectors), "sector", "left_semi").withColumn("batch", F.lit("new"))
    return C.deleted(s, sectors, "sector").withColumn("batch", F.lit("old")).unionByName(new)


@query("audit_global", oracle(["audit_events"], "SELECT count(*) AS n, min(id) FILTER (WHERE id % 1000 = 7) AS first_bad, count(*) FILTER (WHERE id < (SELECT min(id) FROM audit_events WHERE id % 1000 = 7)) AS good_before, (SELECT list_reduce(list_prepend('" + fixed.GENESIS + "', list(envelope ORDER BY id)), lambda a, e: sha256(a || e)) FROM audit_events) AS head FROM audit_events"))
def audit_global(spark, d):
    """One chain over all events in order, verified after some entries were tampered with: up to the first bad one."""
    chain = audit.global_chain(V.audit_events(spark, d), "id", "envelope")
    bad = chain.withColumn("envelope", F.when(F.col("id") % 1000 == 7, F.concat("envelope", F.lit("x"))).otherwise(F.col("envelope")))
    return audit.verify_global(bad)
