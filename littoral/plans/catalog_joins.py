"""Registered queries that put several stores together: evidence, summaries, choices with a fallback, guarded states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..functions.vectors import cosine
from ..operators import commands as C
from ..operators import reports as R
from ..operators import series as S
from ..operators import spatial as P
from . import catalog_reports as CR
from . import views as V
from .catalog_listings import recent
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


_RECIPES = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{r}')" for k, _, r, _, _ in fixed.HAZARDS if r) + ") AS r(hazard_type, recipe)"


@query("satellite_evidence", oracle(["reports"], "SELECT r.id, max(o.score) AS score FROM reports r JOIN recipes USING (hazard_type) JOIN o ON o.incident = r.row AND o.recipe = recipes.recipe GROUP BY r.id", recipes=_RECIPES, o="SELECT 1300 + s_suppkey % 10 AS incident, recipe, s_suppkey % 97 / 100 AS score FROM supplier, (SELECT DISTINCT recipe FROM recipes)"))
def satellite_evidence(spark, d):
    """Each report's best observation: of its incident, by the recipe for its hazard."""
    recipes = spark.createDataFrame([(k, r) for k, _, r, _, _ in fixed.HAZARDS if r], "hazard_type string, recipe string")
    k = F.col("s_suppkey")
    seen = V.table(spark, d, "supplier").select((1300 + k % 10).alias("row"), (k % 97 / 100).alias("score")).groupBy("row").agg(F.max("score").alias("score"))
    seen = seen.crossJoin(F.broadcast(recipes.select("recipe").distinct()))  # observations hold the same scores for each recipe
    r = V.reports(spark, d).join(F.broadcast(recipes), "hazard_type")
    return r.join(seen, ["row", "recipe"]).select("id", "score")


@query("alerts_here", oracle(["alerts", "subscriptions"], "SELECT subscription_id FROM subscriptions s WHERE EXISTS (SELECT 1 FROM (SELECT unnest(cells) AS c FROM alerts WHERE alert_id % 4 <> 0) a WHERE list_contains(s.cells, a.c))"))
def alerts_here(spark, d):
    """Subscriptions whose fence has a cell under an active alert; distinct cells of alerts are met, not alerts."""
    a = V.alerts(spark, d).filter("alert_id % 4 <> 0").select(F.explode("cells").alias("c")).distinct()
    s = V.subscriptions(spark, d).select("subscription_id", F.explode("cells").alias("c"))
    return s.join(a, "c", "left_semi").select("subscription_id").distinct()


@query(
    "station_overview",
    oracle(
        ["stations", "readings", "forecasts"],
        "SELECT s.station_id, s.variable, CASE WHEN abs(s.z) >= 3 THEN round(s.z, 3) END AS anomaly, coalesce(r.n, 0) AS readings, f.level AS forecast FROM stations s LEFT JOIN r USING (variable) LEFT JOIN f ON f.station = s.station_id % 2 AND s.variable = 'water_level'",
        r=f"SELECT variable, count(*) AS n FROM readings WHERE t >= (SELECT max(t) FROM readings) - {S.DAY} GROUP BY ALL",
        f="SELECT station, list_max(list_transform(points, lambda p: p.level)) AS level FROM forecasts QUALIFY row_number() OVER (PARTITION BY station ORDER BY issued DESC, forecast_id DESC) = 1",
    ),
)
def station_overview(spark, d):
    """Stations with their anomaly if it is one, the readings of a day, and the highest level that is forecast."""
    n = recent(V.readings(spark, d), 24).groupBy("variable").agg(F.count("*").alias("n"))
    f = R.first_of(V.forecasts(spark, d), ["station"], [F.desc("issued"), F.desc("forecast_id")]).select("station", F.array_max(F.transform("points", lambda p: p["level"])).alias("level"))
    s = V.stations(spark, d).withColumn("station", F.col("station_id") % 2)
    joined = s.join(F.broadcast(n), "variable", "left").join(F.broadcast(f), "station", "left")
    level = F.when(F.col("variable") == "water_level", F.col("level"))
    return joined.select("station_id", "variable", F.when(F.abs("z") >= 3, F.round("z", 3)).alias("anomaly"), F.coalesce("n", F.lit(0)).alias("readings"), level.alias("forecast"))


@query("deliveries_listed", oracle(["subscriptions"], "SELECT o_orderkey AS delivery_id, s.min_rank::BIGINT AS min_rank, CASE WHEN s.subscription_id IS NULL THEN 'unknown' ELSE 'known' END AS target FROM orders LEFT JOIN (SELECT * FROM subscriptions WHERE subscription_id % 5 <> 0) s ON s.subscription_id = o_custkey ORDER BY o_orderkey DESC LIMIT 200"))
def deliveries_listed(spark, d):
    """The newest deliveries with their subscription, if it is still there. The limit comes before the join."""
    top = R.newest(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("delivery_id"), F.col("o_custkey").alias("subscription_id")), 200, ["delivery_id"])
    s = V.subscriptions(spark, d).filter("subscription_id % 5 <> 0").select("subscription_id", "min_rank")
    joined = s.join(F.broadcast(top), "subscription_id", "right")  # 200 rows
    return joined.select("delivery_id", "min_rank", F.when(F.col("min_rank").isNull(), "unknown").otherwise("known").alias("target"))


@query("alerts_window", oracle(["alerts"], "SELECT string_agg(alert_id::VARCHAR, ',' ORDER BY alert_id) FILTER (WHERE alert_id >= 5 AND alert_id < 15) AS issued, count(*) FILTER (WHERE alert_id % 4 <> 0) AS active FROM alerts"))
def alerts_window(spark, d):
    """Alerts issued in a period, in order, and how many are active now: one pass."""
    issued = F.when((F.col("alert_id") >= 5) & (F.col("alert_id") < 15), F.col("alert_id"))
    ids = F.array_join(F.sort_array(F.collect_list(issued)).cast("array<string>"), ",")
    return V.alerts(spark, d).agg(ids.alias("issued"), F.count_if(F.col("alert_id") % 4 != 0).alias("active"))


@query(
    "sitrep_full",
    oracle(
        ["reports", "requests", "shelters", "alerts", "audit_events", "checkins"],
        """SELECT *, sha256('{"active_alerts":' || active_alerts || ',"audit_entries":' || audit_entries || ',"need_help":' || need_help || ',"open_requests":' || open_requests || ',"reports":' || reports || ',"shelters":' || shelters || ',"verified":' || verified || '}') AS digest FROM
        (SELECT (SELECT count(*) FROM w) AS reports, (SELECT count(*) FROM w WHERE status = 'verified') AS verified, (SELECT count(*) FROM requests WHERE status = 'open') AS open_requests, (SELECT count(*) FROM shelters WHERE status = 'open') AS shelters,
        (SELECT count(*) FROM alerts WHERE alert_id % 4 <> 0) AS active_alerts, (SELECT count(*) FROM audit_events) AS audit_entries, (SELECT count(DISTINCT person) FROM checkins WHERE status = 'need_help') AS need_help)""",
        w=f"SELECT * FROM reports WHERE t >= (SELECT max(t) FROM reports) - {S.DAY}",
    ),
)
def sitrep_full(spark, d):
    """All sections of a situation report in one row, and the digest of its canonical form."""
    out = recent(V.reports(spark, d), 24).agg(F.count("*").alias("reports"), F.count_if(F.col("status") == "verified").alias("verified"))
    sections = [
        V.requests(spark, d).agg(F.count_if(F.col("status") == "open").alias("open_requests")),
        V.shelters(spark, d).agg(F.count_if(F.col("status") == "open").alias("shelters")),
        V.alerts(spark, d).agg(F.count_if(F.col("alert_id") % 4 != 0).alias("active_alerts")),
        V.audit_events(spark, d).agg(F.count("*").alias("audit_entries")),
        V.checkins(spark, d).filter("status = 'need_help'").agg(F.countDistinct("person").alias("need_help")),
    ]
    for s in sections:
        out = out.crossJoin(F.broadcast(s))  # one row each
    return out.withColumn("digest", F.sha2(C.canonical(**{c: F.col(c) for c in out.columns}), 256))


@query("anomaly_current", oracle(["readings"], f"SELECT station_id, variable, (n.now - l.t) > {2 * S.HOUR} AS stale, CASE WHEN (n.now - l.t) <= {2 * S.HOUR} AND s.n >= 30 AND s.sd > 1e-9 THEN round((l.value - s.m) / s.sd, 4) END AS z FROM latest l LEFT JOIN stats s USING (station_id, variable), n",
    latest="SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY station_id, variable ORDER BY t DESC, event_id DESC) = 1",
    stats=f"SELECT station_id, variable, count(*) AS n, avg(r.value) AS m, stddev_pop(r.value) AS sd FROM readings r JOIN latest l USING (station_id, variable) WHERE r.t >= l.t - {7 * S.DAY} AND r.t < l.t GROUP BY ALL",
    n="SELECT max(t) AS now FROM readings"))
def anomaly_current(spark, d):
    """Each series' newest score; a series that has been silent for two hours has none."""
    r = V.readings(spark, d)
    s = S.latest_scores(r, ["station_id", "variable"]).crossJoin(F.broadcast(r.agg(F.max("t").alias("now"))))
    stale = F.col("now") - F.col("t") > 2 * S.HOUR
    return s.select("station_id", "variable", stale.alias("stale"), F.when(~stale, F.round("z", 4)).alias("z"))


@query("propagation_rates", oracle(["reports"], f"SELECT h, count(*) AS cells, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 4) AS rate FROM (SELECT f.id, h, r + f.row AS row, EXISTS (SELECT 1 FROM reports x WHERE x.row = f.row + r AND x.col = f.col AND x.t > f.t + (h - 1) * {S.HOUR} AND x.t <= f.t + h * {S.HOUR}) AS hit FROM reports f, range(1, 4) hh(h), (VALUES (-1), (1)) rr(r) WHERE f.status = 'corroborated') GROUP BY h"))
def propagation_rates(spark, d):
    """Of the cells north and south of each corroborated report, the share that got a report in each of the next hours."""
    r = V.reports(spark, d)
    f = r.filter("status = 'corroborated'").select("id", "t", F.explode(F.array(F.col("row") - 1, F.col("row") + 1)).alias("row"), "col")
    n = f.agg(F.count("*").alias("cells"))
    bin_of = lambda x: F.floor(x / (3 * S.HOUR))
    near = f.withColumn("bin", F.explode(F.array(bin_of(F.col("t")), bin_of(F.col("t")) + 1)))
    times = r.select("row", "col", F.col("t").alias("rt"), bin_of(F.col("t")).alias("bin"))
    ahead = F.ceil((F.col("rt") - F.col("t")) / S.HOUR)
    met = near.join(times, ["row", "col", "bin"]).filter((F.col("rt") > F.col("t")) & (F.col("rt") <= F.col("t") + 3 * S.HOUR))
    hits = met.select("id", "row", ahead.alias("h")).distinct().groupBy("h").agg(F.count("*").alias("hits"))
    hours = spark.range(1, 4).select(F.col("id").alias("h"))
    out = hours.join(hits, "h", "left").crossJoin(F.broadcast(n)).select("h", "cells", F.coalesce("hits", F.lit(0)).alias("hits"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("cells"), 4))


@query("forecast_pick", oracle(["forecasts"], "SELECT station, forecast_id, p.hours, p.level FROM (SELECT *, unnest(points) AS p FROM (SELECT * FROM (SELECT * FROM forecasts ORDER BY issued DESC, forecast_id DESC LIMIT 50) QUALIFY row_number() OVER (PARTITION BY station ORDER BY issued DESC, forecast_id DESC) = 1)) QUALIFY row_number() OVER (PARTITION BY station ORDER BY abs(p.hours - 2.4), p.hours) = 1"))
def forecast_pick(spark, d):
    """The newest forecast of each station among the newest fifty of all, and its point nearest to 2.4 hours ahead."""
    top = R.newest(V.forecasts(spark, d), 50, ["issued", "forecast_id"])
    one = R.first_of(top, ["station"], [F.desc("issued"), F.desc("forecast_id")])
    point = F.array_min(F.transform("points", lambda p: F.struct(F.abs(p["hours"] - 2.4).alias("far"), p["hours"].alias("hours"), p["level"].alias("level"))))
    return one.select("station", "forecast_id", point.alias("p")).select("station", "forecast_id", "p.hours", "p.level")


@query("alert_per_incident", oracle([], "SELECT o_custkey AS incident, max(o_orderkey) AS alert_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL"))
def alert_per_incident(spark, d):
    o = V.table(spark, d, "orders").filter("o_orderstatus <> 'F'")
    return o.groupBy(F.col("o_custkey").alias("incident")).agg(F.max("o_orderkey").alias("alert_id"))


@query("queue_due", oracle([], "SELECT id FROM (SELECT o_orderkey AS id, o_orderkey % 9 AS attempts, epoch_us(o_orderdate) AS last, (SELECT max(epoch_us(o_orderdate)) FROM orders) AS now FROM orders WHERE o_orderkey % 9 < 8) WHERE attempts = 0 OR now - last >= least(900000.0, 5000 * pow(2.0, greatest(0, attempts - 1))) * 1000 ORDER BY last, id LIMIT 100"))
def queue_due(spark, d):
    """Pending items whose wait is over, the oldest hundred."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).alias("attempts"), V.micros("o_orderdate").alias("last"))
    now = o.agg(F.max("last").alias("now"))
    due = (F.col("attempts") == 0) | (F.col("now") - F.col("last") >= scoring.backoff_ms(F.col("attempts")) * 1000)
    return o.crossJoin(F.broadcast(now)).filter((F.col("attempts") < 8) & due).orderBy("last", "id").limit(100).select("id")


@query("flooded_live", oracle(["readings", "elevation"], f"SELECT l.station_id, count(e.cell) AS cells FROM l LEFT JOIN elevation e ON l.fresh AND e.elevation_m <= l.level GROUP BY ALL", l=f"SELECT station_id, arg_max(value, (t, event_id)) / 20 AS level, max(t) >= (SELECT max(t) FROM readings) - {2 * S.HOUR} AS fresh FROM readings WHERE variable = 'water_level' GROUP BY ALL"))
def flooded_live(spark, d):
    """How many cells lie under each gauge's newest level; none where the gauge has been silent for two hours."""
    r = V.readings(spark, d)
    now = r.agg(F.max("t").alias("now"))
    last = r.filter("variable = 'water_level'").groupBy("station_id").agg(F.max(F.struct("t", "event_id", "value")).alias("x"))
    level = last.crossJoin(F.broadcast(now)).select("station_id", F.when(F.col("x.t") >= F.col("now") - 2 * S.HOUR, F.col("x.value") / 20).alias("level"))
    heights = V.elevation(spark, d).groupBy("elevation_m").agg(F.count("*").alias("n"))
    met = level.join(F.broadcast(heights), F.col("elevation_m") <= F.col("level"), "left")  # a few heights
    return met.groupBy("station_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"))


@query("corroborated", oracle(["reports", "stations", "advisories"], "SELECT r.id, r.status AS before, CASE WHEN r.status = 'new' AND c.confidence >= 0.6 AND c.has_evidence THEN 'corroborated' ELSE r.status END AS after FROM reports r JOIN c USING (id) WHERE r.status <> CASE WHEN r.status = 'new' AND c.confidence >= 0.6 AND c.has_evidence THEN 'corroborated' ELSE r.status END", **CR._CONF_CTES, c=CR._CONFIDENCE))
def corroborated(spark, d):
    """New reports that scoring makes corroborated: confidence of 0.6, and outside evidence of one kind at least. Each is
    a change that leaves an audit entry."""
    c = CR.confidence(spark, d).join(V.reports(spark, d).select("id", F.col("status").alias("before")), "id")
    gate = (F.col("before") == "new") & (F.col("confidence") >= 0.6) & F.col("has_evidence")
    return c.filter(gate).select("id", "before", F.lit("corroborated").alias("after"))


@query("moderation", oracle(["reports"], "SELECT reporter_id, count(*) AS decided, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'verified' OR source = 0) AS training FROM reports WHERE status IN ('verified', 'rejected') GROUP BY ALL"))
def moderation(spark, d):
    """What analysts' decisions leave with each reporter: counters, and rows for training."""
    r = V.reports(spark, d).filter("status IN ('verified', 'rejected')").groupBy("reporter_id")
    yes, no = F.col("status") == "verified", F.col("status") == "rejected"
    return r.agg(F.count("*").alias("decided"), F.count_if(yes).alias("verified"), F.count_if(no).alias("rejected"), F.count_if(yes | (F.col("source") == 0)).alias("training"))


@query("alerts_expired", oracle([], f"SELECT o_orderkey AS alert_id, CASE WHEN o_orderstatus = 'O' AND epoch_us(o_orderdate) + 30 * {S.DAY} < (SELECT max(epoch_us(o_orderdate)) FROM orders) THEN 'expired' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'cancelled' END AS status FROM orders"))
def alerts_expired(spark, d):
    """An analyst's warnings end when their time is over; those that were cancelled stay so."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("alert_id"), "o_orderstatus", V.micros("o_orderdate").alias("t"))
    now = o.agg(F.max("t").alias("now"))
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("t") + 30 * S.DAY < F.col("now")), "expired").when(F.col("o_orderstatus") == "O", "active").otherwise("cancelled")
    return o.crossJoin(F.broadcast(now)).select("alert_id", status.alias("status"))


_FIRST = "SELECT embedding FROM embeddings WHERE label = 0 ORDER BY vec_id LIMIT 1"


@query("classify_switch", oracle([], "SELECT d.doc_id, CASE WHEN s >= 0.35 THEN 'prototype' WHEN k.hits > 0 THEN 'keyword' ELSE 'none' END AS mode, CASE WHEN s >= 0.35 THEN 'coastal_flooding' WHEN k.hits > 0 THEN k.hazard END AS hazard_type FROM documents d LEFT JOIN (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], p::DOUBLE[]) AS s FROM embeddings, (" + _FIRST.replace("embedding FROM", "embedding AS p FROM") + ")) e ON e.vec_id = d.doc_id JOIN (SELECT doc_id, best.hits AS hits, best.hazard AS hazard FROM (SELECT doc_id, list_max([" + ", ".join("{'hits': " + " + ".join(f"contains(lower(coalesce(text, '')), '{w.lower()}')::INT" for w in ws) + f", 'back': {-i}, 'hazard': '{k}'" + "}" for i, (k, ws) in enumerate(fixed.KEYWORDS.items())) + "]) AS best FROM documents)) k USING (doc_id)"))
def classify_switch(spark, d):
    """By prototype where a text's vector is near enough to one, else by keywords, else not at all."""
    e = V.table(spark, d, "embeddings")
    first = e.filter("label = 0").groupBy().agg(F.min_by("embedding", "vec_id").alias("p"))
    near = e.crossJoin(F.broadcast(first)).select(F.col("vec_id").alias("doc_id"), cosine(F.col("embedding"), F.col("p")).alias("s"))
    hazard, hits = text.classify(F.col("text"))
    docs = V.table(spark, d, "documents").select("doc_id", hazard.alias("word"), hits.alias("hits")).join(near, "doc_id", "left")
    by_vector = F.coalesce(F.col("s") >= 0.35, F.lit(False))
    return docs.select("doc_id", F.when(by_vector, "prototype").when(F.col("hits") > 0, "keyword").otherwise("none").alias("mode"), F.when(by_vector, "coastal_flooding").when(F.col("hits") > 0, F.col("word")).alias("hazard_type"))


@query("narratives_moderated", oracle(["narratives"], "SELECT narrative_id, CASE WHEN status = 'draft' AND narrative_id % 5 = 0 THEN 'approved' WHEN status = 'draft' AND narrative_id % 5 = 1 THEN 'dismissed' ELSE status END AS status, status = 'draft' AND narrative_id % 5 < 2 AS applied FROM narratives"))
def narratives_moderated(spark, d):
    """Approvals and dismissals: each only of drafts, so a second command on the same one does nothing."""
    n = V.narratives(spark, d).select("narrative_id", "status")
    approve, dismiss = (n.filter(f"narrative_id % 5 = {k}").select("narrative_id") for k in (0, 1))
    one = R.guarded(n, approve, "narrative_id", "draft", "approved").withColumnRenamed("applied", "first")
    two = R.guarded(one, dismiss, "narrative_id", "draft", "dismissed")
    return two.select("narrative_id", "status", (F.col("first") | F.col("applied")).alias("applied"))


@query("damage_reviewed", oracle(["damages"], "SELECT id, CASE WHEN status = 'pending' AND id % 6 = 1 THEN 'reviewed' ELSE status END AS status, status = 'pending' AND id % 6 = 1 AS applied FROM damages"))
def damage_reviewed(spark, d):
    t = V.damages(spark, d).select("id", "status")
    return R.guarded(t, t.filter("id % 6 = 1").select("id"), "id", "pending", "reviewed")


@query("shelter_routes", oracle(["reports", "shelters"], "SELECT row, col, shelter_id, round(d, 3) AS distance_km FROM p QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d, shelter_id) = 1", spots="SELECT DISTINCT row, col, lat, lon FROM reports", p=f"SELECT r.row, r.col, s.shelter_id, {km('r.lat', 'r.lon', 's.lat', 's.lon')} AS d FROM spots r, shelters s WHERE s.status = 'open' AND coalesce(s.capacity, 1) > 0"))
def shelter_routes(spark, d):
    """The nearest open shelter of each place; one whose capacity isn't known counts as free."""
    spots = V.reports(spark, d).select("row", "col", "lat", "lon").distinct().withColumn("key", F.struct("row", "col"))
    s = V.shelters(spark, d).filter("status = 'open' AND coalesce(capacity, 1) > 0").withColumnsRenamed({"lat": "slat", "lon": "slon"})
    near = P.nearest(spots, s, "key", "shelter_id", side=0.05, at=("lat", "lon", "slat", "slon"))
    return near.select(F.col("key.row").cast("long").alias("row"), F.col("key.col").cast("long").alias("col"), "shelter_id", F.round("distance_km", 3).alias("distance_km"))


@query("voice_menu", oracle([], "SELECT o_orderkey AS call, ['" + "', '".join(n.replace("'", "''") for n, *_ in fixed.LANDMARKS) + "'][o_orderkey % 7] AS landmark, CASE o_orderkey % 5 WHEN 1 THEN 'en' WHEN 2 THEN 'hi' WHEN 3 THEN 'ta' END AS lang FROM orders"))
def voice_menu(spark, d):
    """What callers' digits stand for: the landmark and the language at that place of the menu; other digits give none."""
    place = lambda values, digit: F.get(F.array(*map(F.lit, values)), digit - 1)
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders")
    return o.select(k.alias("call"), place([n for n, *_ in fixed.LANDMARKS], (k % 7).cast("int")).alias("landmark"), place(["en", "hi", "ta"], (k % 5).cast("int")).alias("lang"))


@query("zones_nearest", oracle([], "SELECT s_suppkey AS zone, s_nationkey AS sector, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS place FROM supplier WHERE s_suppkey % 4 <> 0"))
def zones_nearest(spark, d):
    """Zones that are still valid, the nearest of each sector first."""
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    s = V.table(spark, d, "supplier").filter("s_suppkey % 4 <> 0")
    return s.select(F.col("s_suppkey").alias("zone"), F.col("s_nationkey").alias("sector"), F.row_number().over(w).cast("long").alias("place"))


@query("session_reports", oracle([], "SELECT conv_id, count(*) AS messages, max(CASE WHEN role = 'user' THEN turn END) AS last_user_turn, max(turn) >= 3 AS complete FROM conversations GROUP BY ALL"))
def session_reports(spark, d):
    """Sessions folded to what a report is made of; complete ones become reports."""
    c = V.table(spark, d, "conversations").groupBy("conv_id")
    return c.agg(F.count("*").alias("messages"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"), (F.max("turn") >= 3).alias("complete"))
