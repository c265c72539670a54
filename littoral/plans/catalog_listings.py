"""Registered queries that list what is stored: newest first, filtered, with what belongs to each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scoring
from ..functions.geo import cell_centre, cell_ring
from ..operators import reports as R
from ..operators import series as S
from ..operators import spatial as P
from . import views as V
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


def recent(df, hours: int, t: str = "t"):
    """Rows of the last hours before the newest row of all."""
    now = df.agg(F.max(t).alias("_now"))
    return df.crossJoin(F.broadcast(now)).filter(F.col(t) >= F.col("_now") - hours * S.HOUR).drop("_now")


def _since(view: str, hours: int, t: str = "t") -> str:
    return f"{t} >= (SELECT max({t}) FROM {view}) - {hours * S.HOUR}"


def ids_of(column: str):
    return F.array_join(F.sort_array(F.collect_list(column)).cast("array<string>"), ",")


_ACTIVE = "SELECT * FROM alerts WHERE alert_id % 4 <> 0 AND len(cells) > 0"


@query("alerts_public", oracle(["alerts"], "SELECT alert_id, cell, k::INT AS k, round(CASE k WHEN 1 THEN cell + 1 WHEN 2 THEN cell + 1 ELSE cell END * 0.01::DOUBLE, 6) AS lon, round((1300 + CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END) * 0.01::DOUBLE, 6) AS lat FROM (SELECT alert_id, unnest(cells) AS cell FROM a), range(5) r(k)", a=_ACTIVE))
def alerts_public(spark, d):
    """Outlines of the cells of active alerts that have any."""
    a = V.alerts(spark, d).filter("alert_id % 4 <> 0").filter(F.size("cells") > 0).select("alert_id", F.explode("cells").alias("cell"))
    return a.select("alert_id", "cell", F.posexplode(cell_ring(F.lit(1300), F.col("cell"), 0.01)).alias("k", "p")).select("alert_id", "cell", "k", "p.lon", "p.lat")


@query("alerts_newest", oracle(["alerts"], "SELECT alert_id, tier_rank::BIGINT AS tier_rank, len(cells)::INT AS cells FROM alerts ORDER BY alert_id DESC LIMIT 20"))
def alerts_newest(spark, d):
    return R.newest(V.alerts(spark, d), 20, ["alert_id"]).select("alert_id", F.col("tier_rank").cast("long").alias("tier_rank"), F.size("cells").alias("cells"))


@query("alerts_feed", oracle(["alerts"], "SELECT '<feed>' || string_agg('<entry><id>alert-' || alert_id || '</id><category term=\"' || ['advisory', 'watch', 'warning'][tier_rank + 1] || '\"/></entry>', '' ORDER BY alert_id DESC) || '</feed>' AS feed FROM a", a=_ACTIVE))
def alerts_feed(spark, d):
    """Active alerts as one Atom document; active alerts are few."""
    a = V.alerts(spark, d).filter("alert_id % 4 <> 0").filter(F.size("cells") > 0)
    tier = F.array(*map(F.lit, ["advisory", "watch", "warning"]))[F.col("tier_rank").cast("int")]
    entry = F.concat(F.lit("<entry><id>alert-"), F.col("alert_id").cast("string"), F.lit('</id><category term="'), tier, F.lit('"/></entry>'))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("alert_id", entry.alias("e"))), False), lambda x: x["e"])
    return a.agg(F.concat(F.lit("<feed>"), F.array_join(entries, ""), F.lit("</feed>")).alias("feed"))


@query("advisories_newest", oracle(["advisories"], "SELECT advisory_id, hazard_type, certainty, radius_km FROM advisories ORDER BY advisory_id DESC LIMIT 10"))
def advisories_newest(spark, d):
    return R.newest(V.advisories(spark, d), 10, ["advisory_id"]).select("advisory_id", "hazard_type", "certainty", "radius_km")


_MEDIA = "SELECT o_orderkey AS media_id, o_orderkey % 3000 AS id FROM orders"


@query("reports_listed", oracle(["reports"], "SELECT n.id, n.t, n.hazard_type, coalesce(m.media, '') AS media, p.filed FROM n LEFT JOIN (SELECT id, string_agg(media_id::VARCHAR, ',' ORDER BY media_id) AS media FROM m GROUP BY id) m USING (id) JOIN p USING (reporter_id)", m=_MEDIA, p="SELECT reporter_id, count(*) AS filed FROM reports GROUP BY ALL", n="SELECT * FROM reports WHERE status = 'verified' ORDER BY t DESC, id DESC LIMIT 200"))
def reports_listed(spark, d):
    """The newest verified reports, each with its media and its reporter's number of reports. The limit comes first, so
    only what is listed is looked up."""
    r = V.reports(spark, d)
    top = R.newest(r.filter("status = 'verified'"), 200, ["t", "id"])
    listed = F.broadcast(top.select("id", "t", "hazard_type", "reporter_id"))  # 200 rows
    media = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), (F.col("o_orderkey") % 3000).alias("id"))
    shown = media.join(listed.select("id"), "id", "left_semi").groupBy("id").agg(ids_of("media_id").alias("media"))
    filed = r.join(listed.select("reporter_id"), "reporter_id", "left_semi").groupBy("reporter_id").agg(F.count("*").alias("filed"))
    return top.select("id", "t", "hazard_type", "reporter_id").join(shown, "id", "left").join(filed, "reporter_id").select("id", "t", "hazard_type", F.coalesce("media", F.lit("")).alias("media"), "filed")


@query("incidents_listed", oracle(["reports"], "SELECT hazard_type, row, max(t) AS last_seen, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS reports FROM reports GROUP BY ALL ORDER BY last_seen DESC, hazard_type, row LIMIT 20"))
def incidents_listed(spark, d):
    """The newest incidents with their reports: first which, then what belongs to them."""
    r = V.reports(spark, d).withColumn("row", F.col("row").cast("long"))
    top = r.groupBy("hazard_type", "row").agg(F.max("t").alias("last_seen"), F.count("*").alias("n")).orderBy(F.desc("last_seen"), "hazard_type", "row").limit(20)
    nested = r.join(F.broadcast(top), ["hazard_type", "row"]).groupBy("hazard_type", "row", "last_seen", "n")  # 20 incidents
    return nested.agg(ids_of("id").alias("reports"))


@query("incidents_public", oracle(["reports"], f"SELECT hazard_type, row, col, max(t) AS last_seen, round((row + 0.5::DOUBLE) * 0.01::DOUBLE, 6) AS lat, round((col + 0.5::DOUBLE) * 0.01::DOUBLE, 6) AS lon FROM reports WHERE status = 'verified' AND {_since('reports', 48)} GROUP BY hazard_type, row, col ORDER BY last_seen DESC, hazard_type, row, col LIMIT 200"))
def incidents_public(spark, d):
    """Verified incidents of two days, the newest 200, placed at their cells' middles."""
    r = recent(V.reports(spark, d), 48).filter("status = 'verified'").select("hazard_type", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "t")
    g = r.groupBy("hazard_type", "row", "col").agg(F.max("t").alias("last_seen")).orderBy(F.desc("last_seen"), "hazard_type", "row", "col").limit(200)
    lat, lon = cell_centre(F.col("row"), F.col("col"), 0.01)
    return g.select("*", lat.alias("lat"), lon.alias("lon"))


@query("audit_newest", oracle(["audit_events"], "SELECT id, subject, sha256(envelope) AS digest FROM audit_events WHERE subject % 2 = 0 ORDER BY id DESC LIMIT 200"))
def audit_newest(spark, d):
    return R.newest(V.audit_events(spark, d).filter("subject % 2 = 0"), 200, ["id"]).select("id", "subject", F.sha2("envelope", 256).alias("digest"))


@query("forecasts_newest", oracle(["forecasts"], "SELECT forecast_id, issued, list_max(list_transform(points, lambda p: p.level)) AS highest FROM forecasts WHERE station = 1 ORDER BY issued DESC, forecast_id DESC LIMIT 200"))
def forecasts_newest(spark, d):
    top = R.newest(V.forecasts(spark, d).filter("station = 1"), 200, ["issued", "forecast_id"])
    return top.select("forecast_id", "issued", F.array_max(F.transform("points", lambda p: p["level"])).alias("highest"))


@query("narratives_newest", oracle(["narratives"], "SELECT narrative_id, hazard_type, status, n FROM narratives ORDER BY narrative_id DESC LIMIT 200"))
def narratives_newest(spark, d):
    return R.newest(V.narratives(spark, d), 200, ["narrative_id"]).select("narrative_id", "hazard_type", "status", "n")


@query("checkins_recent", oracle(["checkins"], f"SELECT id, person, t FROM checkins WHERE {_since('checkins', 24 * 30)} AND status = 'need_help'"))
def checkins_recent(spark, d):
    return recent(V.checkins(spark, d), 24 * 30).filter("status = 'need_help'").select("id", "person", "t")


_KIND = "CASE WHEN water >= 0.35 THEN 'flooding' WHEN edges >= 0.18 THEN 'structural_or_debris' ELSE 'minor_or_none' END"


@query("damage_recent", oracle(["damages"], f"SELECT id, t, status, {_KIND} AS kind FROM damages WHERE {_since('damages', 24 * 30)}"))
def damage_recent(spark, d):
    kind, _, _ = scoring.damage(F.col("water"), F.col("edges"))
    return recent(V.damages(spark, d), 24 * 30).select("id", "t", "status", kind.alias("kind"))


@query("damage_features", oracle(["damages"], f"SELECT id, {_KIND} AS kind, round((row + 0.5::DOUBLE) * 0.01::DOUBLE, 6) AS lat, round((col + 0.5::DOUBLE) * 0.01::DOUBLE, 6) AS lon FROM damages WHERE {_since('damages', 24 * 90)} AND {_KIND} <> 'minor_or_none'"))
def damage_features(spark, d):
    """Real damage of the last ninety days, placed at its cell's middle: the exact place isn't shown."""
    kind, _, _ = scoring.damage(F.col("water"), F.col("edges"))
    lat, lon = cell_centre(F.col("row"), F.col("col"), 0.01)
    return recent(V.damages(spark, d), 24 * 90).select("id", kind.alias("kind"), lat.alias("lat"), lon.alias("lon")).filter("kind <> 'minor_or_none'")


@query("requests_open", oracle(["requests"], "SELECT id, category FROM requests WHERE status = 'open' ORDER BY id DESC LIMIT 500"))
def requests_open(spark, d):
    return R.newest(V.requests(spark, d).filter("status = 'open'"), 500, ["id"]).select("id", "category")


@query("offers_open", oracle(["offers"], "SELECT offer_id, category FROM offers WHERE offer_id % 4 <> 0 ORDER BY offer_id DESC LIMIT 500"))
def offers_open(spark, d):
    return R.newest(V.offers(spark, d).filter("offer_id % 4 <> 0"), 500, ["offer_id"]).select("offer_id", "category")


@query("missing_open", oracle(["persons"], "SELECT id, name FROM persons WHERE matched_id IS NULL AND kind = 1"))
def missing_open(spark, d):
    return V.persons(spark, d).filter("matched_id IS NULL AND kind = 1").select("id", "name")


@query("shelters_listed", oracle(["shelters"], "SELECT shelter_id, name, capacity FROM shelters WHERE status = 'open'"))
def shelters_listed(spark, d):
    return V.shelters(spark, d).filter("status = 'open'").orderBy("name").select("shelter_id", "name", "capacity")


@query("shelter_features", oracle(["shelters"], "SELECT shelter_id, status, lon, lat FROM shelters"))
def shelter_features(spark, d):
    return V.shelters(spark, d).select("shelter_id", "status", "lon", "lat")


@query("shelter_summary", oracle(["shelters"], "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, sum(capacity) FILTER (WHERE status = 'open')::BIGINT AS capacity, count(*) FILTER (WHERE status = 'open' AND capacity IS NULL) AS unknown FROM shelters"))
def shelter_summary(spark, d):
    opened = F.col("status") == "open"
    return V.shelters(spark, d).agg(F.count("*").alias("total"), F.count_if(opened).alias("open"), F.sum(F.when(opened, F.col("capacity"))).alias("capacity"), F.count_if(opened & F.col("capacity").isNull()).alias("unknown"))


@query("narrative_candidates", oracle(["reports"], f"SELECT r.id, r.hazard_type FROM reports r JOIN embeddings e ON e.vec_id = r.id JOIN documents x ON x.doc_id = r.id WHERE r.{_since('reports', 12)} AND trim(x.text) <> ''"))
def narrative_candidates(spark, d):
    """Reports of twelve hours that have a text and its vector."""
    r = recent(V.reports(spark, d), 12)
    e = V.table(spark, d, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"))
    x = V.table(spark, d, "documents").filter("trim(text) <> ''").select(F.col("doc_id").alias("id"))
    return r.join(e, "id", "left_semi").join(x, "id", "left_semi").select("id", "hazard_type")


@query("flooded_gate", oracle(["advisories", "elevation"], "SELECT a.advisory_id, count(e.cell) AS cells FROM advisories a LEFT JOIN elevation e ON a.hazard_type IN ('coastal_flooding', 'storm_surge', 'high_waves', 'tsunami') AND e.elevation_m <= 1.5 GROUP BY ALL"))
def flooded_gate(spark, d):
    """Flooded cells go with an alert only if the water level bears on its hazard."""
    wet = [k for k, variables, *_ in fixed.HAZARDS if "water_level" in variables]
    n = V.elevation(spark, d).filter("elevation_m <= 1.5").agg(F.count("*").alias("n"))
    a = V.advisories(spark, d).crossJoin(F.broadcast(n))
    return a.select("advisory_id", F.when(F.col("hazard_type").isin(*wet), F.col("n")).otherwise(0).alias("cells"))


@query(
    "station_reading",
    oracle(
        ["reports", "stations", "readings"],
        "SELECT row, col, station_id, round(d, 2) <= 25 AS is_local, variable, l.value AS latest, abs(z) >= 3 AS anomalous FROM n JOIN l USING (variable)",
        spots="SELECT DISTINCT row, col, lat, lon FROM reports",
        n=f"SELECT r.row, r.col, s.station_id, s.variable, s.z, {km('r.lat', 'r.lon', 's.slat', 's.slon')} AS d FROM spots r, stations s QUALIFY row_number() OVER (PARTITION BY r.row, r.col ORDER BY d, s.station_id) = 1",
        l="SELECT variable, arg_max(value, (t, event_id)) AS value FROM readings GROUP BY ALL",
    ),
)
def station_reading(spark, d):
    """The station nearest to each place, whether it is local, the latest value of what it measures, and its anomaly."""
    spots = V.reports(spark, d).select("row", "col", "lat", "lon").distinct().withColumn("key", F.struct("row", "col"))
    s = V.stations(spark, d)
    near = P.nearest(spots, s, "key", "station_id", side=0.05, at=("lat", "lon", "slat", "slon")).join(s.select("station_id", "variable", "z"), "station_id")
    latest = V.readings(spark, d).groupBy("variable").agg(F.max(F.struct("t", "event_id", "value"))["value"].alias("latest"))
    local = F.round("distance_km", 2) <= 25
    return near.join(F.broadcast(latest), "variable").select(F.col("key.row").cast("long").alias("row"), F.col("key.col").cast("long").alias("col"), "station_id", local.alias("is_local"), "variable", "latest", (F.abs("z") >= 3).alias("anomalous"))


@query("class_counts", oracle([], "SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 2"))
def class_counts(spark, d):
    return V.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).filter("n >= 2")


@query("outbox", oracle(["checkins"], "SELECT person, id, row_number() OVER (PARTITION BY person ORDER BY t DESC, id DESC) AS place FROM checkins"))
def outbox(spark, d):
    """Each client's waiting items, the newest observation first."""
    from pyspark.sql import Window

    w = Window.partitionBy("person").orderBy(F.desc("t"), F.desc("id"))
    return V.checkins(spark, d).select("person", "id", F.row_number().over(w).cast("long").alias("place"))


@query("hazard_menu", oracle([], "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{x}')" for i, (k, *_, x) in enumerate(fixed.HAZARDS)) + ") AS m(digit, hazard_type, label)"))
def hazard_menu(spark, d):
    """The registry in order: what a digit or a menu entry stands for, and its label; a hazard without one is named by its key."""
    rows = spark.createDataFrame([(i, k, label) for i, (k, *_, label) in enumerate(fixed.HAZARDS)], "digit int, hazard_type string, label string")
    return rows.withColumn("label", F.coalesce("label", F.initcap(F.replace("hazard_type", F.lit("_"), F.lit(" ")))))


@query("hazard_choice", oracle([], "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN ['coastal_flooding', 'storm_surge', 'high_waves', 'tsunami', 'rip_current', 'oil_spill', 'algal_bloom', 'erosion', 'other'][o_orderkey % 9 + 1] WHEN o_orderkey % 3 = 1 THEN 'oil_spill' END AS choice FROM orders"))
def hazard_choice(spark, d):
    """The hazard of a list reply (hz:...), else of a typed name, else none."""
    keys = F.array(*(F.lit(k) for k, *_ in fixed.HAZARDS))
    i = F.col("o_orderkey")
    reply = F.to_json(F.struct(F.struct(F.concat(F.lit("hz:"), keys[(i % 9).cast("int")]).alias("id")).alias("list_reply")))
    o = V.table(spark, d, "orders").select(i.alias("id"), F.when(i % 3 == 0, reply).when(i % 3 == 1, F.lit('{"text": {"body": " Oil Spill "}}')).otherwise('{"text": {"body": "hello"}}').alias("message"))
    chosen = F.regexp_extract(F.get_json_object("message", "$.list_reply.id"), "^hz:(.+)$", 1)
    typed = F.replace(F.lower(F.trim(F.get_json_object("message", "$.text.body"))), F.lit(" "), F.lit("_"))
    return o.select("id", F.coalesce(*(F.when(F.array_contains(keys, x), x) for x in (chosen, typed))).alias("choice"))


@query("digest_identities", oracle([], "SELECT c_custkey, sha256('web:' || c_custkey) AS identity, sha256('https://push/' || c_custkey) AS endpoint FROM customer"))
def digest_identities(spark, d):
    k = F.col("c_custkey").cast("string")
    return V.table(spark, d, "customer").select("c_custkey", F.sha2(F.concat_ws(":", F.lit("web"), k), 256).alias("identity"), F.sha2(F.concat(F.lit("https://push/"), k), 256).alias("endpoint"))
