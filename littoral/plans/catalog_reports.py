"""Registered queries over reports, incidents, alerts and their neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..functions.geo import cell_centre, ring
from ..lineage import cut
from ..operators import density, incidents
from ..operators import kernels as K
from ..operators import reports as R
from ..operators import series as S
from ..operators import spatial as P
from ..operators.regions import with_region
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


def r4(x):
    return F.round(x, 4)


@query("report_counts", oracle(["reports"], "SELECT status, hazard_type, grouping(status, hazard_type)::BIGINT AS level, count(*) AS n FROM reports GROUP BY GROUPING SETS ((), (status), (hazard_type))"))
def report_counts(spark, d):
    return R.counts(V.reports(spark, d)).select("status", "hazard_type", F.col("level").cast("long").alias("level"), "n")


def _incident(df):
    return df.withColumn("incident", F.concat_ws("-", "hazard_type", "row"))


_INCIDENT = "SELECT *, hazard_type || '-' || row AS incident FROM reports"


@query("incident_signals", oracle(["reports"], "SELECT incident, count(DISTINCT reporter_id) AS reporters, count(*) AS n, max(value) AS strongest FROM i GROUP BY ALL", i=_INCIDENT))
def incident_signals(spark, d):
    g = _incident(V.reports(spark, d)).groupBy("incident")
    return g.agg(F.countDistinct("reporter_id").alias("reporters"), F.count("*").alias("n"), F.max("value").alias("strongest"))


@query(
    "incident_activity",
    oracle(["reports"], f"SELECT hazard_type, t // {S.DAY} AS day, count(*) AS n, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'rejected') AS rejected, mode_first AS busiest_row FROM (SELECT *, first_value(row) OVER (PARTITION BY hazard_type, t // {S.DAY} ORDER BY c DESC, row) AS mode_first FROM (SELECT *, count(*) OVER (PARTITION BY hazard_type, t // {S.DAY}, row) AS c FROM reports)) GROUP BY ALL"),
)
def incident_activity(spark, d):
    r = V.reports(spark, d).withColumn("day", F.floor(F.col("t") / S.DAY))
    rows = r.groupBy("hazard_type", "day", F.col("row").cast("long").alias("row")).agg(F.count("*").alias("c"), F.count_if(F.col("status") == "verified").alias("v"), F.count_if(F.col("status") == "rejected").alias("x"))
    return rows.groupBy("hazard_type", "day").agg(F.sum("c").alias("n"), F.sum("v").alias("verified"), F.sum("x").alias("rejected"), F.max_by("row", F.struct("c", -F.col("row"))).alias("busiest_row"))


@query("public_reports_topk", oracle(["reports"], f"SELECT id, t, hazard_type, round((row + 0.5::DOUBLE) * 0.01::DOUBLE, 6) AS lat, round((col + 0.5::DOUBLE) * 0.01::DOUBLE, 6) AS lon FROM reports WHERE status = 'verified' AND t >= (SELECT max(t) FROM reports) - {2 * S.DAY} ORDER BY t DESC, id DESC LIMIT 500"))
def public_reports_topk(spark, d):
    """The newest verified reports of two days, placed at their cells' middles."""
    r = V.reports(spark, d)
    now = r.agg(F.max("t").alias("now"))
    shown = r.filter("status = 'verified'").crossJoin(F.broadcast(now)).filter(F.col("t") >= F.col("now") - 2 * S.DAY)
    lat, lon = cell_centre(F.col("row"), F.col("col"), 0.01)
    return R.newest(shown.select("id", "t", "hazard_type", lat.alias("lat"), lon.alias("lon")), 500, ["t", "id"])


def _coherence_sql(near: str) -> str:
    return oracle(
        ["reports"],
        f"SELECT a.id, count(DISTINCT b.reporter_id) AS n FROM reports a JOIN reports b ON a.hazard_type = b.hazard_type AND {near} AND a.reporter_id <> b.reporter_id AND b.status <> 'rejected' AND abs(a.t - b.t) <= {30 * R.MINUTE} GROUP BY a.id",
    )


@query("coherence_same_cell", _coherence_sql("a.row = b.row AND a.col = b.col"))
def coherence_same_cell(spark, d):
    return R.coherence(V.reports(spark, d))


@query("coherence_ring", _coherence_sql("abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1"))
def coherence_ring(spark, d):
    return R.coherence(V.reports(spark, d), rings=1)


def _spots(spark, d):
    """Distinct places of reports."""
    return V.reports(spark, d).select("row", "col", "lat", "lon").distinct()


_SPOTS = "SELECT DISTINCT row, col, lat, lon FROM reports"


@query("radius_stations", oracle(["reports", "stations"], f"SELECT r.row, r.col, s.station_id, round({km('r.lat', 'r.lon', 's.slat', 's.slon')}, 4) AS distance_km FROM spots r JOIN stations s ON {km('r.lat', 'r.lon', 's.slat', 's.slon')} <= 25", spots=_SPOTS))
def radius_stations(spark, d):
    met = P.within_km(_spots(spark, d), V.stations(spark, d), 25.0, at=("lat", "lon", "slat", "slon"))
    return met.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "station_id", r4("distance_km").alias("distance_km"))


_ALLOWED = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, vs, *_ in fixed.HAZARDS for v in vs) + ") AS a(hazard_type, variable)"
_STRONG = f"""SELECT h.hazard_type, r.row, r.col, max(abs(s.z)) AS strongest FROM spots r JOIN stations s ON {km('r.lat', 'r.lon', 's.slat', 's.slon')} <= 25
  JOIN allowed h ON h.variable = s.variable WHERE abs(s.z) >= 3 GROUP BY ALL"""
_INSTRUMENT = "CASE WHEN s.strongest IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (s.strongest - 2.5) / 2.5)) END"


def _strongest(spark, d):
    """Largest |z| of an anomalous station within 25 km that bears on the hazard, for each hazard and place."""
    allowed = spark.createDataFrame([(k, v) for k, vs, *_ in fixed.HAZARDS for v in vs], "hazard_type string, variable string")
    near = P.within_km(_spots(spark, d), V.stations(spark, d).filter("abs(z) >= 3"), 25.0, at=("lat", "lon", "slat", "slon"))
    per_variable = near.groupBy("row", "col", "variable").agg(F.max(F.abs("z")).alias("z"))
    return per_variable.join(F.broadcast(allowed), "variable").groupBy("hazard_type", "row", "col").agg(F.max("z").alias("strongest"))


@query("instrument_score", oracle(["reports", "stations"], f"SELECT r.id, round({_INSTRUMENT}, 4) AS score FROM reports r LEFT JOIN strong s USING (hazard_type, row, col)", spots=_SPOTS, allowed=_ALLOWED, strong=_STRONG))
def instrument_score(spark, d):
    joined = V.reports(spark, d).join(_strongest(spark, d), ["hazard_type", "row", "col"], "left")
    return joined.select("id", r4(scoring.instrument(F.col("strongest"))).alias("score"))


@query("aid_matches", oracle(["requests", "offers"], f"SELECT r.id, o.offer_id, round({km('lat', 'lon', 'rlat', 'rlon')}, 2) AS distance_km FROM requests r JOIN offers o USING (category) WHERE r.status = 'open' AND {km('lat', 'lon', 'rlat', 'rlon')} <= 5"))
def aid_matches(spark, d):
    met = P.within_km_by_place(V.requests(spark, d).filter("status = 'open'"), V.offers(spark, d), 5.0, on=["category"])
    return met.select("id", "offer_id", F.round("distance_km", 2).alias("distance_km"))


@query("nearest_shelter", oracle(["reports", "stations"], "SELECT row, col, station_id, round(d, 4) AS distance_km FROM p QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d, station_id) = 1", spots=_SPOTS, p=f"SELECT r.row, r.col, s.station_id, {km('r.lat', 'r.lon', 's.slat', 's.slon')} AS d FROM spots r, stations s WHERE s.station_id % 2 = 0"))
def nearest_shelter(spark, d):
    spots = _spots(spark, d).withColumn("key", F.struct("row", "col"))
    near = P.nearest(spots, V.stations(spark, d).filter("station_id % 2 = 0"), "key", "station_id", side=0.05, at=("lat", "lon", "slat", "slon"))
    return near.select(F.col("key.row").cast("long").alias("row"), F.col("key.col").cast("long").alias("col"), "station_id", r4("distance_km").alias("distance_km"))


_MARKS = "SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', {a}, {b})" for n, a, b in fixed.LANDMARKS) + ") AS m(name, mlat, mlon)"


@query("nearest_landmark", oracle(["reports"], "SELECT row, col, name, round(d, 4) AS distance_km FROM p QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d, name) = 1", spots=_SPOTS, marks=_MARKS, p=f"SELECT row, col, name, {km('lat', 'lon', 'mlat', 'mlon')} AS d FROM spots, marks"))
def nearest_landmark(spark, d):
    near = _spots(spark, d).withColumn("m", P.nearest_of(F.col("lat"), F.col("lon"), fixed.LANDMARKS))
    return near.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("m.name").alias("name"), r4("m.d").alias("distance_km"))


_COVER = f"""SELECT hazard_type, row, col, advisory_id, certainty FROM (SELECT DISTINCT hazard_type, row, col, lat, lon FROM reports) r JOIN advisories a USING (hazard_type)
  WHERE NOT expired AND {km('lat', 'lon', 'clat', 'clon')} <= radius_km QUALIFY row_number() OVER (PARTITION BY hazard_type, row, col ORDER BY advisory_id) = 1"""


def _covered(spark, d):
    places = V.reports(spark, d).select("hazard_type", "row", "col", "lat", "lon").distinct()
    met = P.covering_circles(places, V.advisories(spark, d).filter(~F.col("expired")), ["hazard_type"])
    return met.groupBy("hazard_type", "row", "col").agg(F.min(F.struct("advisory_id", "certainty")).alias("a")).select("hazard_type", "row", "col", "a.*")


@query("advisory_cover", oracle(["reports", "advisories"], "SELECT hazard_type, row, col, advisory_id, certainty FROM c", c=_COVER))
def advisory_cover(spark, d):
    c = _covered(spark, d)
    return c.select("hazard_type", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "advisory_id", "certainty")


def _side(a: tuple[float, float], b: tuple[float, float]) -> str:
    return f"(({b[1]}::DOUBLE - {a[1]}::DOUBLE) * (lat - (clat + {a[0]}::DOUBLE)) - ({b[0]}::DOUBLE - {a[0]}::DOUBLE) * (lon - (clon + {a[1]}::DOUBLE)))"


_CORNERS = [(0.081, 0.003), (-0.043, 0.071), (-0.047, -0.069)]
_SIDES = [_side(a, b) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])]


@query("advisory_polygons", oracle(["reports", "advisories"], f"SELECT row, col, advisory_id FROM spots, advisories WHERE least({', '.join(_SIDES)}) >= -1e-12 OR greatest({', '.join(_SIDES)}) <= 1e-12", spots=_SPOTS))
def advisory_polygons(spark, d):
    """Places inside a triangle about each advisory's centre, by even crossings in column expressions; its edges count."""
    a = V.advisories(spark, d)
    corner = lambda dy, dx: F.struct((F.col("clat") + dy).alias("lat"), (F.col("clon") + dx).alias("lon"))
    shapes = a.select("advisory_id", F.lit(20.0).alias("radius_km"), "clat", "clon", F.array(*(corner(*c) for c in _CORNERS)).alias("ring"))
    from ..functions.geo import in_ring, on_ring

    met = P.covering_circles(_spots(spark, d), shapes, [])
    inside = in_ring(F.col("lat"), F.col("lon"), F.col("ring")) | on_ring(F.col("lat"), F.col("lon"), F.col("ring"))
    return met.filter(inside).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "advisory_id")


_FAN = "SELECT DISTINCT alert_id, subscription_id FROM (SELECT alert_id, tier_rank, unnest(list_concat(cells, projected)) AS c FROM alerts) JOIN (SELECT subscription_id, min_rank, unnest(cells) AS c FROM subscriptions) USING (c) WHERE tier_rank >= min_rank"


def _fanout(spark, d):
    a = V.alerts(spark, d)
    reach = a.select("alert_id", F.array_union("cells", "projected").alias("cells"))
    pairs = P.sets_overlap(reach, V.subscriptions(spark, d), "alert_id", "subscription_id", "cells")
    ranked = pairs.join(a.select("alert_id", "tier_rank"), "alert_id").join(V.subscriptions(spark, d).select("subscription_id", "min_rank"), "subscription_id")
    return ranked.filter("tier_rank >= min_rank").select("alert_id", "subscription_id")


@query("geofence_fanout", oracle(["alerts", "subscriptions"], _FAN))
def geofence_fanout(spark, d):
    return _fanout(spark, d)


@query("delivery_log", oracle(["alerts", "subscriptions"], "SELECT alert_id, count(*) AS due, count(*) FILTER (WHERE subscription_id % 3 = 0) AS sent, count(*) FILTER (WHERE subscription_id % 3 <> 0) AS skipped FROM f GROUP BY ALL", f=_FAN))
def delivery_log(spark, d):
    """Deliveries by outcome: one channel in three has an adapter, the others are skipped."""
    f = _fanout(spark, d).withColumn("outcome", F.when(F.col("subscription_id") % 3 == 0, "sent").otherwise("skipped"))
    return f.groupBy("alert_id").agg(F.count("*").alias("due"), F.count_if(F.col("outcome") == "sent").alias("sent"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))


_HASHES = "SELECT doc_id AS id, (doc_id * 2654435761) % 709 * 20000003 % 4294967296 AS hi, xor((doc_id * 40503) % 709 * 44040193 % 4294967296, (1::BIGINT << (doc_id % 9)::INT)) AS lo FROM documents"


@query("phash_reuse", oracle([], "SELECT a.id FROM h a WHERE EXISTS (SELECT 1 FROM h b WHERE b.id < a.id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6)", h=_HASHES))
def phash_reuse(spark, d):
    i = F.col("doc_id")
    base = (i * 40503) % 709 * 44040193 % 4294967296
    hashes = V.table(spark, d, "documents").select(i.alias("id"), ((i * 2654435761) % 709 * 20000003 % 4294967296).alias("hi"), base.bitwiseXOR(F.expr("shiftleft(1L, cast(doc_id % 9 as int))")).alias("lo"))
    return P.near_hashes(hashes)


@query("missing_matches")
def missing_matches(spark, d):
    """Who may be whom among missing and found people, by classes of people with one name, kind and place. A member row
    gives a person's id, class and number of candidates (links); a match row gives two classes with names alike, near where
    both places are known, and first_rank, from which a class's candidates of equal score follow by id."""
    from ..operators.recovery import class_matches, same_people

    k = F.col("id")
    place = lambda first, n: F.when(k % 7 > 0, (first + k * 31 % n) / 100)
    p = cut(same_people(V.persons(spark, d).select("id", "name", "kind", place(1280, 60).alias("lat"), place(7990, 37).alias("lon"))))
    matches = cut(class_matches(p, 0.72, 5.0))
    links = matches.groupBy("class").agg(F.sum("candidates").alias("links"))
    members = p.select("class", "id").join(links.hint("merge"), "class", "left").select(F.lit("member").alias("row"), "class", "id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return members.unionByName(matches.withColumn("row", F.lit("match")), allowMissingColumns=True)


_COHERENCE = f"SELECT a.id, count(DISTINCT b.reporter_id) AS k FROM reports a JOIN reports b ON a.hazard_type = b.hazard_type AND a.row = b.row AND a.col = b.col AND a.reporter_id <> b.reporter_id AND b.status <> 'rejected' AND abs(a.t - b.t) <= {30 * R.MINUTE} GROUP BY a.id"
_TRUST_EVENTS = "SELECT reporter_id, t, id, value > 40 AS good FROM reports WHERE status IN ('verified', 'rejected')"
_TRUST = """SELECT reporter_id, list_reduce(list_prepend(0.5::DOUBLE, list(CASE WHEN good THEN 0.05::DOUBLE ELSE -0.1::DOUBLE END ORDER BY t, id)), lambda a, s: greatest(0.05::DOUBLE, least(0.95::DOUBLE, a + s))) AS trust, count(*) AS n FROM e GROUP BY ALL"""


def _trust(spark, d):
    e = V.reports(spark, d).filter("status IN ('verified', 'rejected')").select("reporter_id", "t", "id", (F.col("value") > 40).alias("good"))
    return R.trust_ladder(e, "reporter_id")


@query("trust_ladder", oracle(["reports"], "SELECT reporter_id, round(trust, 6) AS trust, n FROM x", e=_TRUST_EVENTS, x=_TRUST))
def trust_ladder(spark, d):
    return _trust(spark, d)


_SESSION = [
    f"SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY reporter_id ORDER BY t, id) <= {6 * S.HOUR} THEN 0 ELSE 1 END AS new FROM reports",
    "SELECT *, sum(new) OVER (PARTITION BY reporter_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM g",
    f"""SELECT id, round(greatest(0.0, greatest(0.0, least(1.0, (t - min(t) OVER (PARTITION BY reporter_id)) / {float(S.HOUR)} / 168.0))
       - least(0.5, greatest(0, row_number() OVER (PARTITION BY reporter_id, session ORDER BY t, id) - 1) * 0.15)), 4) AS score FROM s0""",
]


def _account(spark, d):
    r = V.reports(spark, d)
    since = r.groupBy("reporter_id").agg(F.min("t").alias("since"))
    s = S.gap_sessions(r.select("id", "reporter_id", "t"), ["reporter_id"], 6 * S.HOUR, ["t", "id"]).join(since, "reporter_id")
    age = (F.col("t") - F.col("since")) / F.lit(float(S.HOUR))
    return s.select("id", scoring.account_device(age, F.col("place")).alias("score"))


@query("account_device", oracle(["reports"], "SELECT id, score FROM a", g=_SESSION[0], s0=_SESSION[1], a=_SESSION[2]))
def account_device(spark, d):
    return _account(spark, d)


_CONFIDENCE = f"""SELECT r.id, round(greatest(0.0, least(1.0, coalesce(x.trust, 0.5) * 0.17
    + (CASE WHEN coalesce(k, 0) <= 0 THEN 0.0 ELSE least(1.0, 0.4 + 0.2 * (k - 1)) END) * (CASE WHEN r.source = 4 THEN 0.5 ELSE 1 END) * 0.21
    + {_INSTRUMENT} * 0.21 + (CASE r.source WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 WHEN 2 THEN 0.2 WHEN 3 THEN 0.6 ELSE 1.0 END) * 0.13
    + (CASE WHEN r.hazard_type IN ('coastal_flooding', 'storm_surge', 'oil_spill') THEN r.id % 10 / 10 ELSE 0 END) * 0.09
    + a.score * 0.04 + (CASE v.certainty WHEN 'Observed' THEN 1.0 WHEN 'Likely' THEN 0.7 WHEN 'Possible' THEN 0.4 WHEN 'Unknown' THEN 0.2 ELSE 0 END) * 0.15)), 9) AS confidence,
    {_INSTRUMENT} > 0 OR v.certainty IS NOT NULL OR (r.hazard_type IN ('coastal_flooding', 'storm_surge', 'oil_spill') AND r.id % 10 > 0) AS has_evidence
  FROM reports r LEFT JOIN x ON x.reporter_id = r.reporter_id LEFT JOIN coh ON coh.id = r.id LEFT JOIN strong s ON s.hazard_type = r.hazard_type AND s.row = r.row AND s.col = r.col
  LEFT JOIN a ON a.id = r.id LEFT JOIN cover v ON v.hazard_type = r.hazard_type AND v.row = r.row AND v.col = r.col"""
_CONF_CTES = {"spots": _SPOTS, "allowed": _ALLOWED, "strong": _STRONG, "cover": _COVER, "coh": _COHERENCE, "e": _TRUST_EVENTS, "x": _TRUST, "g": _SESSION[0], "s0": _SESSION[1], "a": _SESSION[2]}


def confidence_table(spark, d):
    """All seven components of each report and their weighted sum. What a place or reporter has in common is computed
    once for it and joined; media and satellite evidence comes from keys."""
    r = V.reports(spark, d)
    joined = (
        r.join(R.coherence(r), "id", "left")
        .join(_account(spark, d), "id")
        .join(_trust(spark, d).select("reporter_id", "trust"), "reporter_id", "left")
        .join(_strongest(spark, d), ["hazard_type", "row", "col"], "left")
        .join(_covered(spark, d), ["hazard_type", "row", "col"], "left")
    )
    media = F.array(*map(F.lit, [0.5, 0.0, 0.2, 0.6, 1.0]))[F.col("source").cast("int")]
    satellite = F.when(F.col("hazard_type").isin("coastal_flooding", "storm_surge", "oil_spill"), F.col("id") % 10 / 10).otherwise(0.0)
    parts = {
        "trust": F.coalesce("trust", F.lit(0.5)),
        "coherence": scoring.coherence(F.coalesce("n", F.lit(0)), F.col("source") == 4),
        "instrument": scoring.instrument(F.col("strongest")),
        "media": media,
        "satellite": satellite,
        "account_device": F.col("score"),
        "official": scoring.official(F.col("certainty"), F.col("certainty").isNotNull()),
    }
    out = joined.select("id", "hazard_type", "reporter_id", "row", "status", *(v.alias(k) for k, v in parts.items()))
    return out.withColumn("confidence", scoring.combine(**{k: F.col(k) for k in parts}))


@query("confidence", oracle(["reports", "stations", "advisories"], "SELECT * FROM c", **_CONF_CTES, c=_CONFIDENCE))
def confidence(spark, d):
    c = confidence_table(spark, d)
    total = sum((F.col(k) * w for k, w in fixed.WEIGHTS.items()), F.lit(0.0))
    evidence = (F.col("instrument") > 0) | (F.col("official") > 0) | (F.col("satellite") > 0)
    return c.select("id", F.round(scoring.clamp(total), 9).alias("confidence"), evidence.alias("has_evidence"))


_TIER = """SELECT incident, CASE WHEN bool_or(status IN ('corroborated', 'verified')) THEN CASE WHEN max(value) > 200 AND count(DISTINCT reporter_id) >= 3 THEN 'watch' ELSE 'advisory' END END AS tier,
  count(*) AS n, any_value(hazard_type) AS hazard_type FROM i GROUP BY incident"""


def _tiers(spark, d):
    g = _incident(V.reports(spark, d)).groupBy("incident", "hazard_type")
    rows = g.agg(F.max(F.col("status").isin("corroborated", "verified")).alias("ok"), F.countDistinct("reporter_id").alias("reporters"), (F.max("value") - 200).alias("strong"), F.count("*").alias("n"))
    status = F.when(F.col("ok"), "verified").otherwise("new")
    return rows.withColumn("tier", scoring.eligible_tier(status, F.col("reporters"), F.col("strong")))


@query("alert_tier", oracle(["reports"], "SELECT incident, tier FROM x", i=_INCIDENT, x=_TIER))
def alert_tier(spark, d):
    return _tiers(spark, d).select("incident", "tier")


def _labels():
    return "CASE hazard_type " + " ".join(f"WHEN '{k}' THEN '{label}'" for k, _, _, _, label in fixed.HAZARDS) + " END"


@query("alert_message", oracle(["reports"], f"SELECT incident, CASE tier WHEN 'watch' THEN '{fixed.TIER_MARKS['watch']}' ELSE '{fixed.TIER_MARKS['advisory']}' END || ' ' || upper(tier) || ': ' || {_labels()} || ' reported near your area (' || n || CASE WHEN n = 1 THEN ' report).' ELSE ' reports).' END AS standard_en, upper(tier) || ': ' || {_labels()} || ' near you (' || n || CASE WHEN n = 1 THEN ' report).' ELSE ' reports).' END AS short_en FROM x WHERE tier IS NOT NULL", i=_INCIDENT, x=_TIER))
def alert_message(spark, d):
    from ..operators.alerts import message

    t = _tiers(spark, d).filter("tier IS NOT NULL")
    m = message(F.col("hazard_type"), F.col("tier"), F.col("n"))
    return t.select("incident", m["en"]["standard"].alias("standard_en"), m["en"]["short"].alias("short_en"))


@query("incident_merge")
def incident_merge(spark, d):
    """Sequential merge by hazard and connected region of cells, with vectors where the report has one; day is the
    report's own."""
    r = V.reports(spark, d).withColumn("day", F.floor(F.col("t") / S.DAY))
    r = with_region(r, ["hazard_type"])
    return K.merge_incidents(K.with_vectors(r, V.table(spark, d, "embeddings")), ["hazard_type", "region"], keep=("day",)).drop("region")


@query("incident_table")
def incident_table(spark, d):
    """All merged incidents with what their reports say together."""
    return incidents.table(V.reports(spark, d), incident_merge(spark, d)).withColumn("n_cells", F.size("cells").cast("long")).drop("cells")


@query("incident_projections")
def incident_projections(spark, d):
    """The merged incidents of the last six hours that a forecast of spread is made for, and the cells about each."""
    r = V.reports(spark, d)
    now = r.agg(F.max("t").alias("now")).first()["now"]
    due = incidents.to_project(incidents.table(r, incident_merge(spark, d)), now - 6 * S.HOUR)
    return due.select("incident", "hazard_type", "status", F.explode("ahead").alias("c")).select("incident", "hazard_type", "status", "c.row", "c.col")


@query("narrative_clusters")
def narrative_clusters(spark, d):
    """Rumours of half a day: clusters of at least three reports whose texts' vectors are alike. Reports come in runs of
    forty that pass on one text, and texts are those of all vectors in turn."""
    r = V.reports(spark, d).withColumn("half_day", F.floor(F.col("t") / (12 * S.HOUR)))
    e = V.table(spark, d, "embeddings")
    known = e.agg(F.max("vec_id").alias("top"))
    said = r.crossJoin(F.broadcast(known)).withColumn("said", F.expr("id div 40 % (top + 1)")).drop("top")
    return K.leader_clusters(said.join(e.select(F.col("vec_id").alias("said"), F.col("embedding").alias("v")), "said"), ["half_day"], key="said")


def _hotspots(spark, d):
    """Clusters of the reports of six hours that aren't rejected: centre, size, confidence, the commonest hazard (the
    first seen on ties) and the widened hull."""
    r = confidence_table(spark, d).select("id", "confidence").join(V.reports(spark, d), "id")
    r = r.filter("status <> 'rejected'").withColumn("window", F.floor(F.col("t") / (6 * S.HOUR)))
    jitter = lambda c, k: F.col(c) + F.col("id") * k % 1000 / 1e6
    points = cut(r.select("window", "hazard_type", "id", "t", "confidence", jitter("lat", 7919).alias("lat"), jitter("lon", 104729).alias("lon")))
    group = ["window", "cluster"]
    placed = cut(density.hotspots(points, ["window"]).join(points, ["window", "id"]))
    kinds = placed.groupBy(*group, "hazard_type").agg(F.count("*").alias("k"), F.min(F.struct("t", "id")).alias("first"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.sum(F.col("confidence").cast("decimal(12,6)")).alias("confidence"))
    best = F.min_by("hazard_type", F.struct(-F.col("k"), F.col("first")))
    n = F.sum("k")
    spots = kinds.groupBy(*group).agg(n.alias("n"), F.round(F.sum("lat") / n, 5).alias("lat"), F.round(F.sum("lon") / n, 5).alias("lon"), F.round(F.sum("confidence"), 3).cast("double").alias("confidence"), best.alias("hazard_type"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("hazard_type", "k"))))).alias("hazards"))
    return spots, placed


@query("hotspots")
def hotspots(spark, d):
    spots, placed = _hotspots(spark, d)
    return spots.join(K.hulls(placed, ["window", "cluster"]), ["window", "cluster"])


@query("hotspot_movement")
def hotspot_movement(spark, d):
    h = _hotspots(spark, d)[0]
    now = h.select("window", "hazard_type", F.col("cluster").cast("long").alias("id"), "lat", "lon", F.lit(True).alias("current"))
    before = h.select((F.col("window") + 1).alias("window"), "hazard_type", F.col("cluster").cast("long").alias("id"), "lat", "lon", F.lit(False).alias("current"))
    return K.match_hotspots(now.unionByName(before), ["window", "hazard_type"])


@query("propagation_hits", oracle(["reports"], f"SELECT f.id, 9::BIGINT AS cells, count(DISTINCT (r.row, r.col)) AS hits FROM reports f LEFT JOIN reports r ON abs(r.row - f.row) <= 1 AND abs(r.col - f.col) <= 1 AND r.t >= f.t AND r.t <= f.t + {3 * S.HOUR} GROUP BY ALL"))
def propagation_hits(spark, d):
    """Of the cells about each report, those that got any report within three hours. In bins of that width they are in the
    report's own bin, where the cell's last time tells, or in the next, where its first time does."""
    r = V.reports(spark, d)
    width = 3 * S.HOUR
    here = F.floor(F.col("t") / width)
    seen = r.groupBy("row", "col", here.alias("bin")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    own = seen.select("row", "col", "bin", "last", F.lit(None).cast("long").alias("first"))
    after = seen.select("row", "col", F.col("bin") - 1, F.lit(None).cast("long"), "first")
    cells = own.union(after).groupBy("row", "col", "bin").agg(F.max("last").alias("last"), F.max("first").alias("first"))
    about = cells.select("bin", "last", "first", F.explode(ring(F.col("row"), F.col("col"))).alias("c"))
    about = about.groupBy("c.row", "c.col", "bin").agg(F.collect_list(F.struct("last", "first")).alias("about"))  # nine at most
    hit = lambda c: F.coalesce(c["last"] >= F.col("t"), F.lit(False)) | F.coalesce(c["first"] <= F.col("t") + width, F.lit(False))
    met = r.select("id", "t", "row", "col", here.alias("bin")).join(about, ["row", "col", "bin"], "left")
    hits = F.coalesce(F.size(F.filter("about", hit)).cast("long"), F.lit(0).cast("long"))
    return met.select("id", F.lit(9).cast("long").alias("cells"), F.when(F.col("about").isNull(), F.lit(0).cast("long")).otherwise(hits).alias("hits"))


@query("keyword_classify", oracle([], "SELECT doc_id, CASE WHEN best.hits > 0 THEN best.hazard END AS hazard_type, best.hits::BIGINT AS hits FROM (SELECT doc_id, list_max([" + ", ".join("{'hits': " + " + ".join(f"contains(lower(coalesce(text, '')), '{w.lower()}')::INT" for w in ws) + f", 'back': {-i}, 'hazard': '{k}'" + "}" for i, (k, ws) in enumerate(fixed.KEYWORDS.items())) + "]) AS best FROM documents)"))
def keyword_classify(spark, d):
    hazard, hits = text.classify(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", hazard.alias("hazard_type"), hits.cast("long").alias("hits"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("urgency_hearsay", oracle([], f"SELECT doc_id, CASE WHEN {_any(fixed.URGENCY_HIGH)} THEN 'high' WHEN {_any(fixed.URGENCY_LOW)} THEN 'low' ELSE 'medium' END AS urgency, coalesce({_any(fixed.HEARSAY)}, false) AS hearsay FROM documents"))
def urgency_hearsay(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.urgency(F.col("text")).alias("urgency"), text.hearsay(F.col("text")).alias("hearsay"))
