"""Registered queries over state: inundation, privacy, audit, recovery, summaries, documents and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..operators import audit, ml, privacy, retrieval
from ..operators import reports as R
from ..operators import series as S
from . import views as V
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


def r4(x):
    return F.round(x, 4)


@query("flooded_cells", oracle(["elevation"], "SELECT cell, round(2.5 - elevation_m, 3) AS depth_m FROM elevation WHERE elevation_m <= 2.5"))
def flooded_cells(spark, d):
    return privacy.flooded(V.elevation(spark, d), 2.5).select("cell", "depth_m")


@query("depth_at_point", oracle(["readings", "elevation"], "SELECT c.c_custkey AS id, CASE WHEN e.cell IS NOT NULL THEN round(greatest(0.0, l.level - e.elevation_m), 3) END AS depth_m FROM customer c LEFT JOIN elevation e ON e.cell = c.c_custkey * 2, (SELECT arg_max(value, (t, event_id)) / 10 AS level FROM readings WHERE variable = 'water_level') l"))
def depth_at_point(spark, d):
    """Depth under the newest water level at each customer's cell; null where the cell's height isn't known."""
    level = V.readings(spark, d).filter("variable = 'water_level'").agg((F.max(F.struct("t", "event_id", "value"))["value"] / 10).alias("level"))
    points = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 2).alias("cell"))
    joined = points.join(V.elevation(spark, d), "cell", "left").crossJoin(F.broadcast(level))
    depth = F.when(F.col("elevation_m").isNotNull(), F.round(F.greatest(F.lit(0.0), F.col("level") - F.col("elevation_m")), 3))
    return joined.select("id", depth.alias("depth_m"))


@query(
    "exclusion_cells",
    oracle(["reports", "alerts", "elevation"], f"SELECT DISTINCT cell FROM (SELECT row || ':' || col AS cell FROM reports WHERE status = 'corroborated' AND t >= (SELECT max(t) FROM reports) - {S.DAY} UNION ALL SELECT 'a' || unnest(cells) FROM alerts WHERE tier_rank = 2 UNION ALL SELECT 'e' || cell FROM elevation WHERE elevation_m <= 1)"),
)
def exclusion_cells(spark, d):
    r = V.reports(spark, d)
    now = r.agg(F.max("t").alias("now"))
    recent = r.filter("status = 'corroborated'").crossJoin(F.broadcast(now)).filter(F.col("t") >= F.col("now") - S.DAY)
    parts = [
        recent.select(F.concat_ws(":", "row", "col").alias("cell")),
        V.alerts(spark, d).filter("tier_rank = 2").select(F.explode("cells").alias("c")).select(F.concat(F.lit("a"), F.col("c").cast("string")).alias("cell")),
        privacy.flooded(V.elevation(spark, d), 1.0).select(F.concat(F.lit("e"), F.col("cell").cast("string")).alias("cell")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("ahead_cells", oracle(["alerts"], "SELECT alert_id, unnest(list_filter(projected, lambda x: NOT list_contains(cells, x)))::BIGINT AS cell FROM (SELECT alert_id, cells, list_transform(cells, lambda x: x + 2) AS projected FROM alerts)"))
def ahead_cells(spark, d):
    a = V.alerts(spark, d).select("alert_id", "cells", F.transform("cells", lambda x: x + 2).alias("projected"))
    return a.select("alert_id", F.explode(F.array_except("projected", "cells")).alias("cell"))


@query("retention_purge", oracle(["persons"], "SELECT p.id, CASE WHEN q.age_days <= 180 THEN p.matched_id END AS matched_id FROM persons p LEFT JOIN persons q ON q.id = p.matched_id WHERE p.age_days <= 180"))
def retention_purge(spark, d):
    """Persons kept 180 days at most; links to purged ones go."""
    p = V.persons(spark, d)
    kept = p.filter("age_days <= 180")
    links = kept.select(F.col("id").alias("matched_id"), F.lit(True).alias("there"))
    return kept.join(links, "matched_id", "left").select("id", F.when(F.col("there"), F.col("matched_id")).alias("matched_id"))


_CHAIN = f"SELECT subject, list_reduce(list_prepend('{fixed.GENESIS}', list(envelope ORDER BY id)), lambda a, e: sha256(a || e)) AS head, count(*) AS n FROM audit_events GROUP BY ALL"


@query("audit_chain", oracle(["audit_events"], "SELECT subject, head, n FROM c", c=_CHAIN))
def audit_chain(spark, d):
    return audit.heads(V.audit_events(spark, d), "subject", "id", "envelope")


@query(
    "audit_verify",
    oracle(
        ["audit_events"],
        "SELECT subject, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad, min(CASE WHEN NOT ok THEN id END) AS first_bad FROM v GROUP BY ALL",
        o="SELECT subject, id, envelope, row_number() OVER (PARTITION BY subject ORDER BY id) AS k FROM audit_events",
        ch=f"SELECT subject, id, envelope, k, list_reduce(list_prepend('{fixed.GENESIS}', list(envelope) OVER w), lambda a, e: sha256(a || e)) AS hash FROM o WINDOW w AS (PARTITION BY subject ORDER BY k ROWS UNBOUNDED PRECEDING)",
        t="SELECT subject, id, k, hash, CASE WHEN id % 1000 = 7 THEN envelope || 'x' ELSE envelope END AS envelope FROM ch",
        v=f"SELECT *, hash = sha256(coalesce(lag(hash) OVER (PARTITION BY subject ORDER BY k), '{fixed.GENESIS}') || envelope) AS ok FROM t",
    ),
)
def audit_verify(spark, d):
    """Every entry against its predecessor's hash, after one entry in a thousand was tampered with."""
    entries = audit.entries(V.audit_events(spark, d), "subject", "id", "envelope")
    tampered = entries.withColumn("envelope", F.when(F.col("id") % 1000 == 7, F.concat("envelope", F.lit("x"))).otherwise(F.col("envelope")))
    return audit.verify(tampered, "subject", "id", "envelope")


@query("audit_forks", oracle([], "SELECT prev, count(*) AS n, min(o_orderkey) AS min_id, max(o_orderkey) AS max_id FROM (SELECT sha256((o_orderkey // 2 * 3 % 5000)::VARCHAR) AS prev, o_orderkey FROM orders) GROUP BY prev HAVING count(*) > 1"))
def audit_forks(spark, d):
    o = V.table(spark, d, "orders").select(F.sha2(F.expr("cast(o_orderkey div 2 * 3 % 5000 as string)"), 256).alias("prev"), F.col("o_orderkey").alias("id"))
    return audit.forks(o, "prev", "id")


@query(
    "sitrep_snapshot",
    oracle(
        ["reports", "requests", "offers", "stations"],
        f"""SELECT (SELECT count(*) FROM w) AS reports, (SELECT count(*) FROM w WHERE status = 'verified') AS verified, (SELECT count(*) FROM w WHERE status = 'rejected') AS rejected,
        (SELECT count(DISTINCT hazard_type || row) FROM w) AS incidents, (SELECT count(*) FROM requests WHERE status = 'open') AS open_requests, (SELECT count(*) FROM offers) AS offers,
        (SELECT count(*) FROM stations WHERE abs(z) >= 3) AS anomalous_stations, (SELECT arg_max(hazard_type, (n, hazard_type)) FROM (SELECT hazard_type, count(*) AS n FROM w GROUP BY ALL)) AS top_hazard""",
        w=f"SELECT * FROM reports WHERE t >= (SELECT max(t) FROM reports) - {S.DAY} AND t < (SELECT max(t) FROM reports)",
    ),
)
def sitrep_snapshot(spark, d):
    """One row of all sections over the last day, its end not included."""
    r = V.reports(spark, d)
    now = r.agg(F.max("t").alias("now"))
    w = r.crossJoin(F.broadcast(now)).filter((F.col("t") >= F.col("now") - S.DAY) & (F.col("t") < F.col("now")))
    a = w.agg(F.count("*").alias("reports"), F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.countDistinct(F.concat("hazard_type", F.col("row").cast("string"))).alias("incidents"))
    sections = [
        V.requests(spark, d).agg(F.count_if(F.col("status") == "open").alias("open_requests")),
        V.offers(spark, d).agg(F.count("*").alias("offers")),
        V.stations(spark, d).agg(F.count_if(F.abs("z") >= 3).alias("anomalous_stations")),
        w.groupBy("hazard_type").agg(F.count("*").alias("n")).agg(F.max_by("hazard_type", F.struct("n", "hazard_type")).alias("top_hazard")),
    ]
    for s in sections:
        a = a.crossJoin(F.broadcast(s))  # one row each
    return a


@query("safety_counts", oracle([], "SELECT role, count(*) AS total, count(*) FILTER (WHERE turn % 2 = 0) AS safe, count(*) FILTER (WHERE turn % 2 = 1) AS need_help, count(DISTINCT conv_id) AS people FROM conversations GROUP BY ALL"))
def safety_counts(spark, d):
    c = V.table(spark, d, "conversations").groupBy("role")
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("turn") % 2 == 0).alias("safe"), F.count_if(F.col("turn") % 2 == 1).alias("need_help"), F.countDistinct("conv_id").alias("people"))


@query("phone_roster", oracle([], "SELECT c.c_custkey, m.s_suppkey FROM (SELECT c_custkey, right(regexp_replace('+91 (98)' || lpad((c_custkey * 37 % 100000)::VARCHAR, 8, '0'), '[^0-9]', '', 'g'), 10) AS phone FROM customer) c JOIN (SELECT s_suppkey, right(regexp_replace('98-' || lpad((s_suppkey * 11 % 100000)::VARCHAR, 8, '0'), '[^0-9]', '', 'g'), 10) AS phone FROM supplier) m USING (phone)"))
def phone_roster(spark, d):
    digits = lambda c, k: F.lpad((F.col(c) * k % 100000).cast("string"), 8, "0")
    c = V.table(spark, d, "customer").select("c_custkey", text.normal_phone(F.concat(F.lit("+91 (98)"), digits("c_custkey", 37))).alias("phone"))
    m = V.table(spark, d, "supplier").select("s_suppkey", text.normal_phone(F.concat(F.lit("98-"), digits("s_suppkey", 11))).alias("phone"))
    return c.join(m, "phone").select("c_custkey", "s_suppkey")


@query("training_export", oracle([], "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' ELSE coalesce(CASE WHEN doc_id % 5 = 0 THEN 'corrected' END, lang) END AS label, n_chars FROM documents JOIN labels USING (doc_id) WHERE (quality = 1 OR doc_id % 5 = 0) AND trim(text) <> ''"))
def training_export(spark, d):
    docs, labels = V.table(spark, d, "documents"), V.table(spark, d, "labels")
    joined = docs.join(labels, "doc_id").filter("(quality = 1 OR doc_id % 5 = 0) AND trim(text) <> ''")
    corrected = F.when(F.col("doc_id") % 5 == 0, F.lit("corrected"))
    return joined.select("doc_id", F.when(F.col("toxic") == 1, "rejected").otherwise(F.coalesce(corrected, "lang")).alias("label"), "n_chars")


@query("damage_classes", oracle([], "SELECT p_partkey AS id, CASE WHEN w >= 0.35 THEN 'flooding' WHEN e >= 0.18 THEN 'structural_or_debris' ELSE 'minor_or_none' END AS kind, CASE WHEN w >= 0.35 THEN CASE WHEN w >= 0.65 THEN 'destroyed' WHEN w >= 0.5 THEN 'severe' ELSE 'moderate' END WHEN e >= 0.18 THEN CASE WHEN e >= 0.28 THEN 'severe' ELSE 'moderate' END ELSE 'minor' END AS severity FROM (SELECT p_partkey, p_partkey % 100 / 100 AS w, p_size / 100 AS e FROM part)"))
def damage_classes(spark, d):
    kind, severity, _ = scoring.damage(F.col("w"), F.col("e"))
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100 / 100).alias("w"), (F.col("p_size") / 100).alias("e"))
    return p.select("id", kind.alias("kind"), severity.alias("severity"))


@query("satellite_scores", oracle([], "SELECT s_suppkey AS incident_id, max(('0x' || substr(sha256(s_suppkey || ':' || recipe), 1, 8))::BIGINT % 1000 / 1000) AS score FROM supplier, (VALUES ('sentinel1_water_extent'), ('sentinel1_sar_dark_slick')) r(recipe) GROUP BY ALL"))
def satellite_scores(spark, d):
    recipes = F.explode(F.array(F.lit("sentinel1_water_extent"), F.lit("sentinel1_sar_dark_slick")))
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("incident_id"), recipes.alias("recipe"))
    digest = F.sha2(F.concat_ws(":", F.col("incident_id").cast("string"), "recipe"), 256)
    score = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 / 1000
    return s.groupBy("incident_id").agg(F.max(score).alias("score"))


@query("rag_topk", oracle([], "SELECT q, vec_id, round(s, 4) AS score FROM (SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id) WHERE s >= 0.28 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) <= 4"))
def rag_topk(spark, d):
    """The four documents nearest to each question, if alike enough. Questions are the rows whose id is divisible by 20,
    met in blocks."""
    e = V.table(spark, d, "embeddings")
    top = retrieval.nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 4, 0.28)
    return top.select("q", "vec_id", r4("s").alias("score"))


@query("prototype_classify", oracle([], "SELECT vec_id, label FROM (SELECT vec_id, label, list_avg(list_slice(list_reverse_sort(list(s)), 1, 2)) AS m FROM (SELECT e.vec_id, p.label, list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3) p) GROUP BY vec_id, label) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(m, 9) DESC, label) = 1"))
def prototype_classify(spark, d):
    """The class whose two nearest of three prototypes are most similar on average. Prototypes are three for a class."""
    e = V.table(spark, d, "embeddings")
    protos = R.first_of(e, ["label"], ["vec_id"], 3).groupBy().agg(F.collect_list(F.struct("label", "embedding")).alias("protos"))
    return ml.prototype_class(e, protos)


@query("linear_probe")
def linear_probe(spark, d):
    """Softmax regression on a training part, and the share of the rest that it gets right, by class."""
    return ml.linear_probe(V.table(spark, d, "embeddings"), "vec_id")


@query("federated_average", oracle([], "SELECT place, round(sum(n * m) / sum(n), 6) AS weight FROM (SELECT shard, place, count(*) AS n, avg(x) AS m FROM (SELECT vec_id % 3 AS shard, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) GROUP BY ALL) GROUP BY ALL"))
def federated_average(spark, d):
    """The mean vectors of three shards, averaged by their sizes."""
    e = V.table(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("shard"), F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x"))
    local = e.groupBy("shard", "place").agg(F.count("*").alias("n"), F.avg("x").alias("m"))
    return local.groupBy(F.col("place").cast("long").alias("place")).agg(F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 6).alias("weight"))


@query("federated_classifier")
def federated_classifier(spark, d):
    return ml.federated_accuracy(V.table(spark, d, "embeddings"), "vec_id", shards=3)


@query("queue_backoff", oracle([], "SELECT o_orderkey AS id, least(900000.0, 5000 * pow(2.0, greatest(0, o_orderkey % 12 - 1))) AS wait_ms, CASE WHEN o_orderkey % 12 >= 8 THEN 'failed' ELSE 'pending' END AS state FROM orders"))
def queue_backoff(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 12).alias("attempts"))
    return o.select("id", scoring.backoff_ms(F.col("attempts")).alias("wait_ms"), F.when(F.col("attempts") >= 8, "failed").otherwise("pending").alias("state"))


@query("queue_counts", oracle([], "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS sent FROM orders GROUP BY ALL"))
def queue_counts(spark, d):
    o = V.table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return o.withColumnsRenamed({"F": "failed", "O": "pending", "P": "sent"})


@query("guarded_commands", oracle(["requests"], "SELECT r.id, CASE WHEN r.status = 'open' AND s.s_suppkey IS NOT NULL THEN 'fulfilled' ELSE r.status END AS status, r.status = 'open' AND s.s_suppkey IS NOT NULL AS applied FROM requests r LEFT JOIN supplier s ON s.s_suppkey = r.id"))
def guarded_commands(spark, d):
    commands = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return R.guarded(V.requests(spark, d), commands, "id", "open", "fulfilled").select("id", "status", "applied")


@query("latest_state", oracle([], "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate)::DATE::VARCHAR AS day FROM orders GROUP BY ALL"))
def latest_state(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return R.latest_state(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "status", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("station_upsert", oracle([], "SELECT coalesce(s.s_suppkey, c.c_custkey) AS id, coalesce(c.c_name, s.s_name) AS name FROM supplier s FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name FROM customer) c ON c.c_custkey = s.s_suppkey"))
def station_upsert(spark, d):
    table = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    changes = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name END").alias("name"))
    return R.upsert(table, changes, "id")


def cap_documents(spark, d):
    """CAP documents made of orders: alerts with a polygon or a circle, cancellations of the order before, and texts that
    aren't XML."""
    k = F.col("o_orderkey")
    sent = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    head = F.concat(F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), tag("identifier", F.concat(F.lit("A-"), k.cast("string"))), F.lit("<sender>met</sender>"), tag("sent", sent))
    shape = F.when(k % 2 == 0, "<polygon>13.0,80.2 13.2,80.2 13.2,80.4 13.0,80.2</polygon>").otherwise(tag("circle", F.concat(F.lit("12.9,80.25 "), (k % 20 + 1).cast("string"))))
    event = F.when(k % 3 == 0, "Storm Surge Warning").when(k % 3 == 1, "High Surf").otherwise("Fog")
    info = F.concat(tag("event", event), F.lit("<certainty>Likely</certainty><area><areaDesc>x</areaDesc>"), shape, F.lit("</area>"))
    alert = F.concat(head, F.lit("<msgType>Alert</msgType>"), tag("info", info), F.lit("</alert>"))
    cancel = F.concat(head, F.lit("<msgType>Cancel</msgType>"), tag("references", F.concat(F.lit("met,A-"), (k - 1).cast("string"), F.lit(",2024-01-01T00:00:00+00:00"))), F.lit("</alert>"))
    return V.table(spark, d, "orders").select(k.alias("id"), F.when(k % 7 == 3, "no xml at all").when(k % 5 == 0, cancel).otherwise(alert).alias("xml"))


@query("cap_parse", oracle([], "SELECT 'A-' || o_orderkey AS identifier, CASE o_orderkey % 3 WHEN 0 THEN 'storm_surge' WHEN 1 THEN 'high_waves' ELSE 'other' END AS hazard_type, epoch_us(date_trunc('second', o_orderdate)) AS sent, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS corners, CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 20 + 1)::DOUBLE END AS radius_km FROM orders WHERE o_orderkey % 7 <> 3 AND o_orderkey % 5 <> 0"))
def cap_parse(spark, d):
    from ..sources.cap import parse

    p = parse(cap_documents(spark, d))
    return p.select("identifier", F.coalesce("hazard_type", F.lit("other")).alias("hazard_type"), F.unix_micros("sent_at").alias("sent"), F.when(F.col("polygon").isNotNull(), F.size("polygon")).alias("corners"), F.col("circle.radius_km").alias("radius_km"))


@query("cap_superseded", oracle([], "SELECT 'A-' || (o_orderkey - 1) AS identifier, epoch_us(date_trunc('second', o_orderdate)) AS ended FROM orders WHERE o_orderkey % 7 <> 3 AND o_orderkey % 5 = 0"))
def cap_superseded(spark, d):
    """Alerts end when the first document that refers to them was sent."""
    from ..sources.cap import superseded

    return superseded(cap_documents(spark, d)).select("identifier", F.unix_micros("ended_at").alias("ended"))


@query("iot_parse", oracle([], "SELECT event_id AS id, 'iot-node-' || user_id AS station_id, 'water_level' AS variable, value FROM events WHERE event_id % 10 <> 3"))
def iot_parse(spark, d):
    """Telemetry made of events, one message in ten broken, and what is read from it."""
    from ..sources.iot import parse

    e = V.table(spark, d, "events")
    topic = F.concat(F.lit("sensors/iot/node-"), F.col("user_id").cast("string"), F.lit("/telemetry"))
    body = F.when(F.col("event_id") % 10 == 3, F.lit('{"lat": 95.0, "readings": []}')).otherwise(
        F.to_json(F.struct(F.lit(13.05).alias("lat"), F.lit(80.28).alias("lon"), F.array(F.struct(F.lit("water_level").alias("variable"), "value")).alias("readings")))
    )
    return parse(e.select(F.col("event_id").alias("id"), topic.alias("topic"), body.alias("payload")), F.lit("2024-02-01 00:00:00").cast("timestamp"))[0].select("id", "station_id", "variable", "value")
