"""Common Alerting Protocol documents: parsing with Spark's XML functions, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_AREA = "struct<areaDesc:string,polygon:array<string>,circle:array<string>>"
_INFO = f"struct<language:string,event:string,urgency:string,severity:string,certainty:string,headline:string,description:string,effective:string,expires:string,area:array<{_AREA}>>"
SCHEMA = f"struct<identifier:string,sender:string,sent:string,status:string,msgType:string,references:string,info:array<{_INFO}>>"

SAMPLES = [
    """<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>A-1</identifier><sender>met@example</sender><sent>2024-01-10T06:00:00+00:00</sent>
<msgType>Alert</msgType><info><event>Storm Surge Warning</event><urgency>Immediate</urgency><severity>Severe</severity><certainty>Likely</certainty>
<expires>2024-01-11T06:00:00+00:00</expires><area><areaDesc>north</areaDesc><polygon>13.0,80.2 13.2,80.2 13.2,80.4 13.0,80.2</polygon></area></info></alert>""",
    """<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>A-2</identifier><sender>met@example</sender><sent>2024-01-10T07:00:00+00:00</sent>
<msgType>Alert</msgType><info><event>High Surf</event><certainty>Observed</certainty><area><areaDesc>south</areaDesc><circle>12.9,80.25 15.5</circle></area></info></alert>""",
    """<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>A-3</identifier><sender>met@example</sender><sent>2024-01-10T09:00:00+00:00</sent>
<msgType>Cancel</msgType><references>met@example,A-1,2024-01-10T06:00:00+00:00</references></alert>""",
    "not xml at all",
]


def points(polygon: Column) -> Column:
    """'lat,lon lat,lon ...' as an array of struct(lat, lon)."""
    pair = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("lat"), F.split(p, ",")[1].cast("double").alias("lon"))
    return F.transform(F.split(F.trim(polygon), r"\s+"), pair)


def circle(value: Column) -> Column:
    """'lat,lon km' as struct(lat, lon, radius_km)."""
    parts = F.split(F.trim(value), r"[,\s]+")
    return F.struct(parts[0].cast("double").alias("lat"), parts[1].cast("double").alias("lon"), parts[2].cast("double").alias("radius_km"))


def references(value: Column) -> Column:
    """Identifiers in 'sender,identifier,sent' triples."""
    triples = F.filter(F.transform(F.split(F.trim(value), r"\s+"), lambda x: F.split(x, ",")), lambda x: F.size(x) == 3)
    return F.transform(triples, lambda x: x[1])


def alerts(documents: DataFrame) -> DataFrame:
    """(id, xml) to id, a: the parsed alert. Documents that don't parse have a null identifier and go."""
    plain = F.regexp_replace("xml", r'\sxmlns(:\w+)?="[^"]*"', "")
    return documents.select("id", F.from_xml(plain, SCHEMA, {"rowTag": "alert", "mode": "PERMISSIVE"}).alias("a")).filter("a.identifier is not null")


def parse(documents: DataFrame) -> DataFrame:
    """One row for each polygon and each circle of each info of each alert that isn't a cancellation: identifier, sender,
    msg_type, event, hazard_type, certainty, effective times, polygon, circle."""
    infos = alerts(documents).filter("a.msgType <> 'Cancel'").select("id", "a.*", F.explode("a.info").alias("i")).select("id", "identifier", "sender", "sent", "msgType", "i.*")
    areas = infos.withColumn("x", F.explode("area"))
    shape = F.struct(F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("polygon"), F.lit(None).cast("struct<lat:double,lon:double,radius_km:double>").alias("circle"))
    of_polygon = lambda p: F.struct(points(p).alias("polygon"), shape["circle"].alias("circle"))
    of_circle = lambda c: F.struct(shape["polygon"].alias("polygon"), circle(c).alias("circle"))
    none = F.array().cast("array<string>")
    shapes = F.concat(F.transform(F.coalesce("x.polygon", none), of_polygon), F.transform(F.coalesce("x.circle", none), of_circle))
    out = areas.withColumn("s", F.explode(shapes))
    return out.select(
        "identifier", "sender", F.col("msgType").alias("msg_type"), "event", text.event_to_hazard(F.col("event")).alias("hazard_type"), "certainty",
        F.try_to_timestamp("sent").alias("sent_at"), F.try_to_timestamp("expires").alias("expires_at"), "s.polygon", "s.circle",
    )


def superseded(documents: DataFrame) -> DataFrame:
    """identifier, ended_at: alerts that a later document refers to end when that one was sent."""
    a = alerts(documents).filter("a.references is not null")
    return a.select(F.explode(references(F.col("a.references"))).alias("identifier"), F.try_to_timestamp("a.sent").alias("sent")).groupBy("identifier").agg(F.min("sent").alias("ended_at"))


def to_xml(identifier: Column, sender: Column, sent: Column, event: Column, certainty: Column, headline: Column, polygons: Column) -> Column:
    """A CAP 1.2 document; polygons: array of arrays of struct(lat, lon)."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ring = lambda p: F.array_join(F.transform(p, lambda x: F.format_string("%.6f,%.6f", x["lat"], x["lon"])), " ")
    areas = F.array_join(F.transform(polygons, lambda p: F.concat(F.lit("<polygon>"), ring(p), F.lit("</polygon>"))), "")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), safe(c), F.lit(f"</{name}>"))
    return F.concat(
        F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), tag("identifier", identifier), tag("sender", sender), tag("sent", sent), F.lit("<status>Actual</status><msgType>Alert</msgType><info>"),
        tag("event", event), tag("certainty", certainty), tag("headline", headline), F.lit("<area><areaDesc>affected area</areaDesc>"), areas, F.lit("</area></info></alert>"),
    )
