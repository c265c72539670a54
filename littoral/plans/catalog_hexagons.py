"""Registered queries over hexagonal cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hexagons as H
from ..operators import privacy
from ..operators import series as S
from . import hex_sql
from . import views as V
from .views import Query, oracle

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RES, COARSE, RINGS = 8, 6, 2


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def celled(rows, lat: str = "lat", lon: str = "lon", res: int = RES):
    """rows with cell. Each distinct place goes through Python once."""
    places = rows.select(F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"))
    distinct = places.distinct().withColumn("cell", H.cell(F.col("_lat"), F.col("_lon"), res))
    met = rows.join(distinct, F.col(lat).cast("double").eqNullSafe(F.col("_lat")) & F.col(lon).cast("double").eqNullSafe(F.col("_lon")), "left")
    return met.drop("_lat", "_lon")


_PLACES = {v: f"SELECT lat, lon FROM {v}" for v in ("reports", "requests")}
_CELLED = "SELECT r.*, c.* EXCLUDE (lat, lon) FROM {0} r JOIN cells c ON c.lat = r.lat::DOUBLE AND c.lon = r.lon::DOUBLE"


def _sql(view: str, final: str, **ctes: str) -> str:
    return oracle([view], final, cells=hex_sql.cells(_PLACES[view], RES), r=_CELLED.format(view), **ctes)


@query("hex_requests", _sql("requests", f"SELECT id, lower(hex(cell)) AS cell, lower(hex({hex_sql.parent('cell', COARSE)})) AS coarse, round(clat, 6) AS lat, round(clon, 6) AS lon FROM r"))
def hex_requests(spark, d):
    """Requests shown at the middle of their cell, with the cell's published id and its ancestor's."""
    r = celled(V.requests(spark, d)).withColumn("centre", H.centre("cell"))
    return r.select("id", H.name(F.col("cell")).alias("cell"), H.name(H.parent(F.col("cell"), COARSE)).alias("coarse"), F.round("centre.lat", 6).alias("lat"), F.round("centre.lon", 6).alias("lon"))


_GROUPS = f"SELECT {hex_sql.parent('cell', COARSE)} AS cell, hazard_type, t // {S.DAY} AS day, count(*) AS n FROM r WHERE status = 'verified' GROUP BY ALL"
_U = "(('0x' || substr(sha256('seed-1' || ':' || cell || ':' || hazard_type || ':' || day), 1, 12))::BIGINT + 0.5) / 281474976710656 - 0.5"


@query(
    "opendata_release",
    _sql("reports", "SELECT lower(hex(cell)) AS cell, hazard_type, day, greatest(0, round(n - sign(u) * ln(1 - 2 * abs(u)) / 1.0))::BIGINT AS report_count FROM x", g=_GROUPS, x=f"SELECT *, {_U} AS u FROM g WHERE n >= 5"),
)
def opendata_release(spark, d):
    """Noisy counts of verified reports by coarse cell, hazard and day, for groups of five and more."""
    r = celled(V.reports(spark, d).filter("status = 'verified'"))
    r = r.select(H.parent(F.col("cell"), COARSE).alias("cell"), "hazard_type", F.floor(F.col("t") / S.DAY).alias("day"))
    released = privacy.release(r, ["cell", "hazard_type", "day"], k=5, epsilon=1.0, seed="seed-1")
    return released.withColumn("cell", H.name(F.col("cell")))


_OLD = f"t < (SELECT max(t) FROM reports) - {12 * S.DAY}"


@query("retention_anonymise", _sql("reports", f"SELECT id, round(CASE WHEN {_OLD} THEN clat ELSE lat::DOUBLE END, 6) AS lat, round(CASE WHEN {_OLD} THEN clon ELSE lon::DOUBLE END, 6) AS lon, {_OLD} AS anonymised FROM r"))
def retention_anonymise(spark, d):
    """Reports older than twelve days move to the middle of their cell."""
    r = V.reports(spark, d)
    now = r.agg(F.max("t").alias("now"))
    old = F.col("t") < F.col("now") - 12 * S.DAY
    shown = celled(r).withColumn("centre", H.centre("cell")).crossJoin(F.broadcast(now))
    place = lambda c: F.round(F.when(old, F.col(f"centre.{c}")).otherwise(F.col(c).cast("double")), 6).alias(c)
    return shown.select("id", place("lat"), place("lon"), old.alias("anonymised"))


@query(
    "hex_fences",
    oracle(
        ["reports", "requests"],
        f"SELECT f.id, sum(s.n)::BIGINT AS n_reports, count(*) AS n_cells FROM f JOIN s ON s.face = f.face AND greatest(abs(s.a - f.a), abs(s.b - f.b), abs((s.a - f.a) - (s.b - f.b))) <= {RINGS} GROUP BY f.id",
        cells=hex_sql.cells(_PLACES["reports"] + " UNION ALL " + _PLACES["requests"], RES),
        f=_CELLED.format("requests"),
        s=f"SELECT cell, face, a, b, count(*) AS n FROM ({_CELLED.format('reports')}) WHERE status = 'verified' GROUP BY ALL",
    ),
)
def hex_fences(spark, d):
    """For each request with reports nearby: verified reports, and cells that hold any, within two steps of its cell."""
    reports = celled(V.reports(spark, d).filter("status = 'verified'")).groupBy("cell").agg(F.count("*").alias("n"))
    asks = celled(V.requests(spark, d)).select("id", F.col("cell").alias("home"))
    fences = asks.select("home").distinct().withColumn("cell", F.explode(H.disk(F.col("home"), RINGS)))
    by_home = fences.join(reports, "cell").groupBy("home").agg(F.sum("n").alias("n_reports"), F.count("*").alias("n_cells"))
    return asks.join(by_home, "home").select("id", "n_reports", "n_cells")
