"""Registered queries over pictures. Their bytes are made by Spark from orders: the headers that cameras write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import media_intake
from ..operators import series as S
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


def _number(value: Column | int, digits: int = 8) -> Column:
    return F.lit(f"{value:0{digits}x}") if isinstance(value, int) else F.lpad(F.hex(value.cast("long")), digits, "0")


def _field(tag: Column | int, kind: int, count: int, value: Column | int) -> Column:
    return F.concat(_number(tag, 4), _number(kind, 4), _number(count), _number(value))


def _dms(seconds: Column) -> Column:
    parts = (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60 * 100)
    return F.concat(*(x for part, scale in zip(parts, (1, 1, 100)) for x in (_number(part), _number(scale))))


def header(lat_seconds: Column, lon_seconds: Column, placed: Column, taken: Column, timed: Column) -> Column:
    """A JPEG's bytes up to its directories, big-endian: place in seconds of arc north and east, time as text. What isn't
    ``placed`` or ``timed`` has a field of another number in place of the one that leads there."""
    first = F.concat(_number(2, 4), _field(F.when(placed, 0x8825).otherwise(0x8826), 4, 1, 38), _field(F.when(timed, 0x8769).otherwise(0x876A), 4, 1, 140), _number(0))
    gps = F.concat(_number(4, 4), _field(1, 2, 2, 0x4E000000), _field(2, 5, 3, 92), _field(3, 2, 2, 0x45000000), _field(4, 5, 3, 116), _number(0))
    details = F.concat(_number(1, 4), _field(0x9003, 2, 20, 158), _number(0))
    tiff = F.concat(F.lit("4d4d002a00000008"), first, gps, _dms(lat_seconds), _dms(lon_seconds), details, F.hex(F.encode(taken, "UTF-8")), F.lit("00"))
    return F.unhex(F.concat(F.lit("ffd8ffe1"), _number(2 + 6 + 178, 4), F.hex(F.lit("Exif")), F.lit("0000"), tiff, F.lit("ffd9")))


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """Reports with pictures, made of orders. A picture was taken up to seven hundredths of a degree north of the claimed
    place and up to eight hours before; one report in five has none, one picture in three has no place, one in four no
    time. Some share a hash."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), V.micros("o_orderdate").alias("t"), (1290 + F.col("o_custkey") % 20).alias("row"), (8010 + F.col("o_custkey") % 15).alias("col"))
    k = F.col("id")
    taken = F.expr(f"date_format(timestampadd(MICROSECOND, t - id % 9 * {S.HOUR}, TIMESTAMP_NTZ'1970-01-01 00:00:00'), 'yyyy:MM:dd HH:mm:ss')")
    picture = header((F.col("row") + k % 8) * 36, F.col("col") * 36, k % 3 > 0, taken, k % 4 > 0)
    phash = F.substring(F.sha2((k * 7919 % 6007).cast("string"), 256), 1, 16)
    shown = k % 5 != 0
    return o.select("id", "t", (F.col("row") / 100).alias("lat"), (F.col("col") / 100).alias("lon"), F.when(shown, picture).alias("picture"), F.when(shown, phash).alias("phash"))


_PICTURES = """SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AS shown, (1290 + o_custkey % 20) / 100 AS lat, (8010 + o_custkey % 15) / 100 AS lon,
  CASE WHEN o_orderkey % 3 > 0 THEN (1290 + o_custkey % 20 + o_orderkey % 8) / 100 END AS plat, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 9)::DOUBLE END AS hours FROM orders"""


@query(
    "media_forensics",
    oracle(
        [],
        "SELECT p.id, km AS gps_km, hours AS time_offset_hours, earlier AS reused, CASE WHEN NOT shown THEN 0.5 WHEN earlier THEN 0.0 WHEN km > 5 THEN 0.2 WHEN hours > 6 THEN 0.4 WHEN km IS NULL AND hours IS NULL THEN 0.6 ELSE 1.0 END::DOUBLE AS score FROM m p",
        p=_PICTURES,
        m=f"SELECT id, shown, CASE WHEN shown THEN round({km('lat', 'lon', 'plat', 'lon')}, 2) END AS km, CASE WHEN shown THEN hours END AS hours, CASE WHEN shown THEN row_number() OVER (PARTITION BY id * 7919 % 6007, shown ORDER BY id) > 1 END AS earlier FROM p",
    ),
)
def media_forensics(spark, d):
    """What each report's picture says against the report: kilometres, hours, whether it was seen before; and the score."""
    r = pictures(spark, d)
    out = media_intake.attached(r, media_intake.forensics(r))
    return out.select("id", "media_forensics.gps_km", "media_forensics.time_offset_hours", "media_forensics.reused", F.col("media_score").alias("score"))
