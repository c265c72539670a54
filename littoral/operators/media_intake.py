"""Pictures that come with reports and damage claims: what they show of themselves, and the rows that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hexagons, media, scoring
from ..functions.exif import exif
from ..functions.geo import haversine_km
from .commands import envelope
from .spatial import near_hashes


def reused(pictures: DataFrame) -> DataFrame:
    """id of each picture (id, phash) that is like an earlier one."""
    hi, lo = media.halves(F.col("phash"))
    return near_hashes(pictures.filter("phash IS NOT NULL").select("id", hi.alias("hi"), lo.alias("lo")))


def forensics(reports: DataFrame) -> DataFrame:
    """The media row of each report with a picture: id, phash, exif, gps_km, time_offset_hours, reused and media_score, from
    reports (id, t in microseconds, lat, lon, picture, phash). Kilometres and hours are those between what the report and
    its picture say, to two places; null where the picture doesn't say."""
    read = reports.filter("picture IS NOT NULL").withColumn("exif", exif("picture"))
    again = reused(read).withColumn("reused", F.lit(True))
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("exif.gps_lat"), F.col("exif.gps_lon")), 2)
    hours = F.round(F.abs(F.col("t") - F.unix_micros("exif.taken_at")) / 3_600_000_000, 2)
    rows = read.join(again, "id", "left").select("id", "phash", "exif", km.alias("gps_km"), hours.alias("time_offset_hours"), F.coalesce("reused", F.lit(False)).alias("reused"))
    return rows.withColumn("media_score", scoring.media(F.lit(True), F.col("reused"), F.col("gps_km"), F.col("time_offset_hours")).cast("double"))


def attached(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """reports with media_score and media_forensics (null without a picture) of their media rows."""
    facts = rows.select("id", F.struct("reused", "gps_km", "time_offset_hours").alias("media_forensics"), "media_score")
    nothing = scoring.media(F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(None).cast("double")).cast("double")
    return reports.join(facts, "id", "left").withColumn("media_score", F.coalesce("media_score", nothing))


def damage_claims(photos: DataFrame, stats: Column, res: int = 8) -> tuple[DataFrame, DataFrame]:
    """The damage rows of photos (id, lat, lon, phash, note) and their audit rows. ``stats`` is the photo's statistics, as
    media.image_stats gives them; a photo that can't be read makes no row, since the claim is the photo."""
    kind, severity, sure = scoring.damage(F.col("stats.water_fraction"), F.col("stats.edge_density"))
    seen = photos.withColumn("stats", stats).filter("stats.water_fraction IS NOT NULL")
    rows = seen.select(
        "id", "lat", "lon", hexagons.name(hexagons.cell(F.col("lat"), F.col("lon"), res)).alias("cell"), "phash",
        kind.alias("damage_class"), severity.alias("severity"), sure.alias("cv_confidence"), F.lit("heuristic").alias("cv_mode"), F.lit("submitted").alias("status"), "note",
    )
    said = envelope("recovery.damage_assessed", "damage_assessment", F.col("id"), damage_class=F.col("damage_class"), severity=F.col("severity"), cv_mode=F.col("cv_mode"), h3_cell=F.col("cell"))
    return rows, rows.select("id", said.alias("envelope"))
