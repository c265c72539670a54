"""Headers of pictures, and the rows that follow from pictures."""

import json
import struct
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from littoral.functions import exif, media
from littoral.operators import media_intake


def tiff(order, lat=(13, 4, 5748), lon=(80, 16, 3000), refs=("N", "E"), taken="2024:05:06 07:08:09", gps=True):
    pack = lambda kind, *v: struct.pack(order + kind, *v)
    field = lambda tag, kind, count, value: pack("HHI", tag, kind, count) + (value if isinstance(value, bytes) else pack("I", value))
    dms = lambda x: pack("6I", x[0], 1, x[1], 1, x[2], 100)
    first = pack("H", 3) + field(0x0100, 3, 1, pack("H", 7) + b"\0\0") + field(exif.GPS if gps else 0x1234, 4, 1, 50) + field(exif.DETAILS, 4, 1, 152) + pack("I", 0)
    places = pack("H", 4) + field(1, 2, 2, refs[0].encode() + b"\0\0\0") + field(2, 5, 3, 104) + field(3, 2, 2, refs[1].encode() + b"\0\0\0") + field(4, 5, 3, 128) + pack("I", 0)
    text = taken.encode() + b"\0"
    details = pack("H", 1) + field(exif.TAKEN, 2, len(text), 170) + pack("I", 0)
    return (b"II*\0" if order == "<" else b"MM\0*") + pack("I", 8) + first + places + dms(lat) + dms(lon) + details + text


def jpeg(body, before=b"\xff\xe0\0\x06JFIF"):
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_both_byte_orders(order):
    lat, lon = 13 + 4 / 60 + 57.48 / 3600, 80 + 16 / 60 + 30 / 3600
    for picture in (tiff(order), jpeg(tiff(order)), jpeg(tiff(order), b"")):
        assert exif.read(picture) == (pytest.approx(lat), pytest.approx(lon), datetime(2024, 5, 6, 7, 8, 9))
    assert exif.read(tiff(order, refs=("S", "W")))[:2] == (pytest.approx(-lat), pytest.approx(-lon))
    assert exif.read(tiff(order, gps=False)) == (None, None, datetime(2024, 5, 6, 7, 8, 9))


def test_broken_headers_give_nulls():
    whole = jpeg(tiff("<"))
    for n in range(len(whole)):  # wherever it is cut
        place = exif.read(whole[:n])
        assert len(place) == 3
    for picture in (None, b"", b"no picture", b"\xff\xd8", b"II*\0", b"II*\0\xff\xff\xff\xff", jpeg(b"XX*\0")):
        assert exif.read(picture) == (None, None, None)
    assert exif.read(tiff("<", lat=(130, 0, 0)))[:2] == (None, None)
    assert exif.read(tiff("<", taken="soon"))[2] is None and exif.read(tiff("<", taken="soon"))[0] is not None


def test_forensics(spark):
    t = int(datetime(2024, 5, 6, 10, 8, 9, tzinfo=timezone.utc).timestamp() * 1e6)
    rows = [
        (1, t, 13.0826, 80.275, jpeg(tiff("<")), "00000000000000ff"), (2, t, 14.0, 80.275, jpeg(tiff(">")), "ffff0000ffff0000"),
        (3, t, 13.0, 80.0, b"x", "00000000000000f0"), (4, t, 13.0, 80.0, None, None), (5, t, 13.0, 80.0, b"y", None),
    ]
    df = spark.createDataFrame(rows, "id long, t long, lat double, lon double, picture binary, phash string")
    media_rows = {r["id"]: r for r in media_intake.forensics(df).collect()}
    assert sorted(media_rows) == [1, 2, 3, 5] and media_rows[1]["time_offset_hours"] == 3.0 and media_rows[1]["gps_km"] < 0.1 and media_rows[1]["media_score"] == 1.0
    assert media_rows[2]["gps_km"] > 100 and media_rows[2]["media_score"] == 0.2
    assert media_rows[3]["reused"] and media_rows[3]["media_score"] == 0.0 and media_rows[5]["media_score"] == 0.6
    scores = {r["id"]: r["media_score"] for r in media_intake.attached(df, media_intake.forensics(df)).collect()}
    assert scores == {1: 1.0, 2: 0.2, 3: 0.0, 4: 0.5, 5: 0.6}


def test_damage_claims(spark):
    blue = np.tile(np.array([10, 20, 200], dtype=np.uint8), 64).tobytes()
    grey = np.full(8 * 8 * 3, 90, dtype=np.uint8).tobytes()
    photos = spark.createDataFrame([(1, 13.05, 80.28, "ab", "water", blue), (2, 13.05, 80.28, "cd", None, grey), (3, 13.0, 80.0, "ef", None, b"?")], "id long, lat double, lon double, phash string, note string, rgb binary")
    rows, audit = media_intake.damage_claims(photos, media.image_stats("rgb"))
    got = {r["id"]: r for r in rows.collect()}
    assert sorted(got) == [1, 2] and got[1]["damage_class"] == "flooding" and got[1]["severity"] == "destroyed" and got[2]["damage_class"] == "minor_or_none"
    assert got[1]["status"] == "submitted" and len(got[1]["cell"]) == 15
    said = {r["id"]: json.loads(r["envelope"]) for r in audit.collect()}
    assert said[1]["event_type"] == "recovery.damage_assessed" and said[1]["payload"]["h3_cell"] == got[1]["cell"] and said[2]["subject_id"] == "2"


def test_header_column(spark):
    from littoral.plans.catalog_media import header

    row = spark.range(1).select(header(F.lit(13 * 3600 + 61), F.lit(80 * 3600 + 5), F.lit(True), F.lit("2024:05:06 07:08:09"), F.lit(True)).alias("p")).select("p", exif.exif("p").alias("e")).first()
    assert exif.read(row["p"]) == (pytest.approx(13 + 61 / 3600), pytest.approx(80 + 5 / 3600), datetime(2024, 5, 6, 7, 8, 9)) and row["e"]["gps_lat"] == pytest.approx(13 + 61 / 3600)
