"""Place and time of pictures, from the directories in their headers."""

from __future__ import annotations

import math
import struct
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers of the fields, and bytes of a value by its type.
GPS, DETAILS, TAKEN = 0x8825, 0x8769, 0x9003
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

EXIF = T.StructType([T.StructField("gps_lat", T.DoubleType()), T.StructField("gps_lon", T.DoubleType()), T.StructField("taken_at", T.TimestampType())])


def directories(picture: bytes) -> bytes | None:
    """The header's directories: those of the first such segment of a JPEG, or the whole of a TIFF."""
    if picture[:4] in (b"II*\0", b"MM\0*"):
        return picture
    at = 2
    while picture[:2] == b"\xff\xd8" and at + 4 <= len(picture) and picture[at] == 0xFF and picture[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(picture[at + 2 : at + 4], "big")
        if picture[at + 1] == 0xE1 and picture[at + 4 : at + 10] == b"Exif\0\0":
            return picture[at + 10 : at + 2 + size]
        at += 2 + size
    return None


class Directories:
    def __init__(self, data: bytes) -> None:
        self.data, self.order = data, {b"II": "<", b"MM": ">"}[data[:2]]
        self.first = self.read("I", 4)

    def read(self, kind: str, at: int):
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def fields(self, at: int) -> dict[int, tuple[int, int, int]]:
        """Type, count and place of the value of each field of the directory at this place."""
        out = {}
        for k in range(self.read("H", at)):
            entry = at + 2 + 12 * k
            kind, count = self.read("H", entry + 2), self.read("I", entry + 4)
            inside = SIZES.get(kind, 1) * count <= 4
            out[self.read("H", entry)] = kind, count, entry + 8 if inside else self.read("I", entry + 8)
        return out

    def text(self, field: tuple[int, int, int]) -> str:
        return self.data[field[2] : field[2] + field[1]].split(b"\0")[0].decode("ascii")

    def degrees(self, field: tuple[int, int, int], ref: str) -> float:
        parts = [self.read("I", field[2] + 8 * k) / self.read("I", field[2] + 8 * k + 4) for k in range(3)]
        value = parts[0] + parts[1] / 60 + parts[2] / 3600
        return -value if ref in ("S", "W") else value


_BROKEN = (struct.error, KeyError, ValueError, ZeroDivisionError, UnicodeDecodeError)


def read(picture: bytes | None) -> tuple[float | None, float | None, datetime | None]:
    """Latitude, longitude and time; None for what is missing or broken. A place needs both coordinates, in range."""
    place: tuple[float | None, float | None] = (None, None)
    taken = None
    try:
        d = Directories(directories(bytes(picture or b"")) or b"")
        first = d.fields(d.first)
    except _BROKEN:
        return None, None, None
    try:
        gps = d.fields(d.read("I", first[GPS][2]))
        ref = lambda tag, usual: d.text(gps[tag]) if tag in gps else usual
        lat, lon = d.degrees(gps[LAT], ref(LAT_REF, "N")), d.degrees(gps[LON], ref(LON_REF, "E"))
        if math.isfinite(lat + lon) and abs(lat) <= 90 and abs(lon) <= 180:
            place = lat, lon
    except _BROKEN:
        pass
    try:
        taken = datetime.strptime(d.text(d.fields(d.read("I", first[DETAILS][2]))[TAKEN]), "%Y:%m:%d %H:%M:%S")
    except _BROKEN:
        pass
    return *place, taken


@F.pandas_udf(EXIF)
def exif(pictures: pd.Series) -> pd.DataFrame:
    """gps_lat, gps_lon and taken_at (as UTC) of JPEG or TIFF bytes of either byte order; nulls where they can't be told."""
    rows = [read(p) for p in pictures]
    taken = pd.to_datetime(pd.Series([r[2] for r in rows], dtype="object"), utc=True)
    return pd.DataFrame({"gps_lat": pd.Series([r[0] for r in rows], dtype=float), "gps_lon": pd.Series([r[1] for r in rows], dtype=float), "taken_at": taken})
