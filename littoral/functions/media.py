"""Pictures and encoded lines, as vectorised functions over columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def degrees_of(dms: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds to degrees; south and west are negative."""
    value = dms[0] + dms[1] / 60 + dms[2] / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def _dct(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


@F.pandas_udf(T.StringType())
def perceptual_hash(gray: pd.Series) -> pd.Series:
    """64 bits in hexadecimal from 32 x 32 grey values in rows: signs of the low cosine frequencies about their median.
    Null unless there are 1024 values."""
    c = _dct(32)

    def one(values) -> str | None:
        if values is None or len(values) != 1024:
            return None
        low = (c @ np.asarray(values, dtype=float).reshape(32, 32) @ c.T)[:8, :8].ravel()
        bits = low > np.median(low)
        return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"

    return gray.map(one)


STATS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("brightness", "contrast", "water_fraction", "edge_density")])


@F.pandas_udf(STATS)
def image_stats(rgb: pd.Series) -> pd.DataFrame:
    """Of square RGB pictures, bytes in rows: mean and deviation of all values, the share of pixels in which blue
    dominates, and the mean response of the grey picture to an edge filter (8 times the pixel less its neighbours; the
    outermost pixels stay as they are). All from 0 to 1, to four places; null unless the bytes are a square picture."""

    def one(data) -> tuple[float | None, ...]:
        side = int(round((len(data or b"") / 3) ** 0.5))
        if not data or side * side * 3 != len(data):
            return (None,) * 4
        a = np.frombuffer(data, dtype=np.uint8).reshape(side, side, 3).astype(np.int64)
        r, g, b = (a[..., i] for i in range(3))
        grey = (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16
        edges = grey.copy()
        if side > 2:
            around = sum(grey[i : side - 2 + i, j : side - 2 + j] for i in range(3) for j in range(3))
            edges[1:-1, 1:-1] = np.clip(9 * grey[1:-1, 1:-1] - around, 0, 255)
        x = a / 255.0
        water = (b > r) & (x[..., 2] >= x[..., 1] * 0.95)
        return tuple(round(float(v), 4) for v in (x.mean(), x.std(), water.mean(), (edges / 255.0).mean()))

    return pd.DataFrame([one(v) for v in rgb], columns=STATS.names, dtype=float)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])))
def decode_polyline(encoded: pd.Series) -> pd.Series:
    """Points of a polyline of six decimals."""

    def one(text) -> list[dict] | None:
        if text is None:
            return None
        out, lat, lon, values, value, shift = [], 0, 0, [], 0, 0
        for ch in text:
            b = ord(ch) - 63
            value |= (b & 31) << shift
            shift += 5
            if b < 32:
                values.append(~(value >> 1) if value & 1 else value >> 1)
                value = shift = 0
        for dlat, dlon in zip(values[::2], values[1::2]):
            lat, lon = lat + dlat, lon + dlon
            out.append({"lon": lon / 1e6, "lat": lat / 1e6})
        return out

    return encoded.map(one)


def halves(digest: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of a 64-bit hash in hexadecimal."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
