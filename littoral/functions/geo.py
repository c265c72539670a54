"""Distances and a square grid, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371.0, 111.320


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def square_cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Row and column of the square of this side that holds the point."""
    return F.floor(lat / degrees).cast("int"), F.floor(lon / degrees).cast("int")


def ring(row: Column, col: Column, k: int = 1) -> Column:
    """Array of the (row, col) within k steps, the own one included."""
    return F.array(*(F.struct((row + i).alias("row"), (col + j).alias("col")) for i in range(-k, k + 1) for j in range(-k, k + 1)))


def cell_ring(row: Column, col: Column, degrees: float) -> Column:
    """The cell's outline as a closed array of struct lon, lat, from its lower left corner, counter-clockwise."""
    corner = lambda i, j: F.struct(F.round((col + j) * degrees, 6).alias("lon"), F.round((row + i) * degrees, 6).alias("lat"))
    return F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))


def cell_centre(row: Column, col: Column, degrees: float) -> tuple[Column, Column]:
    """Latitude and longitude of the cell's middle."""
    return F.round((row + 0.5) * degrees, 6), F.round((col + 0.5) * degrees, 6)


def disk(row: Column, col: Column, k: int) -> Column:
    """As ring(), for larger k: made of two sequences."""
    rows, cols = F.sequence(row - k, row + k), F.sequence(col - k, col + k)
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("row"), c.alias("col")))))


def km_to_degrees(km: float, lat_max: float = 0.0) -> float:
    """Degrees that are at least this far along a parallel up to the latitude."""
    return km / (DEGREE_KM * math.cos(math.radians(min(abs(lat_max), 89.0)))) + 1e-9


def in_ring(lat: Column, lon: Column, polygon: Column) -> Column:
    """Whether the point lies in the polygon (array of struct lat, lon; closed or not), by even crossings; JVM-side."""
    n = F.size(polygon)
    shifted = F.concat(F.slice(polygon, 2, F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1))
    crossings = F.filter(
        F.arrays_zip(polygon.alias("a"), shifted.alias("b")),
        lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
        & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
    )
    return F.size(crossings) % 2 == 1


def on_ring(lat: Column, lon: Column, polygon: Column, slack: float = 1e-12) -> Column:
    """Whether the point lies on an edge of the polygon."""
    n = F.size(polygon)
    shifted = F.concat(F.slice(polygon, 2, F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1))
    between = lambda x, a, b: (x >= F.least(a, b) - slack) & (x <= F.greatest(a, b) + slack)
    return F.exists(
        F.arrays_zip(polygon.alias("a"), shifted.alias("b")),
        lambda e: (F.abs((e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) - (e["b"]["lat"] - e["a"]["lat"]) * (lon - e["a"]["lon"])) <= slack)
        & between(lat, e["a"]["lat"], e["b"]["lat"])
        & between(lon, e["a"]["lon"], e["b"]["lon"]),
    )
