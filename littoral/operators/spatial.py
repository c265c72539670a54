"""Spatial joins on a square grid: equi-joins on cells with an exact test after them, never all pairs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_KM, haversine_km, km_to_degrees, ring, square_cell


def _celled(df: DataFrame, side: float, lat: str, lon: str) -> DataFrame:
    row, col = square_cell(F.col(lat), F.col(lon), side)
    return df.withColumns({"_row": row, "_col": col})


def within_km(left: DataFrame, right: DataFrame, km: float, on: list[str] | None = None, lat_max: float = 60.0, at: tuple[str, str, str, str] = ("lat", "lon", "rlat", "rlon")) -> DataFrame:
    """Pairs with equal ``on`` columns at most km apart, with km as distance_km. Cells are at least km wide, so the right
    side meets its own cell and the eight around it."""
    side = km_to_degrees(km, lat_max)
    l = _celled(left, side, at[0], at[1])  # noqa: E741
    r = _celled(right, side, at[2], at[3]).withColumn("_c", F.explode(ring(F.col("_row"), F.col("_col"))))
    r = r.withColumns({"_row": F.col("_c.row"), "_col": F.col("_c.col")}).drop("_c")
    pairs = l.join(r, [*(on or []), "_row", "_col"]).withColumn("distance_km", haversine_km(*(F.col(c) for c in at)))
    return pairs.filter(F.col("distance_km") <= km).drop("_row", "_col")


def within_km_by_place(left: DataFrame, right: DataFrame, km: float, on: list[str] | None = None, lat_max: float = 60.0, at: tuple[str, str, str, str] = ("lat", "lon", "rlat", "rlon")) -> DataFrame:
    """As within_km, where many rows have the same place: distances are taken between distinct places, and rows meet the
    rows of near places by equality alone. What is met by places is dealt out
    anew before it meets rows: by size it would end up in a few tasks."""
    keys = on or []
    near = within_km(left.select(*keys, *at[:2]).distinct(), right.select(*keys, *at[2:]).distinct(), km, on, lat_max, at)
    dealt = left.join(near, [*keys, *at[:2]]).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.join(right, [*keys, *at[2:]])


def nearest(left: DataFrame, right: DataFrame, key: str, name: str, side: float = 0.25, rounds: int = 6, at: tuple[str, str, str, str] = ("lat", "lon", "rlat", "rlon")) -> DataFrame:
    """Each left row's nearest right row (ties: smaller name): key, name, distance_km.

    Equal places are searched once. Round by round a place meets the right rows of its cell and the eight around it, in
    cells four times as wide each time; an answer counts once it is nearer than anything outside them can be. The last
    cells span the globe, so only places that are far from all right rows get that far.
    """
    spots = left.select(*at[:2]).distinct()
    todo, found = spots, None
    for i in range(rounds):
        last = i == rounds - 1
        width = 360.0 if last else side * 4**i
        r = _celled(right.select(name, *at[2:]), width, *at[2:])
        cells = _celled(todo, width, *at[:2]).withColumn("_c", F.explode(ring(F.col("_row"), F.col("_col"))))
        met = cells.withColumns({"_row": F.col("_c.row"), "_col": F.col("_c.col")}).drop("_c").join(r, ["_row", "_col"])
        d = haversine_km(*(F.col(c) for c in at))
        best = met.groupBy(*at[:2]).agg(F.min(F.struct(d.alias("d"), F.col(name).alias("name"))).alias("m")).select(*at[:2], "m.*")
        if not last:
            edge = F.least(F.abs(F.col(at[0])) + 2 * width, F.lit(90.0))
            best = best.filter(F.col("d") <= width * DEGREE_KM * F.cos(F.radians(edge)))
        found = best if found is None else found.unionByName(best)
        todo = todo.join(best.select(*at[:2]), list(at[:2]), "left_anti")
        if last or todo.isEmpty():
            break
    return left.join(found, list(at[:2])).select(key, F.col("name").alias(name), F.col("d").alias("distance_km"))


def nearest_of(lat: Column, lon: Column, places: list[tuple[str, float, float]]) -> Column:
    """Struct (d, name) of the nearest of a few fixed places."""
    return F.array_min(F.array(*(F.struct(haversine_km(lat, lon, F.lit(a), F.lit(b)).alias("d"), F.lit(n).alias("name")) for n, a, b in places)))


def covering_circles(points: DataFrame, circles: DataFrame, on: list[str], side: float = 0.25) -> DataFrame:
    """Pairs of points and circles (clat, clon, radius_km) with equal ``on``: the point is within the radius, ends count.
    A circle is put in every cell of its bounding box."""
    reach = F.col("radius_km") / DEGREE_KM
    wide = reach / F.cos(F.radians(F.least(F.abs("clat") + reach, F.lit(89.0))))
    rows = F.sequence(F.floor((F.col("clat") - reach) / side).cast("int"), F.floor((F.col("clat") + reach) / side).cast("int"))
    cols = F.sequence(F.floor((F.col("clon") - wide) / side).cast("int"), F.floor((F.col("clon") + wide) / side).cast("int"))
    c = circles.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols))
    met = _celled(points, side, "lat", "lon").join(c, [*on, "_row", "_col"])
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return met.withColumn("distance_km", d).filter(F.col("distance_km") <= F.col("radius_km")).drop("_row", "_col")


def sets_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cells: str) -> DataFrame:
    """Distinct (left_key, right_key) of rows whose ``cells`` arrays share an element."""
    l = left.select(left_key, F.explode(cells).alias("_c"))  # noqa: E741
    r = right.select(right_key, F.explode(cells).alias("_c"))
    return l.join(r, "_c").select(left_key, right_key).distinct()


def near_hashes(hashes: DataFrame, most: int = 6, together: int = 3) -> DataFrame:
    """Rows (id, hi, lo: the two 32-bit halves) for which an earlier id has a hash at most ``most`` bits away.

    Only the first id of each hash can make others reused, so hashes are compared once. Of most + together bands of bits
    at least ``together`` are equal in two such hashes: the keys are all choices of that many bands, 84 keys of 21 bits
    for the defaults. Two hashes that have nothing in common share one of these keys once in some 25,000 pairs.
    """
    first = hashes.groupBy("hi", "lo").agg(F.min("id").alias("first"))
    a = first.withColumn("key", F.explode(band_keys(most, together)))
    b = a.select("key", F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("first").alias("first2"))
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2")))
    seen = a.join(b, "key").filter((F.col("first2") < F.col("first")) & (apart <= most)).groupBy("hi", "lo").agg(F.min("first2").alias("earliest"))
    own = first.join(seen, ["hi", "lo"], "left").select("hi", "lo", F.least("first", F.coalesce("earliest", "first")).alias("earliest"))
    return hashes.join(own, ["hi", "lo"]).filter(F.col("earliest") < F.col("id")).select("id")


def band_keys(most: int, together: int) -> Column:
    """The keys of a hash (hi, lo): the number of a choice of bands and the hash with all other bits off, in one digest."""
    n = most + together
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for k, bands in enumerate(combinations(range(n), together)):
        mask = sum(1 << bit for b in bands for bit in range(edges[b], edges[b + 1]))
        halves = (F.col(c).bitwiseAND(F.lit(mask >> shift & 0xFFFFFFFF)) for c, shift in (("hi", 32), ("lo", 0)))
        keys.append(F.xxhash64(F.lit(k), *halves))
    return F.array(*keys)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
