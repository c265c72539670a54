"""Density clusters of places, window by window, without comparing all points of a window.

Equal points are one place that counts as often. Places are put into tiles: runs of grid cells in Z-order with at most
``size`` places each, within which only near places meet (``planar``). A window of one tile is done by its task. In a
larger one core distances come from a tile and those tiles about it that can hold nearer places. The spanning tree over
mutual reachability is made of the trees of pairs of tiles: the tree of the whole has no edge that isn't in the tree of
some pair. A pair is left out where its boxes are farther apart than any edge on a way between them that is known before.
What is left for one task a window is linear: the edges of those trees, from which the condensed tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from . import planar
from .kernels import condensed, hdbscan


def _interleaved(x: F.Column, y: F.Column, bits: int) -> F.Column:
    """The Z-order number of a grid cell: bits of both indices in turn."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for axis, c in enumerate((x, y)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1)).cast("long"), 2 * k + axis))
    return out


def tiles(points: DataFrame, group: list[str], size: int, bits: int = 10) -> DataFrame:
    """points (group, id, x, y, and copies if not 1) to group, tile, box, and the tile's ids, xs, ys and ks (copies). Tiles
    are numbered along the Z-order of a grid of 2**bits cells a side over the window; a cell with more than ``size`` points
    is dealt out by id."""
    points = points if "copies" in points.columns else points.withColumn("copies", F.lit(1).cast("long"))
    extent = points.groupBy(*group).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("wide"))
    index = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("wide") * (1 << bits)), F.lit((1 << bits) - 1))
    placed = cut(points.join(extent, group).select(*group, "id", "x", "y", "copies", _interleaved(index("x"), index("y"), bits).alias("cell")))
    counts = placed.groupBy(*group, "cell").agg(F.count("*").alias("n")).withColumn("deals", F.ceil(F.col("n") / size))
    before = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("run", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size))
    dealt = placed.join(runs, [*group, "cell"]).withColumn("deal", F.pmod(F.xxhash64("id"), F.col("deals")))
    packed = dealt.groupBy(*group, "run", "deal").agg(
        F.array_sort(F.collect_list(F.struct("id", "x", "y", "copies"))).alias("p"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    tile = F.row_number().over(Window.partitionBy(*group).orderBy("run", "deal")).cast("int")
    columns = (F.col(f"p.{c}").alias(name) for c, name in (("id", "ids"), ("x", "xs"), ("y", "ys"), ("copies", "ks")))
    return cut(packed.select(*group, tile.alias("tile"), "x0", "x1", "y0", "y1", *columns))


def _apart(a: pd.Series, b: pd.DataFrame) -> np.ndarray:
    """Least distances between one box and others."""
    gap = lambda c: np.maximum(0, np.maximum(b[f"{c}0"] - a[f"{c}1"], a[f"{c}0"] - b[f"{c}1"]))
    return np.hypot(gap("x"), gap("y")).to_numpy() * (1 - 1e-12)


def _pairs(summary: DataFrame, group: list[str], near) -> DataFrame:
    """group, a, b: the pairs of tiles that ``near`` gives for each window's table of boxes, sorted by tile."""
    kinds = dict(summary.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", a int, b int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile").reset_index(drop=True)
        a, b = near(pdf)
        out = pd.DataFrame({"a": pdf["tile"].to_numpy()[a], "b": pdf["tile"].to_numpy()[b]}).astype("int32")
        for g in reversed(group):
            out.insert(0, g, pdf[g].iloc[0])
        return out

    return summary.groupBy(*group).applyInPandas(run, schema)


def _met(pairs: DataFrame, packed: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Pairs of tiles with the columns of both, those of b with a 2 behind their names."""
    left = packed.select(*group, F.col("tile").alias("a"), *columns)
    right = packed.select(*group, F.col("tile").alias("b"), *(F.col(c).alias(f"{c}2") for c in columns))
    return pairs.join(left, [*group, "a"]).join(right, [*group, "b"])


def _by_row(frame: DataFrame, group: list[str], schema: str, step) -> DataFrame:
    """One small table for each row of ``frame``, with the row's group before it. Rows are few and much work each, so
    they are dealt out anew: by size they would end up in a few tasks."""
    names = list(group)
    frame = frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "tile" if "tile" in frame.columns else "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.to_dict("records"):
                out = step(r)
                for g in reversed(names):
                    out.insert(0, g, r[g])
                yield out

    kinds = dict(frame.dtypes)
    return frame.mapInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", " + schema)


def core_distances(packed: DataFrame, group: list[str], least: int) -> DataFrame:
    """group, tile, cores: how far each point of a tile is from the ``least``-th nearest point, itself the first; infinite
    in a window of fewer points."""
    columns = ["xs", "ys", "ks"]
    own = lambda r: planar.cores(np.column_stack((r["xs"], r["ys"])), np.asarray(r["ks"]), least)

    def reach(r: dict) -> pd.DataFrame:
        return pd.DataFrame({c: [r[c]] for c in ("tile", "x0", "x1", "y0", "y1")} | {"reach": [own(r).max()]})

    boxes = _by_row(packed.select(*group, "tile", "x0", "x1", "y0", "y1", *columns), group, "tile int, x0 double, x1 double, y0 double, y1 double, reach double", reach)

    def near(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.flatnonzero(_apart(r, pdf) <= r["reach"]) for _, r in pdf.iterrows()]
        return np.repeat(np.arange(len(rows)), list(map(len, rows))), np.concatenate(rows)

    def nearest(r: dict) -> pd.DataFrame:
        x, y, u, v, k = (np.asarray(r[c]) for c in ("xs", "ys", "xs2", "ys2", "ks2"))
        at, by, d = planar.nearest(np.column_stack((x, y)), np.column_stack((u, v)), own(r), least)
        return pd.DataFrame({"tile": np.int32(r["a"]), "k": at.astype("int32"), "d": d, "copies": k[by]})

    met = _met(_pairs(boxes, group, near), packed, group, columns)
    found = _by_row(met, group, "tile int, k int, d double, copies long", nearest)
    upto = F.sum("copies").over(Window.partitionBy(*group, "tile", "k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    kept = found.withColumn("upto", upto).filter(F.col("upto") >= least).groupBy(*group, "tile", "k").agg(F.min("d").alias("d"))
    lists = kept.groupBy(*group, "tile").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("c"))
    sized = packed.select(*group, "tile", F.size("xs").alias("size")).join(lists, [*group, "tile"], "left")
    none = F.array_repeat(F.lit(float("inf")), F.col("size"))
    return sized.select(*group, "tile", F.when(F.col("c").isNull(), none).otherwise(F.transform("c", lambda x: x["d"])).alias("cores"))


def tree_edges(packed: DataFrame, group: list[str]) -> DataFrame:
    """group, w, a, b: edges among which is a spanning tree over mutual reachability, from tiles with their cores."""

    def tree(r: dict) -> pd.DataFrame:
        same = r["a"] == r["b"]
        both = lambda c: np.asarray(r[c]) if same else np.concatenate((r[c], r[f"{c}2"]))
        ids = both("ids")
        w, a, b = planar.spanning_tree(np.column_stack((both("xs"), both("ys"))), both("cores"), ids)
        return pd.DataFrame({"tile": np.int32(r["a"]), "w": w, "a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    columns, schema = ["ids", "xs", "ys", "cores"], "tile int, w double, a long, b long"
    number = Window.partitionBy(*group).orderBy("tile")
    chain = packed.select(*group, F.col("tile").alias("a"), F.coalesce(F.lead("tile").over(number), F.col("tile")).alias("b"))
    first = cut(_by_row(_met(chain, packed, group, columns), group, schema, tree))
    ways = first.groupBy(*group, "tile").agg(F.max("w").alias("way"))
    boxes = packed.select(*group, "tile", "x0", "x1", "y0", "y1").join(ways, [*group, "tile"], "left")

    def near(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
        way = pdf["way"].fillna(0).to_numpy()
        for i in range(len(pdf) - 2):
            known = np.maximum.accumulate(way[i:-1])[1:]  # the longest edge on the way along the chain
            j = i + 2 + np.flatnonzero(_apart(pdf.iloc[i], pdf.iloc[i + 2 :]) <= known)
            a.append(np.full(len(j), i))
            b.append(j)
        return np.concatenate(a), np.concatenate(b)

    rest = _by_row(_met(_pairs(boxes, group, near), packed, group, columns), group, schema, tree)
    return cut(first.unionByName(rest).drop("tile").distinct())


def _kept(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"id": ids, "cluster": label.astype("int32")})
    return out[out["cluster"] >= 0]


def clusters(points: DataFrame, group: list[str], least: int = 5, size: int = 50_000) -> DataFrame:
    """group, id, cluster of the points (id, x, y) of each group that are in a density cluster; noise goes. ids are unique
    within a group. Groups of fewer than twice ``least`` points have no cluster; those of one tile need no joins."""
    wanted = cut(points.select(*group, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    places = wanted.groupBy(*group, "x", "y").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    packed = tiles(places, group, size)
    several = cut(packed.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").select(*group))
    schema = "id long, cluster int"

    def one(r: dict) -> pd.DataFrame:
        return _kept(r["ids"], hdbscan(np.column_stack((r["xs"], r["ys"])), least, np.asarray(r["ks"]), np.asarray(r["ids"])))

    found = _by_row(packed.join(several, group, "left_anti"), group, schema, one)
    if not several.isEmpty():
        packed = cut(packed.join(several, group))
        cored = cut(packed.join(core_distances(packed, group, least), [*group, "tile"]))
        edges = tree_edges(cored, group)
        kinds = dict(edges.dtypes)
        held = packed.select(*group, F.explode(F.arrays_zip("ids", "ks")).alias("p")).select(*group, F.lit(None).cast("double").alias("w"), F.col("p.ids").alias("a"), F.col("p.ks").alias("b"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            copies, known = pdf[pdf["w"].isna()].sort_values("a"), pdf[pdf["w"].notna()].sort_values(["w", "a", "b"])
            ids = copies["a"].to_numpy()
            a, b = (np.searchsorted(ids, known[c].to_numpy()) for c in "ab")
            kept = planar.lightest(len(ids), a, b)
            out = _kept(ids, condensed(known["w"].to_numpy()[kept], a[kept], b[kept], least, copies["b"].to_numpy(), ids))
            for g in reversed(group):
                out.insert(0, g, pdf[g].iloc[0])
            return out

        found = found.unionByName(edges.unionByName(held).groupBy(*group).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in group) + ", " + schema))
    labels = found.join(places, [*group, "id"]).select(*group, "x", "y", "cluster")
    return wanted.join(labels, [*group, "x", "y"]).select(*group, "id", "cluster")


def hotspots(points: DataFrame, group: list[str], least: int = 5, size: int = 50_000) -> DataFrame:
    """Density clusters of the places (id, lat, lon) of each group, on kilometres about the group's mean latitude, to the
    millimetre: so equal distances stay equal in whatever order the mean was summed."""
    mean = points.groupBy(*group).agg(F.avg("lat").alias("_middle"))
    x = F.col("lon") * 111.320 * F.cos(F.radians("_middle"))
    placed = points.join(mean, group)
    return clusters(placed.select(*group, "id", F.round(x, 6).alias("x"), F.round(F.col("lat") * 110.574, 6).alias("y")), group, least, size)
