"""A MinHash LSH forest as Spark jobs: sorted prefix tries, matched prefixes shortened until the target recall.

An item has a path of ``depth`` hash values in each tree. Sorted, the paths of a tree are its prefix trie: a node is a run
of rows that share a prefix. The runs are cut by ranges of (tree, path, item), so that a node of any size may lie in
several tasks; the tasks know each other's first and last runs, of which the driver gets one summary for each partition.

Two items of similarity s share a prefix of d values in one tree with probability s**d. An item looks into each tree at
the shortest prefix, from ``shortest`` on, under which at most ``crowd`` items lie, else at full depth. If the depths that
come of this don't give a partner at the threshold the target probability of being met, the item's bound is raised eight
times, and again, which shortens its matched prefixes, until they do. A node at which any item looks counts for all
items under it. So every pair at the threshold is met with at least the target probability, however crowded its nodes.

Items of a node with at most ``crowd`` items are linked if their whole signatures agree in enough places: five standard
deviations below the threshold, which one such pair in a million misses. Items of a larger node are all linked, by stars:
links are spanning forests, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions

#: Bytes of one hash value of a path.
WIDTH = 2


def gain(similarity: float, depth: int) -> float:
    """What a tree adds to the negative log of the probability that a pair isn't met, if looked into at this depth."""
    return -math.log1p(-(similarity**depth))


def shortest_for(similarity: float, recall: float, trees: int, shortest: int) -> int:
    """The longest prefix, up to ``shortest``, at which all trees together give the target recall."""
    while shortest > 1 and trees * gain(similarity, shortest) < -math.log(1 - recall):
        shortest -= 1
    return shortest


class Sorted:
    """A partition's rows in order: where the runs of each prefix length begin."""

    def __init__(self, batches: list[pa.RecordBatch], depth: int):
        t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.table, self.n = t, t.num_rows
        self.tree = t.column("tree").to_numpy()
        self.sid = t.column("sid").to_numpy()
        self.path = np.frombuffer(b"".join(t.column("path").to_pylist()), dtype=">u2").reshape(self.n, depth)
        other = np.logical_or.accumulate(self.path[1:] != self.path[:-1], axis=1) | (self.tree[1:] != self.tree[:-1])[:, None]
        self.new = np.concatenate((np.ones((1, depth), dtype=bool), other))

    def key(self, i: int, d: int) -> tuple[int, bytes]:
        return int(self.tree[i]), self.path[i, :d].tobytes()


def _collected(batches: Iterator[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return [b for b in batches if b.num_rows]


def borders(rows: DataFrame, depth: int) -> list[dict]:
    """For each partition of sorted rows, about its first and last run at each depth: the whole run's size, and the least
    ``asked`` and the least sid in it, over all partitions."""
    asks = "asked" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := _collected(batches)):
            return
        s = Sorted(held, depth)
        asked = s.table.column("asked").to_numpy() if asks else np.full(s.n, depth)
        out: dict = {"part": TaskContext.get().partitionId()}
        for name, i in (("first", 0), ("last", s.n - 1)):
            out[f"{name}_tree"], out[f"{name}_path"] = s.key(i, depth)
        ends = [np.append(np.flatnonzero(s.new[:, d]), s.n) for d in range(depth)]
        out["runs"] = [len(e) - 1 for e in ends]
        out["first_n"], out["last_n"] = [int(e[1]) for e in ends], [int(s.n - e[-2]) for e in ends]
        for name, of in (("asked", asked), ("sid", s.sid)):
            out[f"first_{name}"], out[f"last_{name}"] = [int(of[: e[1]].min()) for e in ends], [int(of[e[-2] :].min()) for e in ends]
        yield pa.RecordBatch.from_pylist([out], schema)

    long, many = pa.int64(), pa.list_(pa.int64())
    kinds = {"part": long, "first_tree": long, "first_path": pa.binary(), "last_tree": long, "last_path": pa.binary(), "runs": many, "first_n": many, "last_n": many, "first_asked": many, "last_asked": many, "first_sid": many, "last_sid": many}
    schema = pa.schema(list(kinds.items()))
    spark_types = {long: "long", many: "array<long>", pa.binary(): "binary"}
    got = rows.mapInArrow(run, ", ".join(f"{k} {spark_types[t]}" for k, t in kinds.items())).collect()  # one row for each partition
    parts = {r.part: r.asDict() for r in got}
    known: dict[tuple, list[int]] = {}
    named = lambda r, end, d: (r[f"{end}_tree"], bytes(r[f"{end}_path"])[: WIDTH * (d + 1)])
    for r in parts.values():
        for d in range(depth):
            for end in ("first", "last") if r["runs"][d] > 1 else ("first",):
                n, asked, sid = (r[f"{end}_{c}"][d] for c in ("n", "asked", "sid"))
                of = known.setdefault(named(r, end, d), [0, asked, sid])
                known[named(r, end, d)] = [of[0] + n, min(of[1], asked), min(of[2], sid)]
    out: list[dict] = [{} for _ in range(max(parts, default=-1) + 1)]
    for p, r in parts.items():
        out[p] = {end: [known[named(r, end, d)] for d in range(depth)] for end in ("first", "last")}
    return out


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    return cut(rows.repartitionByRange(parts, "tree", "path", "sid").sortWithinPartitions("tree", "path", "sid"))


def matched(forest: DataFrame, depth: int, shortest: int) -> DataFrame:
    """The rows (tree, path, sid) whose shortest prefix isn't theirs alone, with sizes: of its node at each depth from there."""
    known = forest.sparkSession.sparkContext.broadcast(borders(forest, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := _collected(batches)):
            return
        s, ends = Sorted(held, depth), known.value[TaskContext.get().partitionId()]
        sizes = np.empty((s.n, depth - shortest + 1), dtype=np.int64)
        for d in range(shortest - 1, depth):
            of = np.cumsum(s.new[:, d]) - 1
            n = np.bincount(of)
            n[0], n[-1] = ends["first"][d][0], ends["last"][d][0]
            sizes[:, d - shortest + 1] = n[of]
        at = np.flatnonzero(sizes[:, 0] > 1)
        for k in range(0, len(at), 50_000):
            take = pa.array(at[k : k + 50_000])
            flat = sizes[at[k : k + 50_000]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([s.table.column("tree").take(take), s.table.column("path").take(take), s.table.column("sid").take(take), lists], ["tree", "path", "sid", "sizes"])

    return cut(forest.mapInArrow(run, "tree int, path binary, sid long, sizes array<long>"))


def _depth_at(bound: float, shortest: int, depth: int) -> Column:
    """The shortest prefix whose node holds at most ``bound`` items, else the whole path."""
    out = F.lit(depth)
    for d in range(depth - 1, shortest - 1, -1):
        out = F.when(F.col("sizes")[d - shortest] <= bound, d).otherwise(out)
    return out


def asked_depths(crowded: DataFrame, similarity: float, recall: float, trees: int, depth: int, shortest: int, crowd: int) -> DataFrame:
    """crowded rows with asked: the depth at which their item looks into this tree, after shortening."""
    allowed = trees * gain(similarity, shortest) + math.log(1 - recall)  # what an item may lose against the shortest prefixes
    bounds = [float(crowd * 8**k) for k in range(12)] + [math.inf]
    lost = F.array(*(F.lit(gain(similarity, shortest) - gain(similarity, d)) for d in range(shortest, depth + 1)))
    sums = crowded.groupBy("sid").agg(*(F.sum(lost[_depth_at(b, shortest, depth) - shortest]).alias(f"lost{k}") for k, b in enumerate(bounds)))
    level = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        level = F.when(F.col(f"lost{k}") <= allowed, k).otherwise(level)
    asked = F.lit(None).cast("int")
    for k, b in enumerate(bounds):
        asked = F.when(F.col("level") == k, _depth_at(b, shortest, depth)).otherwise(asked)
    return crowded.join(sums.select("sid", level.alias("level")), "sid").select("tree", "path", "sid", "sizes", asked.alias("asked"))


def looked_at(asking: DataFrame, depth: int, shortest: int, crowd: int) -> DataFrame:
    """Sorted rows with asked to node, sid, other: each row's node is the shortest prefix that any item looks at. In nodes
    of more than ``crowd`` items other is the node's least item, to which all are linked, in smaller ones it is null."""
    known = asking.sparkSession.sparkContext.broadcast(borders(asking, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := _collected(batches)):
            return
        s, ends = Sorted(held, depth), known.value[TaskContext.get().partitionId()]
        asked = s.table.column("asked").to_numpy()
        column = s.table.column("sizes")
        sizes = column.flatten().to_numpy().reshape(s.n, -1)
        own, centre = np.zeros(s.n, dtype=np.int64), np.zeros(s.n, dtype=np.int64)
        for d in range(shortest, depth + 1):
            starts = np.flatnonzero(s.new[:, d - 1])
            least, sid = np.minimum.reduceat(asked, starts), np.minimum.reduceat(s.sid, starts)
            for i, end in ((0, "first"), (-1, "last")):
                _, least[i], sid[i] = ends[end][d - 1]
            of = np.cumsum(s.new[:, d - 1]) - 1
            here = (own == 0) & (least[of] <= d)
            own[here], centre[here] = d, sid[of[here]]
        other = np.where(sizes[np.arange(s.n), own - shortest] > crowd, centre, -1)
        rows = pa.table({"tree": s.tree.astype(np.int64), "own": own, "path": [s.path[i, :d].tobytes() for i, d in enumerate(own.tolist())], "sid": s.sid, "other": pa.array(other, mask=other < 0)})
        yield from rows.filter(pa.array((other < 0) | (other != s.sid))).to_batches(50_000)

    return asking.mapInArrow(run, "tree long, own long, path binary, sid long, other long")


def alike(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, sid, signature, n: size of its set) to links u, v among the items of each node, which are few: those whose
    signatures agree often enough and whose sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []

        def link(sids: list[int], signatures: list[bytes], sizes: list[int]) -> None:
            if len(sids) < 2:
                return
            order = sorted(range(len(sids)), key=sids.__getitem__)  # links go to the least item, whichever the tree
            sids, sizes = [sids[i] for i in order], [sizes[i] for i in order]
            x = np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(len(sids), -1)[order]
            need = similarity - 5 * math.sqrt(similarity * (1 - similarity) / x.shape[1])
            n = np.array(sizes)
            m = ((x[:, None, :] == x[None, :, :]).mean(axis=2) >= need) & (np.minimum(n[:, None], n[None, :]) >= (similarity - 1e-9) * np.maximum(n[:, None], n[None, :]))
            label = np.arange(len(sids))
            while True:
                low = np.where(m, label[None, :], len(sids)).min(axis=1)
                low = np.minimum(low, label)
                if (low == label).all():
                    break
                label = low
            for i in np.flatnonzero(label != np.arange(len(sids))).tolist():
                u.append(sids[i])
                v.append(sids[label[i]])

        key, held = None, ([], [], [])
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("node", "sid", "signature", "n"))):
                if k != key:
                    link(*held)
                    key, held = k, ([], [], [])
                for c, x in zip(held, row):
                    c.append(x)
            if len(u) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        link(*held)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    placed = nodes.repartition(partitions(nodes.sparkSession), "node").sortWithinPartitions("node")
    return placed.mapInArrow(run, "u long, v long")


def _parts(rows: int, spark: SparkSession, per_task: int = 1_000_000) -> int:
    """A task holds its part of the sorted paths, so parts are of about ``per_task`` rows at most."""
    return max(partitions(spark), -(-rows // per_task))


def candidates(items: DataFrame, similarity: float, recall: float, trees: int, depth: int, shortest: int, crowd: int) -> DataFrame:
    """items (sid, signature: trees x depth values of two bytes, n) to links u, v, whose connected components hold all
    pairs at the threshold with at least the target probability each. The links are checkpointed."""
    spark = items.sparkSession
    shortest = min(depth, shortest_for(similarity, recall, trees, shortest))
    width = WIDTH * depth
    path = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substr("signature", t * width + 1, F.lit(width)))
    forest = in_order(items.select("sid", F.posexplode(path).alias("tree", "path")), _parts(items.count() * trees, spark))
    rows = matched(forest, depth, shortest)
    few = F.col("sizes")[0] <= crowd
    node = lambda tree, d, p: F.xxhash64(tree.cast("long"), d.cast("long"), p).alias("node")
    small = rows.filter(few).select(node(F.col("tree"), F.lit(shortest), F.substr("path", F.lit(1), F.lit(WIDTH * shortest))), "sid")
    edges = spark.createDataFrame([], T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))
    crowded = rows.filter(~few)
    if n := crowded.count():
        asking = in_order(asked_depths(crowded, similarity, recall, trees, depth, shortest, crowd), _parts(n, spark))
        seen = cut(looked_at(asking, depth, shortest, crowd))
        edges = seen.filter("other IS NOT NULL").select(F.col("sid").alias("u"), F.col("other").alias("v"))
        small = small.unionByName(seen.filter("other IS NULL").select(node(F.col("tree"), F.col("own"), F.col("path")), "sid"))
    links = alike(small.join(items.select("sid", "signature", "n"), "sid"), similarity)
    return cut(links.unionByName(edges))
