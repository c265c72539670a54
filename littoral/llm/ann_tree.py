"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best-bin-first, calibrated leaf visits."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, bucketwise, clean, dealt, matrix, merge, partial, partial_type, sampled, spread


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of at most k clusters of distinct rows."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        used = np.unique(near)
        centres = np.stack([x[near == c].mean(axis=0) for c in used])
    return np.unique(centres, axis=0)


@dataclass
class Tree:
    """Node i has centres[i] and children[i] (empty: a leaf, numbered leaf[i]). Node 0 is the root."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child's at every level."""
        at, out = {0: np.arange(len(x))}, np.zeros(len(x), dtype=np.int64)
        while at:
            node, rows = at.popitem()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = (x[rows] @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
            for j in np.unique(near).tolist():
                at[kids[j]] = rows[near == j]
        return out

    def best_bins(self, q: np.ndarray, visits: int, counts: np.ndarray, enough: int) -> list[int]:
        """Leaves in order of visit: a priority queue gives the node whose centre has the largest inner product with q;
        ends after ``visits`` leaves that hold at least ``enough`` rows, or with all leaves."""
        products = self.centres @ q
        queue, out, held = [(-float(products[0]), 0)], [], 0
        while queue and (len(out) < visits or held < enough):
            node = heapq.heappop(queue)[1]
            if not self.children[node]:
                out.append(int(self.leaf[node]))
                held += int(counts[self.leaf[node]])
            for child in self.children[node]:
                heapq.heappush(queue, (-float(products[child]), child))
        return out


def grow(sample: np.ndarray, leaves: int, branching: int = 8, seed: int = 11) -> Tree:
    """Splits clusters, the largest first, until there are about ``leaves``."""
    rng = np.random.default_rng(seed)
    centres, children = [sample.mean(axis=0)], [[]]
    queue = [(-len(sample), 0, sample)]
    n_leaves = 1
    while queue and n_leaves < leaves:
        _, node, x = heapq.heappop(queue)
        if len(x) < 2 or len(c := kmeans(x, branching, rng)) < 2:
            continue
        near = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
        for j in range(len(c)):
            children[node].append(len(centres))
            children.append([])
            heapq.heappush(queue, (-int((near == j).sum()), len(centres), x[near == j]))
            centres.append(c[j])
        n_leaves += len(c) - 1
    ends, stack = [], [0]
    while stack:  # leaves are numbered along the tree, so neighbours have neighbouring numbers
        node = stack.pop()
        stack += reversed(children[node])
        ends += [] if children[node] else [node]
    leaf = np.full(len(centres), -1)
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centres), children, leaf, len(ends))


def in_runs(counts: np.ndarray, per_bucket: int, least: int) -> dict[int, list[int]]:
    """Leaves to buckets, runs of neighbouring leaves to the same one, and at least ``least`` buckets in all. A leaf that
    lies over the end of a bucket goes to both, a crowded one to several."""
    total = int(counts.sum())
    share = max(1, min(per_bucket, -(-total // least)))
    ends = np.cumsum(counts)
    return {int(i): list(range(int(ends[i] - counts[i]) // share, int(ends[i] - 1) // share + 1)) for i in np.flatnonzero(counts)}


def visited_products(x: np.ndarray, leaf: np.ndarray, q: np.ndarray, cells: list[list[int]]) -> tuple[np.ndarray, int]:
    """Products of queries with the rows, sorted by leaf, of the leaves that each visits, -inf elsewhere; and how many
    products that took."""
    out = np.full((len(q), len(x)), -np.inf)
    names, first = np.unique(leaf, return_index=True)
    bounds = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(leaf)])))
    asking: dict[int, list[int]] = {}
    for i, visits in enumerate(cells):
        for f in visits:
            if f in bounds:
                asking.setdefault(f, []).append(i)
    done = 0
    for f, queries in asking.items():
        lo, hi = bounds[f]
        out[queries, lo:hi] = q[queries] @ x[lo:hi].T
        done += len(queries) * (hi - lo)
    return out, done


def exact(rows: DataFrame, rids: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Brute force for a few queries held by every task: query_id, rank, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(ids)
        for b in batches:
            own, number, x = b.column("vec_id").to_numpy(), b.column("rid").to_numpy(), matrix(b.column("v"))
            s = queries @ x.T
            for i in range(len(ids)):
                there = number != rids[i]
                a, c = np.concatenate((held[i][0], own[there])), np.concatenate((held[i][1], s[i][there]))
                j = best(a, c, k)
                held[i] = a[j], c[j]
        yield partial(rids.tolist(), ids.tolist(), [h[0] for h in held], [h[1] for h in held])

    return merge(rows.mapInArrow(run, partial_type("double")).filter(F.size("ids") > 0), k, "double")


def search(table: DataFrame, asking: str, k: int = 20, recall: float = 0.96, rows_per_leaf: int = 256, fit_rows: int = 20_000, calibration: int = 200, per_bucket: int = 16_384) -> tuple[DataFrame, dict]:
    """The k other rows of ``table`` (vec_id, embedding) with the largest inner product, for each row that meets the
    condition ``asking``: query_id, rank, vec_id, score; and what was calibrated.

    The tree is grown on about ``fit_rows`` rows, four or more to a leaf, so beyond ``rows_per_leaf`` * ``fit_rows`` / 4
    rows its leaves grow with the table; every row is indexed. Leaf visits are calibrated on about
    ``calibration`` queries whose true neighbours are found by brute force: they are widened until these queries' mean
    recall reaches ``recall``. A query visits more leaves while those seen hold too few rows for k answers. Neighbouring
    leaves go to buckets of about ``per_bucket`` rows, a crowded leaf to several, and a query goes once to each bucket
    that it visits, where it is multiplied by the rows of its leaves alone.
    Scores are double-precision products of the original vectors; ties go to the smaller vec_id. See clean() for what
    takes no part, for vectors of several lengths and for repeated ids. Empty tables give no rows.
    """
    spark = table.sparkSession
    rows = clean(table, asking, drop_zero=True)
    asked = rows.filter("asks")
    total, n_asked = rows.count(), asked.count()
    if not total or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), {"recall": 1.0, "visits": 0, "leaves": 0}
    tree = grow(sampled(rows, "tree", fit_rows, total)[2], min(fit_rows // 4, max(1, total // rows_per_leaf)))
    held = spark.sparkContext.broadcast(tree)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = held.value.leaf_of(matrix(b.column("v"))) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), b.column("v"), pa.array(got)], ["rid", "vec_id", "v", "leaf"])

    indexed = cut(rows.mapInArrow(leaves, "rid long, vec_id long, v array<double>, leaf long"))
    counted = {r.leaf: r.n for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row for each leaf
    counts = np.array([counted.get(i, 0) for i in range(tree.leaves)])

    rids, ids, vectors = sampled(asked, "calibration", calibration, n_asked)
    by_row = rows.withColumn("vec_id", F.col("rid"))  # ids may repeat
    truth = exact(by_row, rids, rids, vectors, k).select("query_id", "vec_id").join(indexed.select(F.col("rid").alias("vec_id"), "leaf"), "vec_id")
    where: dict[int, list[int]] = {}
    for r in truth.select("query_id", "leaf").collect():  # at most calibration * k
        where.setdefault(r.query_id, []).append(r.leaf)
    found = np.zeros(tree.leaves)
    for q, v in zip(rids.tolist(), vectors):
        order = {leaf: i for i, leaf in enumerate(tree.best_bins(v, tree.leaves, counts, 0))}
        for leaf in where.get(q, ()):
            found[order[leaf]] += 1
    shares = np.cumsum(found) / max(1, found.sum())
    visits = int(np.searchsorted(shares, recall)) + 1 if found.sum() else tree.leaves

    where_to = in_runs(counts, per_bucket, 16)

    def place_point(own: np.ndarray, x: np.ndarray) -> list[dict[int, list[int]]]:
        leaf = held.value.leaf_of(x)
        return [{where_to[f][int(spread(own[i : i + 1], len(where_to[f]))[0])]: [f]} for i, f in enumerate(leaf.tolist())]

    def place_query(own: np.ndarray, x: np.ndarray) -> list[dict[int, list[int]]]:
        out = []
        for v in x:
            buckets: dict[int, list[int]] = {}
            for f in held.value.best_bins(v, visits, counts, k + 1):
                for b in where_to.get(f, ()):
                    buckets.setdefault(b, []).append(f)
            out.append(buckets)
        return out

    def work(points: dict, asking: dict) -> Iterator[pa.RecordBatch]:
        if "leaf" not in points:
            leaf = np.array([c[0] for c in points["cells"]])
            order = np.argsort(leaf, kind="stable")
            points |= {"leaf": leaf[order], "v": points["v"][order], "id": points["id"][order], "rid": points["rid"][order]}
            points["longest"] = float(np.sqrt((points["v"] ** 2).sum(axis=1)).max())
        x, own, number = points["v"], points["id"], points["rid"]
        q, q_ids = asking["v"], asking["id"]
        s, _ = visited_products(x, points["leaf"], q, asking["cells"])
        s[asking["rid"][:, None] == number[None, :]] = -np.inf
        slack = 1e-9 * np.sqrt((q**2).sum(axis=1)) * points["longest"]
        got_ids, got_scores = [], []
        for i in range(len(q)):
            row = s[i]
            if len(row) > k:
                edge = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero((row >= edge - slack[i]) & (row > -np.inf))
            else:
                at = np.flatnonzero(row > -np.inf)
            exactly = (x[at] * q[i]).sum(axis=1)
            j = best(own[at], exactly, k)
            got_ids.append(own[at][j])
            got_scores.append(exactly[j])
        yield partial(asking["rid"].tolist(), q_ids.tolist(), got_ids, got_scores)

    both = dealt(rows, 0, place_point).unionByName(dealt(asked, 1, place_query))
    return merge(bucketwise(both, work, "double"), k, "double"), {"recall": float(shares[visits - 1]), "visits": visits, "leaves": tree.leaves}
