"""Exact top-k by integer inner product: M-tree pages, best-first, with stored triangle-inequality bounds.

A page has a routing object c, a covering radius r and its distance to the parent's routing object. For a query q and
any x within r of c, q.x <= q.c + |q| r; and q.c <= q.p + |q| d(p, c), so a page can be ruled out by the stored distance
to its parent p before q.c is computed, and an entry of a leaf page by its stored distance to c before q.x is.

Scores are exact integers. Bounds are floating numbers; each is widened by more than its rounding error before it rules
anything out, so a row that ties at the last rank is never lost. A product q.c may cancel, so its error is a share of
|q| |c| and not of the product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import best, bucketwise, clean, deal, dealt, matrix, merge, partial, sampled, spread


#: A bound's share of its parts' size by which it is widened: far above the rounding of norms, distances and products.
SLACK = 1e-9
#: Stands for no score.
NONE = -(1 << 63)


def products(q: np.ndarray, x: np.ndarray, whole: bool) -> np.ndarray:
    """All inner products of integer vectors held as doubles, exactly: as doubles while sums stay below 2**53, else
    (``whole``) as 64-bit integers."""
    return q.astype(np.int64) @ x.astype(np.int64).T if whole else (q @ x.T).astype(np.int64)


@dataclass
class Page:
    centre: np.ndarray
    radius: float
    to_parent: float
    pages: list[Page] = field(default_factory=list)
    rows: np.ndarray | None = None  # of a leaf page, the farthest from the centre first
    distances: np.ndarray | None = None


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=-1))


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those taken."""
    taken = [0]
    far = distance(x, x[0])
    while len(taken) < k and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, distance(x, x[taken[-1]]))
    return x[taken]


def bulk_load(x: np.ndarray, rows: np.ndarray, capacity: int = 256, fan_out: int = 16, parent: np.ndarray | None = None) -> Page:
    """Pages of at most ``capacity`` rows; more only if they are equal."""
    own = x[rows]
    mean = own.mean(axis=0)
    centre = own[distance(own, mean).argmin()]
    d = distance(own, centre)
    page = Page(centre, float(d.max()), 0.0 if parent is None else float(distance(centre, parent)))
    if len(rows) > capacity and page.radius > 0:
        routes = spread_out(own, fan_out)
        near = np.stack([distance(own, c) for c in routes]).argmin(axis=0)
        page.pages = [bulk_load(x, rows[near == j], capacity, fan_out, centre) for j in np.unique(near)]
    else:
        order = np.argsort(-d, kind="stable")
        page.rows, page.distances = rows[order], d[order]
    return page


def search_pages(root: Page, x: np.ndarray, points: dict, asking: dict, floor: np.ndarray, k: int, whole: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], dict[str, int]]:
    """Best-first for a block of queries at once: the page with the largest upper bound of any query comes next, and at
    each page only the queries whose bound exceeds what they have stay in. ``points`` and ``asking`` hold rid and id of
    the rows of x and of the queries, and ``asking`` their vectors v. ``floor``: for each query a score that k other
    rows reach, so lower ones aren't needed. Returns ids and scores for each query, and counts of what was spared."""
    queries = asking["v"]
    norm = np.sqrt((queries**2).sum(axis=1))
    have_ids = [np.zeros(0, dtype=np.int64)] * len(queries)
    have = [np.zeros(0, dtype=np.int64)] * len(queries)
    exact = floor.astype(np.int64)  # a score below it is not needed; one equal to it may win its tie
    least = exact.astype(float)
    done = {"pages_pruned_by_parent": 0, "pages_pruned": 0, "rows_pruned": 0, "rows_scored": 0}
    size = lambda page: norm * np.sqrt((page.centre**2).sum())  # noqa: E731  what the terms of a product may add up to
    widened = lambda product, reach, terms: product + reach + SLACK * (terms + reach + 1)
    at_root = queries @ root.centre
    queue = [(-float(widened(at_root, norm * root.radius, size(root)).max(initial=-np.inf)), 0, root, at_root)]
    number = 0
    while queue:
        _, _, page, product = heapq.heappop(queue)
        terms = size(page)
        live = np.flatnonzero(widened(product, norm * page.radius, terms) >= least)
        if not len(live):
            done["pages_pruned"] += 1
            continue
        for child in page.pages:
            if not (widened(product, norm * (child.to_parent + child.radius), terms)[live] >= least[live]).any():
                done["pages_pruned_by_parent"] += 1
                continue
            p = queries @ child.centre
            number += 1
            heapq.heappush(queue, (-float(widened(p, norm * child.radius, size(child)).max()), number, child, p))
        if page.rows is not None and len(page.rows):
            short = least - product - SLACK * (terms + np.maximum(least, 0) + norm * page.radius + 1)
            need = (short / np.maximum(norm, 1e-12))[live].min()  # entries nearer to the centre can't reach
            upto = int(np.searchsorted(-page.distances, -need, side="right")) if need > 0 else len(page.rows)
            done["rows_pruned"] += (len(page.rows) - upto) * len(live)
            done["rows_scored"] += upto * len(live)
            rows = page.rows[:upto]
            s = products(queries[live], x[rows], whole)
            hit = s >= exact[live][:, None]
            hit &= asking["rid"][live][:, None] != points["rid"][rows][None, :]
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                q, on = live[i], hit[i]
                a, b = np.concatenate((have_ids[q], points["id"][rows[on]])), np.concatenate((have[q], s[i][on]))
                j = best(a, b, k)
                have_ids[q], have[q] = a[j], b[j]
                if len(j) == k:
                    exact[q] = max(exact[q], b[j[-1]])
                    least[q] = float(exact[q])
    return have_ids, have, done


def quantised(table: DataFrame, scale: int = 64) -> DataFrame:
    return table.select("rid", "vec_id", "asks", F.transform(F.col("v"), lambda x: F.floor(x * scale).cast("double")).alias("v"))


def search(table: DataFrame, asking: str, k: int = 20, scale: int = 64, routes: int = 128, fit_rows: int = 4_000, per_bucket: int = 16_384) -> DataFrame:
    """The k other rows of ``table`` with the highest integer inner product of floor(scale * x), for each row that meets
    the condition ``asking``: query_id, rank, vec_id, score long. Exact; ties go to the smaller vec_id.

    Routing objects come from about ``fit_rows`` rows. Each row belongs to the nearest one's cell; cells are dealt to
    buckets of about ``per_bucket`` rows, large cells to several, and each bucket's pages are loaded by the task that
    searches them. The same sample's scores give every query a floor, and a query skips the buckets whose covering radii
    rule them out. Components so large that sums may reach 2**53 are multiplied as 64-bit integers; a table whose scores
    may not fit a long at all is an error. See clean() for what takes no part, for vectors of several lengths and for
    repeated ids; zero vectors take part here. Empty tables give no rows.
    """
    spark = table.sparkSession
    rows = cut(quantised(clean(table, asking, drop_zero=False), scale))
    asked = rows.filter("asks")
    size = F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")
    known = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"), size, F.max(F.size("v")).alias("width")).first()
    total = known.n
    most = (known.width or 0) * int(known.top or 0) ** 2  # no score is larger
    if most >= 1 << 63:
        raise ValueError(f"scores of vectors with components up to {known.top / scale} don't fit a long")
    whole = most >= 1 << 53
    if not total or not known.asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    known_rids, _, known = sampled(rows, "routes", fit_rows, total)
    held = spark.sparkContext.broadcast((spread_out(known, routes), known_rids, known))

    def cell_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = held.value[0]
        near = ((c**2).sum(axis=1) / 2 - x @ c.T).argmin(axis=1)
        return near, distance(x, c[near])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, d = cell_of(matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(d)], ["cell", "d"])

    stats = rows.mapInArrow(cells, "cell long, d double").groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()
    where_to = deal({r.cell: r.n for r in stats}, per_bucket, 16)
    radius = np.full(len(held.value[0]), -1.0)
    for r in stats:
        radius[r.cell] = r.radius

    def place_point(own: np.ndarray, x: np.ndarray) -> list[dict[int, list[int]]]:
        return [{where_to[c][int(spread(own[i : i + 1], len(where_to[c]))[0])]: []} for i, c in enumerate(cell_of(x)[0].tolist())]

    def place_query(own: np.ndarray, x: np.ndarray) -> list[dict[int, list[int]]]:
        centres, rids, sample = held.value
        s = products(x, sample, whole)
        s[own[:, None] == rids[None, :]] = NONE
        floor = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(x), NONE)
        norm = np.sqrt((x**2).sum(axis=1))[:, None]
        product, far = x @ centres.T, norm * np.maximum(radius, 0)[None, :]
        reach = product + far + SLACK * (norm * np.sqrt((centres**2).sum(axis=1)) + far + 1)
        out = []
        for i in range(len(x)):
            open_cells = np.flatnonzero((reach[i] >= floor[i]) & (radius >= 0))
            out.append({b: [int(floor[i])] for c in open_cells.tolist() for b in where_to[c]})
        return out

    def work(points: dict, asking: dict) -> Iterator[pa.RecordBatch]:
        if "root" not in points:
            points["root"] = bulk_load(points["v"], np.arange(len(points["id"])))
        floor = np.array([c[0] for c in asking["cells"]])
        ids, scores, _ = search_pages(points["root"], points["v"], points, asking, floor, k, whole)
        yield partial(asking["rid"].tolist(), asking["id"].tolist(), ids, scores)

    both = dealt(rows, 0, place_point).unionByName(dealt(asked, 1, place_query))
    return merge(bucketwise(both, work, "long").filter(F.size("ids") > 0), k, "long")
