import numpy as np

from littoral.llm import ann_tree, mtree, queries


def write(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute(rows, measure, zero_ok):
    good = {i: np.array(v, dtype=np.float64) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    good = {i: np.float32(v).astype(np.float64) for i, v in good.items() if zero_ok or np.any(v)}
    ids = np.array(sorted(good))
    x = np.stack([measure(good[i]) for i in ids])
    out = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:20]
        out += [(int(q), r, int(ids[keep][j]), s[keep][j]) for r, j in enumerate(order, 1)]
    return out


def rows_of(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.4
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    rows[40] = (40, None, 0)
    rows[60] = (60, [0.0] * dim, 0)
    rows[61] = (61, [float("nan")] + [1.0] * (dim - 1), 0)
    rows[62] = (62, [None] + [1.0] * (dim - 1), 0)
    rows[63] = (63, [float("inf")] * dim, 0)
    for i in range(100, n // 3):  # a common vector
        rows[i] = (i, rows[99][1], 0)
    return rows


def test_mtree_is_exact(spark, tmp_path):
    for n in (900, 15):
        rows = rows_of(900, 3)[:n] if n > 64 else [(i, [0.1 * i, 0.3], 0) for i in range(n)]
        got = sorted(map(tuple, queries.op10_mtree_topk(spark, write(spark, rows, tmp_path / str(n))).collect()))
        assert got == [(a, b, c, int(s)) for a, b, c, s in sorted(brute(rows, lambda v: np.floor(64 * v), True))]


def test_mtree_prunes():
    rng = np.random.default_rng(2)
    x = np.floor(64 * (rng.normal(size=(30, 8))[rng.integers(0, 30, 20_000)] * 3 + rng.normal(size=(20_000, 8)) * 0.05))
    q = x[:50]
    root = mtree.bulk_load(x, np.arange(len(x)))
    every, first = np.arange(len(x)), np.arange(50)
    ids, scores, done = mtree.search_pages(root, x, {"rid": every, "id": every}, {"rid": first, "id": first, "v": q}, np.full(50, -np.inf), 20)
    for i in range(50):
        s = x @ q[i]
        s[i] = -np.inf
        order = np.lexsort((np.arange(len(x)), -s))[:20]
        assert ids[i].tolist() == order.tolist() and scores[i].tolist() == s[order].tolist()
    assert done["rows_scored"] < 0.5 * 50 * len(x) and done["pages_pruned_by_parent"] + done["pages_pruned"] > 0


def test_ann_recall_and_form(spark, tmp_path):
    rows = rows_of(3000, 4)
    got = list(map(tuple, queries.op3_kmeans_tree_ann(spark, write(spark, rows, tmp_path)).collect()))
    want = brute(rows, lambda v: v, False)
    assert {(q, r) for q, r, _, _ in got} == {(q, r) for q, r, _, _ in want}
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    # a third of the rows are one vector, so many answers are ties, which go to the smaller id
    assert hits / len(want) > 0.9
    x = {i: np.float32(v).astype(np.float64) for i, v, _ in rows if v and all(a is not None for a in v)}
    for q, _, i, s in got[:500]:
        assert abs(s - float(x[q] @ x[i])) < 1e-9
    by = {}
    for q, r, i, s in sorted(got):
        assert q not in by or (by[q][0], -by[q][1]) > (s, -i)
        by[q] = (s, i)


def test_ann_few_and_empty(spark, tmp_path):
    rows = [(i, [1.0, 0.5 * i], 0) for i in range(5)]
    got = queries.op3_kmeans_tree_ann(spark, write(spark, rows, tmp_path / "a")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    assert queries.op3_kmeans_tree_ann(spark, write(spark, [], tmp_path / "b")).count() == 0
    assert queries.op10_mtree_topk(spark, write(spark, [], tmp_path / "c")).count() == 0


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got, info = ann_tree.search(table, "vec_id % 20 = 0")
    rows = [(r.vec_id, r.embedding, 0) for r in table.collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, lambda v: v, False)}
    assert len({(r.query_id, r.vec_id) for r in got.collect()} & want) / len(want) >= 0.9
    assert info["visits"] <= info["leaves"]


def test_mtree_ties_of_small_integers():
    """Vectors full of ties, with the exact last score as floor: 300 seeds, each against brute force."""
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n, k = 400, int(rng.integers(1, 25))
        x = rng.integers(-2, 3, (n, 3)).astype(float)
        ids = rng.permutation(n)
        root = mtree.bulk_load(x, np.arange(n), capacity=int(rng.integers(2, 64)), fan_out=4)
        at = rng.choice(n, 4, replace=False)
        s = (x[at] @ x.T).astype(np.int64)
        s[np.arange(4), at] = -1000
        want = [np.lexsort((ids, -row))[:k] for row in s]
        floor = np.array([row[w[-1]] for row, w in zip(s, want)])
        got, scores, _ = mtree.search_pages(root, x, {"rid": np.arange(n), "id": ids}, {"rid": at, "id": ids[at], "v": x[at]}, floor, k)
        for i in range(4):
            assert got[i].tolist() == ids[want[i]].tolist() and scores[i].tolist() == s[i][want[i]].tolist(), seed


def several(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(a) for a in rng.normal(size=2 + i % 3)], 1, 2) for i in range(200)]
    rows += [(20, [5.0, 5.0], 1, 2), (20, [5.0, 5.0], 1, 2), (21, [4.0, 4.0, 1.0], 1, 2), (None, [9.0, 9.0], 1, 2), (22, [], 1, 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rid int, asks int").repartition(3), [(i, np.array([*v, *[0.0] * (4 - len(v))])) for i, v, *_ in rows if v and i is not None]


def brute_rows(rows, measure):
    out = []
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-float(measure(v) @ measure(w)), i) for m, (i, w) in enumerate(rows) if m != n)[:20]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_repeated_ids_several_lengths_and_clashing_columns(spark):
    table, rows = several(spark)
    got = sorted((r.query_id, r.rank, r.vec_id, float(r.score)) for r in mtree.search(table, "vec_id % 20 = 0").collect())
    assert got == brute_rows(rows, lambda v: np.floor(64 * v))
    found, _ = ann_tree.search(table, "vec_id % 20 = 0", recall=1.0)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())
    want = brute_rows(rows, lambda v: v)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_large_components(spark):
    """Sums beyond 2**53 stay exact; scores beyond a long are an error."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(a) for a in rng.integers(-(10**6), 10**6, 3) + rng.integers(0, 64, 3) / 64]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, mtree.search(table, "vec_id % 20 = 0").collect()))
    whole = {i: [int(np.floor(64 * a)) for a in v] for i, v in rows}
    want = []
    for q in range(0, 120, 20):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    import pytest

    with pytest.raises(ValueError):
        mtree.search(spark.createDataFrame([(20, [1e300, 1.0])], "vec_id long, embedding array<double>"), "vec_id % 20 = 0")


def test_products_that_cancel(spark):
    """Equal rows and queries nearly orthogonal to them: products far smaller than their terms still find their rows."""
    rng = np.random.default_rng(12)
    tables = {}
    for n, top in enumerate([20, 21, 22, 22, 22, 22]):
        c = rng.integers(-(2**top) * 64, 2**top * 64, 8)
        q = rng.integers(-(2**top) * 64, 2**top * 64, 8)
        others = int(sum(int(a) * int(b) for a, b in zip(c[1:], q[1:])))
        q[0] = -others // int(c[0])  # may be large itself: keep only what fits
        if abs(int(q[0])) < 2 ** (top + 6.5):
            tables[n] = [(i, (c if i else q).tolist()) for i in range(39)]
    assert len(tables) >= 3
    for rows in tables.values():
        df = spark.createDataFrame([(i, [a / 64 for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
        got = sorted(map(tuple, mtree.search(df, "vec_id % 20 = 0").collect()))
        want = []
        for query in (0, 20):
            v = dict(rows)[query]
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != query)[:20]
            want += [(query, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
        assert got == sorted(want)


def test_only_visited_leaves_are_multiplied():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(500, 6)), rng.normal(size=(40, 6))
    leaf = np.sort(rng.integers(0, 20, 500)) * 3
    cells = [rng.choice(np.unique(leaf), rng.integers(0, 5), replace=False).tolist() + [1] for _ in q]
    s, done = ann_tree.visited_products(x, leaf, q, cells)
    open_to = np.array([[f in visits for f in leaf] for visits in cells])
    assert done == open_to.sum() < 0.3 * s.size
    assert np.allclose(s[open_to], (q @ x.T)[open_to]) and np.isneginf(s[~open_to]).all()


def test_neighbouring_leaves_share_buckets():
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 400, 300)
    counts[17] = 30_000
    where = ann_tree.in_runs(counts, 4_096, 16)
    assert sorted(where) == np.flatnonzero(counts).tolist() and len(where[17]) >= 7
    flat = [b for leaf in sorted(where) for b in where[leaf]]
    assert flat == sorted(flat) and max(flat) < len(set(flat)) and max(map(len, where.values())) < 12
    load = {}
    for leaf, buckets in where.items():
        for b in buckets:
            load[b] = load.get(b, 0) + counts[leaf] / len(buckets)
    assert max(load.values()) < 2 * 4_096


def test_repeated_ids_calibrate_by_row(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i % 50), v.tolist()) for i, v in enumerate(rng.normal(size=(1_500, 8)))]
    found, info = ann_tree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", rows_per_leaf=64)
    assert info["leaves"] > 10 and info["visits"] <= info["leaves"] and info["recall"] >= 0.96
    assert found.count() == 20 * sum(i % 50 in (0, 20, 40) for i in range(1_500))
