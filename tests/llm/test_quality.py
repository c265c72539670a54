import numpy as np

from littoral.llm import quality

FIXTURE = "/root/testdata/sf0.01"


def loss(w, t, x, grades, l2):
    """Penalised negative log likelihood of the cumulative-link model, written out."""
    above = np.concatenate((np.ones((len(x), 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - t[None, :]))), np.zeros((len(x), 1))), axis=1)
    p = above[np.arange(len(x)), grades] - above[np.arange(len(x)), grades + 1]
    return -np.log(np.maximum(p, 1e-12)).mean() + l2 / 2 * (w**2).sum()


def test_fit_is_the_likelihood_s_maximum():
    rng = np.random.default_rng(1)
    for n_grades in (2, 3, 5):
        x = rng.normal(size=(400, 3))
        z = x @ np.array([1.0, -2.0, 0.5]) + rng.logistic(size=400)
        grades = np.searchsorted(np.linspace(-1.5, 1.5, n_grades - 1) if n_grades > 2 else [0.3], z)
        rows, cols = np.repeat(np.arange(400), 3), np.tile(np.arange(3), 400)
        w, t = quality.fit_ordinal(rows, cols, x.ravel(), grades, 3, n_grades, 2e-3, 1500, 0.02)
        assert (np.diff(t) > 0).all() and np.sign(w).tolist() == [1, -1, 1]
        best = loss(w, t, x, grades, 2e-3)
        for _ in range(300):
            scale = 10 ** rng.uniform(-3, 0)
            other = loss(w + rng.normal(size=3) * scale, np.sort(t + rng.normal(size=len(t)) * scale), x, grades, 2e-3)
            assert other > best - 1e-4


def test_held_out_grades(spark):
    """Fitted on three quarters of the labels, the classifier keeps the good documents of the others and no bad ones."""
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    rated = quality.ratings(spark.read.parquet(f"{FIXTURE}/labels.parquet"))
    model = quality.fit(docs, rated.filter("doc_id % 4 <> 2"))
    got = quality.grade(docs, model, keep=["doc_id"]).join(rated.filter("doc_id % 4 = 2"), "doc_id").collect()
    right = sum(r.keep == (r.grade == 2) for r in got)
    assert len(got) > 50 and right >= 0.9 * len(got)
    assert quality.fit(docs, rated.filter("doc_id % 4 <> 2")) == model


def test_edges(spark):
    docs = spark.createDataFrame([(1, "fine words", 0.5), (2, None, 0.5), (3, " ", 0.5)], "doc_id long, text string, p_tail double")
    labels = spark.createDataFrame([], "doc_id long, grade int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: (r.keep, r.p_tail) for r in quality.grade(docs, model).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0), 3: (False, 0.0)}
    assert quality.grade(docs.limit(0), model).count() == 0


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    rows = [(i % 40, ("good clean words here " if i % 2 else "JUNK $$$ 1234 ") * 20, i % 2 * 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "mine") for i, t, _ in rows] + [(500, "A" * 300_000, "mine"), (501, "good clean words " * 100_000, "mine")], "doc_id long, text string, grade string")
    docs = docs.selectExpr("*", "'mine' AS keep", "'mine' AS expected_grade")
    model = quality.fit(docs, spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 2), (3, None)], "doc_id long, grade int"))
    got = quality.grade(docs, model).collect()
    assert len(got) == len(rows) + 2
    assert all(r.keep == (r.doc_id % 2 == 1) for r in got if r.doc_id < 500) and {r.doc_id: r.keep for r in got}[501]
