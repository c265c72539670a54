import random

import corpus_pipeline
import duckdb

from littoral.llm import line_dedup, queries


def check(spark, texts, tmp_path):
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, gone string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op6_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "kept_md5").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(line_dedup.ORACLE_SQL).fetchall())
    assert got == want
    return got


def test_against_sql(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400).select("text").collect()]
    a, b = "\n".join(f"line {i}" for i in range(12)), "\n".join(["x"] * 300)
    texts += [None, "", "\n", "\n\n\n", a, "head\n" + a + "\ntail", a + "\r", b, "p\nq\np\nq\np\nq", "one", "one", "e\n", a.replace("line 6", "other")]
    got = check(spark, texts, tmp_path)
    by_doc = {r[0]: r for r in got}
    n = len(texts)
    assert by_doc[n - 8][2] == 12 and by_doc[n - 6][2] == 299 and by_doc[n - 13][1:3] == (0, 0)
    assert by_doc[n - 1][2] == 11


def test_empty_table(spark, tmp_path):
    assert check(spark, [], tmp_path) == []


def brute(texts, run=2):
    """Every line of every run of ``run`` lines that stands at an earlier place goes."""
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        gone = set()
        for i in range(len(lines) - run + 1):
            window = tuple(lines[i : i + run])
            gone.update(range(i, i + run) if window in seen else ())
            seen.add(window)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def cases():
    """Runs of two lines, a run whose first place is shorter than a later one, and lines that most documents have."""
    texts = ["a\nb", "x\na\nb\nc\nd", "a\nb\nc\nd\ny", "b\nb\nb\nb", "", "e", "e", "c\nb\na"]
    rng = random.Random(3)
    for k in range(300):
        u = f"u{rng.randrange(60)}"
        texts.append("\n".join([f"{k}", u, f"{u}'", f"{k}'", *(rng.choice("pqrst") for _ in range(rng.randint(0, 12)))]))
    return texts


def frame(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_every_repeated_run_goes(spark):
    texts = cases()
    for run in (2, 3):
        got = sorted((r.doc_id, r.kept) for r in line_dedup.drop_repeated_runs(frame(spark, texts), run).collect())
        assert got == list(enumerate(brute(texts, run)))


def test_pipeline_stage_drops_every_repeated_run(spark):
    texts = cases()
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.repeated_lines(spark, frame(spark, texts), "").collect())
    assert got == list(enumerate(brute(texts)))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a\nb", "k"), (1, "a\nb", "k"), (None, "z\na\nb", "k"), (None, None, "k"), (1, "a\nb\nc", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("n_lines", df_col())
    got = {(r.doc_id, r.text, r.kept, r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_runs(df).collect()}
    assert len(line_dedup.drop_repeated_runs(df).collect()) == 5
    # null ids come first, so their run stays; equal rows share one result
    assert (None, "z\na\nb", "z\na\nb", 3, 0) in got and (None, None, None, 0, 0) in got
    assert (1, "a\nb", "", 2, 2) in got and (1, "a\nb\nc", "c", 3, 2) in got


def df_col():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_lines_that_repeat_nowhere_go_no_further(spark):
    from littoral.llm.common import row_key

    texts = ["\n".join(f"line {d} {i}" for i in range(50)) for d in range(200)] + ["line 3 7\nline 3 8\nother", "x", ""]
    docs = frame(spark, texts).select("doc_id", *row_key(), "text")
    chosen = line_dedup.positions(docs, 2)
    assert 0.6 * 10_000 < chosen.count() < 0.72 * 10_000
    assert line_dedup.met(docs, 2).count() == 2


def test_each_window_has_one_position(spark):
    from littoral.llm.common import row_key

    texts = ["a\na\na\na\nb\nb", "p\nq\nr\ns\nt\nu\nv"]
    for run in (2, 3, 4):
        got = line_dedup.positions(frame(spark, texts).select("doc_id", *row_key(), "text"), run).collect()
        starts = {d: sorted(w["i"] for r in got if r["doc_id"] == d for w in r["windows"]) for d in (0, 1)}
        assert starts == {d: list(range(len(texts[d].split("\n")) - run + 1)) for d in (0, 1)}
