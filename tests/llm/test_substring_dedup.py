import hashlib
import re
from collections import Counter

from littoral.llm import queries, substring_dedup
from littoral.llm.common import row_key


def brute(texts, width=35):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(d[i : i + width]) for d in docs for i in range(len(d) - width + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - width + 1):
            if seen[tuple(d[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, tmp_path):
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op5_substring_dedup(spark, str(tmp_path)).collect()}
    return [(rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) for i in range(len(texts))]


def cases(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()]
    w = [f"w{i}" for i in range(200)]
    return texts + [None, "", " ", "same " * 80, "odd\x1cspace here " * 40, " ".join(w), " ".join(w[50:100]), " ".join(w[60:94]), " ".join(w[:35]), "\t".join(w[:35])] + [" ".join(w[i : i + 90]) for i in range(100)]


def test_against_brute_force(spark, tmp_path):
    texts = cases(spark)
    assert run(spark, texts, tmp_path) == brute(texts)


def test_hot_buckets_take_the_other_way(spark, tmp_path):
    """With a share of nothing, every bucket of 33 places or more is hot."""
    texts = cases(spark) + [" ".join(f"w{i}" for i in range(40, 160))] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.row: r.ranges for r in substring_dedup.repeated_ranges(df, share=0.0).collect()}
    keyed = df.select("doc_id", "text", *row_key()).collect()
    want = brute(texts)
    for r in keyed:
        gone = {i for x in rows.get(r.row, ()) for i in range(x.start, x.stop)}
        assert len(gone) == want[r.doc_id][1], r.doc_id


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 1), (1, long, 1), (None, "x " + long, 1), (None, None, 1), (2, "short one", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").selectExpr("*", "'mine' AS doc", "1 AS bucket", "'w' AS words")
    got = sorted(((r.doc_id, r.kept, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, "", 40, 40), (1, "", 40, 40), (None, "x", 41, 40), (None, "", 0, 0), (2, "short one", 2, 0)], key=str)
