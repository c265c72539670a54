import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_line_dedup import brute as line_brute
from tokenizers import Tokenizer

FIXTURE = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    before = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, FIXTURE).write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before.collect()
        if name != "best_fit_packing":
            assert before.columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in seen[name])
    kept = {r.doc_id for r in seen["quality_classifier"]}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FIXTURE}/labels.parquet").collect()}
    wrong = sum((r.quality == 1 and r.toxic == 0) != (d in kept) for d, r in labels.items())
    assert wrong <= len(labels) * 0.1
    assert {r.doc_id for r in seen["line_dedup"]} == kept
    lined = sorted(seen["line_dedup"], key=lambda r: r.doc_id)
    stay = {lined[i].doc_id for i, root, _ in near_brute([r.text for r in lined]) if i == root}
    assert {r.doc_id for r in seen["ngram_jaccard_join"]} == stay
    assert {r.doc_id for r in seen["substring_dedup"]} == stay
    fill = defaultdict(int)
    for r in seen["best_fit_packing"]:
        fill[r.sequence_id] += r.length
    assert {r.doc_id for r in seen["best_fit_packing"]} == stay and max(fill.values()) <= 1024


def without_repeated_passages(texts, width=35):
    """Words under windows that start more than once go; a text without any stays as it is."""
    docs = [text.encode().split() for text in texts]
    seen = Counter(tuple(d[i : i + width]) for d in docs for i in range(len(d) - width + 1))
    out = []
    for text, d in zip(texts, docs):
        gone = {j for i in range(len(d) - width + 1) if seen[tuple(d[i : i + width])] > 1 for j in range(i, i + width)}
        out.append(b" ".join(w for i, w in enumerate(d) if i not in gone).decode() if gone else text)
    return out


def test_run_equals_brute_force(spark):
    """All but the learnt stage by plain Python, on whole documents; packing by the library's ids, held to its laws."""
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    kept = sorted(corpus_pipeline.quality_classifier(spark, docs, FIXTURE).select("doc_id", "text").collect())
    ids, texts = [r.doc_id for r in kept], line_brute([r.text for r in kept])
    stay = [i for i, root, _ in near_brute(texts) if i == root]
    ids, texts = [ids[i] for i in stay], without_repeated_passages([texts[i] for i in stay])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, FIXTURE).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert sorted(pieces) == ids
    total = 0
    for doc, text in zip(ids, texts):
        tokens = library.encode(text, add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *tokens[at : at + r.length]))
            at += r.length
        assert at == len(tokens)
        total += at
    for content in bins.values():
        content.sort(key=lambda r: r.offset)
        assert [r.offset for r in content] == [sum(x.length for x in content[:k]) for k in range(len(content))]
        assert sum(r.length for r in content) <= 1024
    assert len(bins) <= -(-total // 1024) * 1.02 + 1


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows, extra columns that clash with the operators' own, no rows."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " more", None, None, None), (None, text, "en", "s", 1), (3, None, "en", "s", None), (4, "", "en", "s", 0), (5, "a\nb\na\nb", "en", "s", 7), (6, "z " * 20_000, "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS row", "'x' AS kept", "1 AS n_removed", "'k' AS key", "1 AS sequence_id", "1 AS keep")
    want = {
        "quality_classifier": None,  # learnt: asked for below
        "line_dedup": 8,
        "ngram_jaccard_join": 6,  # the row without an id is a copy of doc_id 1, as 2 is a near one; both rows of 1 stay
        "substring_dedup": 8,
        "best_fit_packing": None,  # a piece for each row, and more for the long one
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FIXTURE)
        assert name == "best_fit_packing" or got.columns == corpus_pipeline.COLUMNS
        n = got.count()
        assert want[name] in (None, n), (name, n)
        if name == "quality_classifier":
            assert n <= 8 and {(r.doc_id, r.text) for r in got.collect()} <= {r[:2] for r in rows}
        if name == "best_fit_packing":
            assert n >= 8 and {r.doc_id for r in got.collect()} == {r[0] for r in rows} and sum(r.piece == 0 for r in got.collect()) == 8
        assert stage(spark, docs.limit(0), FIXTURE).count() == 0
