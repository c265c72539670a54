import numpy as np
import public_tokenizers

from littoral.llm import langid, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_held_out_accuracy(spark):
    """Documents that nothing was learnt from, by language."""
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").filter("held_out")
    langs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").dropna()
    rows = got.join(langs, "doc_id").collect()
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) >= 0.95 * len(own), lang


def test_edges(spark):
    rows = [(i, w * 9, lang) for i, (w, lang) in enumerate([("the cat and the hat ", "en"), ("le chat et la souris ", "fr")] * 20)]
    odd = [(100, None, "en"), (101, "12 !", "en"), (102, "", None), (103, "la souris", None), (104, "le chat et la souris " * 50_000, None), (105, "lachatsouris" * 2_000, None), (106, "la souris", None), (106, "la souris", None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string").selectExpr("*", "'mine' AS score", "'mine' AS i")
    out = langid.predict(docs, langid.fit(docs, PATH)).collect()
    assert len(out) == len(rows) + len(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(got[i][0] == lang for i, _, lang in rows)
    assert got[100] == got[101] == got[102] == ("und", 0.0) and {got[i][0] for i in (103, 104, 105, 106)} == {"fr"}
    empty = langid.fit(docs.filter("false"), PATH)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def explicit(word, number, table):
    """Summed over all ways to cut the word, piece by piece."""
    sums = [np.ones(table.shape[1])]
    for end in range(1, len(word) + 1):
        total = np.zeros(table.shape[1])
        for begin in range(end):
            piece = word[begin:end]
            p = table[number[piece]] if piece in number else langid.UNKNOWN if len(piece) == 1 else 0
            total = total + p * sums[begin]
        sums.append(total)
    return sums[-1]


def test_segmentations_are_summed():
    """The forward pass against an explicit sum over the whole vocabulary, for short and for long words."""
    pieces = langid.Pieces(PATH)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    assert pieces.n > 31_000 and pieces.longest == 16
    table = np.random.default_rng(0).random((pieces.n, 2)) / 100
    words = ["the", "Chatte", "größe", "x", "internationalization", "Responsibilities", "understanding" * 3, "der" * 20]
    got = langid.log_likelihoods(words, pieces, table)
    for w, g in zip(words, got):
        assert np.allclose(g, np.log(explicit(langid.WORD_START + w, number, table))), w


def test_expected_counts_add_up():
    """Each piece's expected uses, weighted by its letters, make up the word: characters that are no piece aside."""
    pieces = langid.Pieces(PATH)
    table = np.random.default_rng(1).random((pieces.n, 2)) / 100
    sizes = np.array([len(p) for p in pieces.pieces])
    for word in ("understanding", "understanding" * 4):
        counts = langid.expected_counts([word, word], np.array([0, 1]), np.array([1.0, 2.0]), pieces, table)
        assert np.allclose(sizes @ counts, [len(word) + 1, 2 * (len(word) + 1)])
