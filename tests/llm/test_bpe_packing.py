import base64
import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from littoral.llm import bpe, packing, queries

TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline \n end ", "don't we'll 'tis", "x" * 5000, "日本語 テキスト ñandú ½² _under_", "<|endoftext|> is text", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "9<|endoftext|>'s  x", " nbsp \x1c odd\x85", "The and attion " * 900, "ab" * 300 + " " + "é" * 700, "a  b", "end "]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)


def write(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_encode_matches_library(spark, tmp_path):
    texts = TEXTS + corpus(spark)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in queries.op1_byte_bpe(spark, write(frame(spark, texts), tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = own.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids), (i, text)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_replay_is_exact_on_odd_words(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    replay = bpe.MergeReplay(path)
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("aabcdeinorst éß") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["a" * k for k in range(1, 40)]
    got = replay.encode_words(words)
    for word, ids in zip(words, got):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == own.encode_ordinary(word), word


def test_plain_texts_split_alike():
    """Each character by itself and between others, and random texts, against the tokenizers' own pattern."""
    import random

    import regex

    from littoral.llm import pretoken

    full = regex.compile(P.PATTERN).findall
    fast = pretoken.CachedEncoder(P.PATTERN, lambda words: words).findall
    chars = [chr(i) for i in range(0x300)]
    rng = random.Random(1)
    texts = [f"{a}{c}{b}" for c in chars for a, b in (("", ""), ("a", "b"), (" ", "1"), ("_", " ")) for _ in range(1)]
    texts += ["".join(rng.choice(chars[:600] + [" ", " ", "'", "s", "\n"] * 30) for _ in range(40)) for _ in range(5000)]
    texts += ["".join(rng.choice("abé Z_9'st\n\t.,;~ ") for _ in range(60)) for _ in range(5000)]
    for t in texts:
        assert fast(t) == full(t), t


def test_packing_round_trip(spark, tmp_path):
    texts = TEXTS + corpus(spark)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = queries.op9_best_fit_packing(spark, write(frame(spark, texts), tmp_path)).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    total = 0
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids) and len(by_doc[i]) == -(-len(ids) // 1024)
    for content in by_bin.values():
        at = 0
        for r in sorted(content, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_bin) <= -(-total // 1024) * 1.02 + 1


def test_bins_that_fit_are_joined(spark):
    """Many small partitions: in the end no two bins could be one. Equal rows are items of their own."""
    items = spark.range(0, 4000).selectExpr("id % 1000 AS doc_id", "cast(id * 7919 % 700 + 1 AS int) AS length", "'x' AS offset", "1 AS fill").repartition(50)
    rows = packing.pack(items, per_task=500).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted((i % 1000, i * 7919 % 700 + 1) for i in range(4000))
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    low = sorted(fill.values())
    assert low[-1] <= 1024 and low[0] + low[1] > 1024
    assert len(fill) <= sum(low) / 1024 * 1.03 + 1


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    """Equal rows are cut and packed each by itself; columns of the documents don't get in the way."""
    rows = [(1, "one two three " * 900, "x")] * 2 + [(None, "four", "x"), (2, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "'x' AS piece", "'x' AS length", "'x' AS start").repartition(2)
    cut = packing.pieces(df, P.path("byte_bpe_50k.json"))
    got = packing.pack(cut.selectExpr("*", "'mine' AS sequence_id", "1 AS contents", "2 AS fill")).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    n = len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(rows[0][1]).ids) + 1
    assert sum(x[2] for x in by_doc[1]) == 2 * n and len(set(by_doc[1])) * 2 == len(by_doc[1])
    assert by_doc[2] == [(0, 0, 1)] and by_doc[None] == [(0, 0, 2)]
    assert {(r.contents, r.fill) for r in got} == {(1, 2)}


def test_packing_empty(spark):
    items = spark.createDataFrame([], "doc_id long, length int, offset int")
    assert packing.pack(items).count() == 0
