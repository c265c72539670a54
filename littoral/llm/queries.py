"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, bpe, decontamination, hilbert_shards, jaccard_join, langid, line_dedup, mtree, oracles, packing, periodic_runs, prefix_trie, quality, substring_dedup
from .common import cut, documents, join_counted


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(documents(spark, sf_dir), path, keep=["doc_id"])
    digests = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "ids",
    )
    decoded = bpe.decode(digests, path, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    predicted = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.grade(docs, model, keep=["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_runs(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    meta = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = hilbert_shards.assign(meta, ["lang", "source", "size"], "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def op3_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(_vectors(spark, sf_dir), "vec_id % 20 = 0")[0]


def op10_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(_vectors(spark, sf_dir), "vec_id % 20 = 0")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = packing.pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    items = cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    packed = packing.pack(items)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        *("n_words", "n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The contract's conversations: c's first h turns are those of conversation c - c % 100, as far as it has them; h = crc32(c) % 6."""
    heads = cut(turns.filter("conv_id % 100 = 0 AND at < 5").withColumnRenamed("conv_id", "root"))
    c = F.col("conv_id")
    own = convs.select("conv_id", "n", (c - c % 100).alias("root"), (F.crc32(c.cast("string")) % 6).alias("h"))
    own = own.join(heads.groupBy("root").agg(F.count("*").alias("there")), "root", "left")
    own = cut(own.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    lent = own.select("conv_id", "root", "h").join(heads, "root").filter("at < h").select("conv_id", "at", "key", "size")
    kept = join_counted(turns, own, ["conv_id"]).filter("at >= h")
    return cut(kept.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "key", "size").unionByName(lent))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.build(_rebuilt(turns, convs), convs)


def _with_periods(docs: DataFrame) -> DataFrame:
    """The contract's texts: where h = crc32(doc_id) is divisible by 10, the words from number a on repeat with period p."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumns({"words": F.when(h % 10 == 0, words), "g": F.floor(h / 10)})
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, int(g % n), 0)"))
    rows = rows.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    tail = F.flatten(F.array_repeat(F.expr("slice(words, a + 1, p)"), F.expr("int(ceil((n - a) / p))")))
    repeated = F.array_join(F.concat(F.expr("slice(words, 1, a)"), F.slice(tail, F.lit(1), F.expr("n - a"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_periods(documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *("best.start", "best.length", "best.period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op3_kmeans_tree_ann": op3_kmeans_tree_ann,
    "op10_mtree_topk": op10_mtree_topk,
    "op11_decontamination": op11_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = oracles.ORACLE_SQL
