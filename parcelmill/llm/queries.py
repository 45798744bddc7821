"""One query for each operator over its whole table, with the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm import (
    chat,
    decontamination,
    divergence,
    embeddings,
    language,
    licenses,
    ngram_join,
    oracles,
    packing,
    quality,
    sharding,
    spelling,
    token_counts,
    top_k,
)
from parcelmill.llm.common import crc_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_chat_snapshots": oracles.CHAT_SNAPSHOTS,
    "op3_decontamination": oracles.DECONTAMINATION,
    "op9_ngram_jaccard_join": oracles.NGRAM_JACCARD_JOIN,
    "op10_embedding_near_dedup": oracles.EMBEDDING_NEAR_DEDUP,
    "op1_interleaved_shards": oracles.INTERLEAVED_SHARDS,
    "op11_exact_top_k": oracles.EXACT_TOP_K,
    "op12_spelling_variants": oracles.SPELLING_VARIANTS,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.interleave_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations")).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered"
    )


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontamination.digest(F.col("items")).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_count(F.col("text")))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        F.size("lang_spans").cast("long").alias("n_spans"),
    )


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumns(
        {"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")}
    ).withColumn("n_near", F.size("spans").cast("long")).drop("spans")


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, weights = top_k.scaled(F.col("embedding"), 256)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", terms.alias("terms"), weights.alias("weights"))
    found = top_k.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5, key="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents"), "A-Za-z\u00C0-\u00FF", 7)
    words = runs.select(spelling.misspelt(F.col("key"), F.col("run"), 31).alias("word")).where(F.length("word") >= 7)
    return spelling.spelling_variants(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
