"""One query for each operator, over whole tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm import (
    bpe,
    chat_format,
    exact_dedup,
    filter_audit,
    language,
    lexical_search,
    near_dedup,
    packing,
    quality,
    secret_scan,
    sharding,
    suffix_tree,
    webp,
)
from annolytics.llm.common import id_crc, table

# A conversation about the control strings themselves.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def sha256_text(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], rows.schema
    )
    done = chat_format.format_chats(rows.unionByName(probe))
    read = done.select(
        "conv_id",
        "formatted",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat_format.learned_texts(F.col("formatted"), F.col("loss_spans")), "").alias("learned"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        sha256_text(F.array_join(said, "")).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        sha256_text(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.fresh_index(spark)
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), index)
    index.drop()  # the groups are written by now
    return groups


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    spaces = F.octet_length("ids") - F.octet_length(F.replace("ids", F.lit(" "), F.lit("")))
    return coded.select(
        "doc_id",
        F.when(F.col("ids") == "", 0).otherwise(spaces + 1).cast("bigint").alias("n_tokens"),
        sha256_text(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    kinds = [r.kind for r in secret_scan.BASE]
    named = F.transform("found", lambda s: s["kind"])
    counts = [
        F.size(F.filter(named, F.lit(k).eqNullSafe)).cast("bigint").alias(f"n_{k}") for k in kinds
    ]
    return found.select(
        "doc_id",
        *counts,
        sha256_text(secret_scan.span_text("found", kinds)).alias("base_sha256"),
        secret_scan.span_text("found").alias("spans"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (id_crc() % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_table(table(spark, sf_dir, "documents"))


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return language.with_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score"
    )


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_exact_dedup,
        op3_byte_bpe,
        op4_best_fit_packing,
        op5_secret_scan,
        op6_quality,
        op7_suffix_tree_lm,
        op8_simhash,
        op9_webp,
        op10_hash_tree_shards,
        op11_ranked_search,
        op12_filter_audit,
        op13_language_id,
    )
}
