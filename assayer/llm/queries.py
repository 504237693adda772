"""The operators over the whole test tables, one query each, with SQL twins where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, chat, decontamination, katz, langid, line_dedup, negatives, quality, repeats, sharding, simhash, toxicity, whitening
from assayer.llm.common import text_key, whole_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def digest(text):
    return F.sha2(text.cast("binary"), 256)


@query
def op1_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = line_dedup.dedup_lines(docs)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        digest(F.col("kept")).alias("kept_sha256"),
    )


def encoded(docs: DataFrame) -> DataFrame:
    """Token count and digests of a table of documents."""
    found = bpe.encode(docs, RANKS, PATTERN, decode_back=True, keep=["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        digest(listed).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_byte_bpe(spark, sf_dir):
    return encoded(documents(spark, sf_dir))


def spans_text(spans):
    """start-end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


@query
def op3_preference_pairs(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    talks = chat.conversations(turns, "conv_id", "turn", "role", "text")
    found = chat.format_preferences(chat.echo_pairs(talks))
    return found.select(
        F.col("id").alias("conv_id"),
        "prompt_turns",
        digest(F.col("prompt")).alias("prompt_sha256"),
        digest(F.col("chosen_text")).alias("chosen_sha256"),
        digest(F.col("rejected_text")).alias("rejected_sha256"),
        spans_text("chosen_learned").alias("chosen_spans"),
        spans_text("rejected_learned").alias("rejected_spans"),
    )


@query
def op7_bounded_ring(spark, sf_dir):
    found = sharding.bounded_ring(documents(spark, sf_dir), shards=16)
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "home",
    )


@query
def op4_mcd_quality(spark, sf_dir):
    found = quality.judge_quality(documents(spark, sf_dir), keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "distance"
    )


@query
def op8_language_mixture(spark, sf_dir):
    found = langid.identify(documents(spark, sf_dir), keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "held_out",
        "lang_pred",
        "score",
        F.size("languages").alias("n_languages"),
    )


@query
def op5_winnowing(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_benchmark(documents(spark, sf_dir), benchmark, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op9_simhash_variants(spark, sf_dir):
    found = simhash.near_copies(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_digits(F.col("fp")).alias("fingerprint"),
        "component_id",
    )


@query
def op10_repeated_bytes(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = repeats.repeated_spans(docs).select(
        "k1",
        "k2",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("digest"),
    )
    text = whole_text("text")
    k1, k2 = text_key(text)
    whole = docs.select(
        "doc_id",
        k1.alias("k1"),
        k2.alias("k2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        digest(text).alias("whole"),
    )
    return whole.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("digest", "whole").alias("kept_sha256"),
    )


@query
def op6_katz_backoff(spark, sf_dir):
    return katz.katz_scores(documents(spark, sf_dir), order=3).withColumnRenamed("id", "doc_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def op13_cholesky_jacobi_whitening(spark, sf_dir):
    found = whitening.whiten(embeddings(spark, sf_dir), keep=["vec_id"])
    return found.select(
        F.col("row.vec_id").alias("vec_id"),
        "component",
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


@query
def op11_angular_negatives(spark, sf_dir):
    vec_id, label = F.col("vec_id"), F.col("label")
    return negatives.mine_negatives(
        embeddings(spark, sf_dir),
        is_anchor=vec_id % 100 == 0,
        label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label),
    )


@query
def op12_clause_grammar_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score_toxicity(documents(spark, sf_dir), labels, keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")
