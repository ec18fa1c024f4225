"""Registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.llm import (
    inner_products, jaccard_join, language_model, mixing, neighbours, packing, periodic_runs, personal_data, quality_classifier,
    quality_rules, sharding, token_alignment, url_filters,
)
from stmtflow.llm.common import table


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document stands in the mix of its sources."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "stream", "block", "release", "deadline", "slot", "offset")


def op2_shuffle_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of each document after the two-pass shuffle."""
    done = sharding.shuffle_shards(table(spark, folder, "documents"), 8)
    text = F.coalesce("text", F.lit(""))
    return done.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Group of each document under links of 5-word shingles with Jaccard similarity 0.8 or more."""
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of each document: counts and digest of the pattern spans, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = personal_data.fit(docs)
    found = docs.select("doc_id", personal_data.finder(model, F.col("text"), with_text=False).alias("f"))
    return found.select("doc_id", *[f"f.n_{k}" for k in personal_data.KINDS], "f.base_sha256", "f.spans")


def op5_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, folder, "documents")).drop("row")


def _fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram and maximum-entropy score of each document."""
    docs = table(spark, folder, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return language_model.score(docs, fold == 2)


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of each document, learnt from positives of the training fold and unlabelled text."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_classifier.classify(docs, labels, _fold("doc_id", 3) == 1)


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest found of every hundredth vector among all others."""
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on each page's url by rule, or by the trust of its host."""
    return url_filters.judge_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of each document under risk-controlled cutoffs."""
    return quality_rules.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in each document, where every tenth one (by its id's checksum) ends in a planted run."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, folder, "documents").select("doc_id", periodic_runs.with_planted_tail(F.col("text"), hashed).alias("text"))
    found = periodic_runs.find_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in each document, with the links' counts over all documents."""
    done = token_alignment.align(table(spark, folder, "documents"), groups="sha256")
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 greatest integer inner products of every hundredth vector with all others."""
    return inner_products.top_products(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_shuffle_shards, op3_jaccard_join, op4_personal_data, op5_pack, op6_language_model, op7_quality_classifier, op8_url_filters, op9_quality_rules, op10_neighbours,
        op11_periodic_runs, op12_token_alignment, op13_inner_products,
    )
}
