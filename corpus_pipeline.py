"""The pipeline over documents: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.llm import jaccard_join, mixing, packing, personal_data, quality_rules
from stmtflow.llm.common import column_of, fenced, in_file_order, table
from stmtflow.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go."""
    return quality_rules.apply_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near copies stays."""
    return jaccard_join.one_of_each_group(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: spans found become their kind in brackets, and ``n_chars`` follows the text."""
    model = personal_data.fit(docs)
    inner, back = fenced(docs)
    found = inner.withColumn("_found", personal_data.finder(model, F.col(column_of(docs, "text"))))
    changed = found.withColumn("_text", F.col("_found.redacted"))
    size = F.when(F.col("_found.spans") != "", F.length("_text").cast("bigint")).otherwise(F.col(column_of(docs, "n_chars")))
    done = back(changed.withColumn("_size", size), {"text": "_text", "n_chars": "_size"})
    return done.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: the rows in the order of the mix, which packing keeps."""
    return mixing.mix(docs, ordered=True).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents in sequences of at most 1024 tokens, in the order of the files."""
    return packing.pack(in_file_order(docs)).drop("row")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("jaccard_join", distinct),
    ("personal_data", without_personal_data),
    ("mix_sources", mixed),
    ("pack", packed),
]

#: SQL cannot express the later stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them stays in the shared folder, so lost executors cost little."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        done.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{number}-{name}")
    return docs
