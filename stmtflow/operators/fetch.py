"""Fetch: booked rows of all documents of all sources, keyed and merged, with statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ranking import first_in_group
from stmtflow.operators.keys import keyed_once


def booked(rows: DataFrame) -> DataFrame:
    # before any key is given: a pending row that is booked later must not shift other rows
    return rows.where(~F.col("pending"))


def pending_split(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_id", "doc").agg(
        F.count_if(~F.col("pending")).alias("booked_rows"),
        F.count_if("pending").alias("pending_rows"),
    )


def fetch_transactions(rows: DataFrame, long_documents: DataFrame | None = None) -> DataFrame:
    return keyed_once(booked(rows), long_documents)


def fetch_stats(merged: DataFrame, document_counts: DataFrame) -> DataFrame:
    """Per source: fetched rows, booking window, documents read and pending rows left out.

    ``document_counts``: source_id, doc, pending_rows.
    """
    fetched = merged.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.min("booking_date").alias("window_from"),
        F.max("booking_date").alias("window_to"),
    )
    files = document_counts.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum("pending_rows").alias("pending_rows")
    )
    return (
        files.join(fetched, "source_id", "left")
        .fillna(0, ["fetched"])
        .select("source_id", "fetched", "pending_rows", "files", "window_from", "window_to")
    )


def newest_statement_balance(documents: DataFrame) -> DataFrame:
    """Balance of the document that reaches furthest, then the youngest file, then the first path.

    ``documents``: source_id, doc, modified_at, last_booking, balance_cents, balance_date.
    """
    stated = documents.where("balance_cents is not null and last_booking is not null")
    best = first_in_group(
        stated, ["source_id"], [F.desc("last_booking"), F.desc("modified_at"), F.asc("doc")]
    )
    return best.select(
        "source_id",
        F.col("doc").alias("statement_doc"),
        F.col("balance_cents").alias("statement_balance_cents"),
        F.coalesce("balance_date", F.to_date("modified_at")).alias("statement_balance_date"),
    )
