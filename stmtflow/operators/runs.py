"""Run log: an append-only list of run events whose newest event per run is its state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ranking import first_in_group

FETCHED, OK, ERROR, ABANDONED = "fetched", "ok", "error", "abandoned"
DEFAULT_TTL = timedelta(seconds=3600)
# The reasons as the run log holds them.
RESTARTED = "pipeline restarted before import"
EXPIRED = "batch expired before import"


def current_runs(events: DataFrame) -> DataFrame:
    """Newest event per run; ``seq`` orders the events of a run."""
    return first_in_group(events, ["id"], [F.desc("seq")]).drop("seq")


def abandon_stale(runs: DataFrame, now: Column) -> DataFrame:
    stale = F.col("status") == FETCHED
    return _close(runs, stale, now, RESTARTED)


def expire(runs: DataFrame, now: Column, ttl: timedelta = DEFAULT_TTL) -> DataFrame:
    """Fetched but not imported within the time to live."""
    limit = F.make_interval(secs=F.lit(int(ttl.total_seconds())))
    late = (F.col("status") == FETCHED) & (now > F.col("started_at") + limit)
    return _close(runs, late, now, EXPIRED)


def _close(runs: DataFrame, which: Column, now: Column, reason: str) -> DataFrame:
    return (
        runs.withColumn("_close", which)
        .withColumn("status", F.when(F.col("_close"), ABANDONED).otherwise(F.col("status")))
        .withColumn("finished_at", F.when(F.col("_close"), now).otherwise(F.col("finished_at")))
        .withColumn("error", F.when(F.col("_close"), reason).otherwise(F.col("error")))
        .drop("_close")
    )


def latest_statement_balance(runs: DataFrame) -> DataFrame:
    """Balance stated by the newest successful run of each source."""
    stated = runs.where((F.col("status") == OK) & F.col("statement_balance_cents").isNotNull())
    return first_in_group(stated, ["source_id"], [F.desc("started_at"), F.desc("id")]).select(
        "source_id",
        "statement_balance_cents",
        "statement_balance_date",
        F.col("started_at").alias("seen_at"),
    )


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def source_status(sources: DataFrame, ledger_sizes: DataFrame, runs: DataFrame) -> DataFrame:
    """Configured sources with their ledger size and their last run, however long ago it was."""
    newest = F.max_by(F.struct("started_at", "status"), F.struct("started_at", "id")).alias("r")
    last = runs.groupBy("source_id").agg(newest).select(
        "source_id",
        F.date_format("r.started_at", "yyyy-MM-dd'T'HH:mm").alias("last_run_at"),
        F.col("r.status").alias("last_run_status"),
    )
    return (
        sources.withColumnRenamed("id", "source_id")
        .join(ledger_sizes, "source_id", "left")
        .join(last, "source_id", "left")
        .fillna(0, ["ledger_rows"])
        .select(
            "source_id", "connector", "format", "actual_account", "ledger_rows",
            "last_run_at", "last_run_status",
        )
    )


def balance_drift(runs: DataFrame) -> DataFrame:
    """Budget balance after the import minus the bank's balance; null unless both are known."""
    return runs.select(
        "id",
        "source_id",
        (F.col("actual_balance_cents") - F.col("statement_balance_cents")).alias("balance_delta_cents"),
    )
