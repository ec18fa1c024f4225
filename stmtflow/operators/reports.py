"""Sections of the summary; each is one small frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.operators import balances, ledger, proposals, runs

TOP_PROPOSALS = 15
TOP_RUNS = 10


def iso_minutes(name: str):
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm").alias(name)


def accounts_section(account_balances: DataFrame) -> DataFrame:
    return account_balances.select("name", "off_budget", "balance_cents")


def proposals_section(state: DataFrame) -> DataFrame:
    return proposals.listing(state, proposals.PENDING, TOP_PROPOSALS).select(
        "short_id", "payee", "category", "confidence", "tx_count"
    )


def runs_section(run_log: DataFrame) -> DataFrame:
    day = [F.col(c).cast("string").alias(c) for c in ("window_from", "window_to")]
    return runs.recent_runs(run_log, TOP_RUNS).select(
        "id", "source_id", iso_minutes("started_at"), iso_minutes("finished_at"), "status", "fetched",
        "new_rows", "updated_rows", "unchanged_rows", "pending_rows", *day, "error", "trigger_source",
        "statement_balance_cents", "actual_balance_cents",
    )


def inbox_section(formats: DataFrame, files: DataFrame) -> DataFrame:
    """Files waiting per source; -1 where the source cannot be read.

    ``files``: source_id, doc of files that were not imported yet.
    """
    waiting = files.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    # a source without a pattern cannot be listed; a bad format only shows when files are read
    return formats.join(waiting, "source_id", "left").select(
        "source_id",
        F.when(F.col("inbox_glob").isNull(), F.lit(-1)).otherwise(F.coalesce("_n", F.lit(0))).cast("bigint").alias("files"),
    )


def summary(
    sources: DataFrame,
    transactions: DataFrame,
    accounts: DataFrame,
    import_ledger: DataFrame,
    run_log: DataFrame,
    proposal_state: DataFrame,
) -> dict[str, DataFrame]:
    worth = balances.account_balance(transactions, accounts)
    latest = runs.latest_statement_balance(run_log)
    return {
        "accounts": accounts_section(worth),
        "net_worth": balances.net_worth(worth),
        "ledger_rows": ledger.ledger_size(import_ledger),
        "reconciliation": balances.reconciliation(sources, latest, worth).withColumn(
            "statement_balance_date", F.col("statement_balance_date").cast("string")
        ),
        "proposals_pending": proposals_section(proposal_state),
        "recent_runs": runs_section(run_log),
    }
