"""Account balances, net worth, reconciliation and opening balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ranking import first_in_group

# Fixed values of the budget store.
OPENING_SUFFIX = ":starting-balance"
OPENING_PAYEE = "Starting Balance"
OPENING_CATEGORY = "Starting Balances"
OPENING_NOTES = "Opening balance derived from the bank statement"


def account_balance(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sum of the live, unsplit transactions of every open account."""
    sums = (
        transactions.where("not tombstone and not is_parent")
        .groupBy("account_id")
        .agg(F.sum("amount_cents").alias("balance_cents"))
    )
    return (
        accounts.where("not closed")
        .select(F.col("id").alias("account_id"), "name", "off_budget")
        .join(sums, "account_id", "left")
        .fillna(0, ["balance_cents"])
    )


def net_worth(balances: DataFrame) -> DataFrame:
    def total(which):
        return F.coalesce(F.sum(F.when(which, F.col("balance_cents"))), F.lit(0))

    off = F.col("off_budget")
    return balances.agg(total(~off).alias("on_budget_cents"), total(off).alias("off_budget_cents")).withColumn(
        "net_worth_cents", F.col("on_budget_cents") + F.col("off_budget_cents")
    )


def reconciliation(sources: DataFrame, latest: DataFrame, balances: DataFrame) -> DataFrame:
    """Sources with both a stated and a budget balance, their difference and whether it is zero.

    Of accounts that share a name the one that :func:`importing.resolve_accounts` takes counts.
    """
    named = first_in_group(balances, ["name"], ["account_id"]).select(
        F.col("name").alias("actual_account"), F.col("balance_cents").alias("actual_balance_cents")
    )
    delta = F.col("actual_balance_cents") - F.col("statement_balance_cents")
    return (
        sources.select(F.col("id").alias("source_id"), "actual_account")
        .join(latest, "source_id")
        .join(named, "actual_account")
        .select(
            "source_id",
            F.col("actual_account").alias("account"),
            "statement_balance_cents",
            "statement_balance_date",
            "actual_balance_cents",
            delta.alias("delta_cents"),
            (delta == 0).alias("reconciled"),
        )
    )


def opening_balance(
    resolved: DataFrame, latest: DataFrame, earliest: DataFrame, balances: DataFrame, existing: DataFrame
) -> DataFrame:
    """Opening amount per source so that the account totals the last stated balance.

    Dated the day before the earliest imported row. ``existing``: budget transactions with
    ``imported_id``; the opening row of a source is found by its own import id.
    """
    openings = first_in_group(
        existing.where(F.endswith("imported_id", F.lit(OPENING_SUFFIX)) & ~F.col("tombstone")),
        ["account_id", "imported_id"],
        ["id"],
    ).select(
        "account_id",
        "imported_id",
        F.col("id").alias("opening_id"),
        F.col("amount_cents").alias("previous"),
        F.col("booking_date").alias("previous_date"),
    )
    joined = (
        resolved.withColumn("imported_id", F.concat("source_id", F.lit(OPENING_SUFFIX)))
        .join(latest, "source_id", "left")
        .join(earliest, "source_id", "left")
        .join(balances.select("account_id", "balance_cents"), "account_id", "left")
        .join(openings, ["account_id", "imported_id"], "left")
    )
    others = F.coalesce("balance_cents", F.lit(0)) - F.coalesce("previous", F.lit(0))
    amount = F.col("statement_balance_cents") - others
    dated = F.date_sub("earliest_booking", 1)
    error = F.coalesce(
        F.col("error"),
        F.when(F.col("statement_balance_cents").isNull(), F.lit("no statement balance known")),
        F.when(F.col("earliest_booking").isNull(), F.lit("nothing imported yet")),
    )
    same = F.equal_null("previous", amount) & F.equal_null("previous_date", dated)
    usable = error.isNull()
    return joined.select(
        "source_id",
        F.col("actual_account").alias("account"),
        "account_id",
        "off_budget",
        "imported_id",
        "opening_id",
        F.when(usable & F.col("previous").isNull(), "created")
        .when(usable & same, "unchanged")
        .when(usable, "updated")
        .alias("action"),
        F.when(usable, dated).alias("dated"),
        "statement_balance_cents",
        "statement_balance_date",
        F.col("previous").alias("previous_starting_balance_cents"),
        F.when(usable, amount).alias("starting_balance_cents"),
        F.when(usable, others + amount).alias("account_balance_after_cents"),
        error.alias("error"),
    )


def apply_opening(existing: DataFrame, openings: DataFrame) -> DataFrame:
    """Next version of the budget transactions with the opening rows created or adjusted."""
    changed = openings.where("action = 'updated'").select(
        F.col("opening_id").alias("id"),
        F.col("starting_balance_cents").alias("_amount"),
        F.col("dated").alias("_date"),
    )
    # one row per source at most, so the transactions stay where they are
    kept = (
        existing.join(F.broadcast(changed), "id", "left")
        .withColumn("amount_cents", F.coalesce("_amount", "amount_cents"))
        .withColumn("booking_date", F.coalesce("_date", "booking_date"))
        .select(*existing.columns)
    )
    created = openings.where("action = 'created'").select(
        F.sha2(F.concat_ws("/", "account_id", "imported_id"), 256).alias("id"),
        "account_id",
        F.col("dated").alias("booking_date"),
        F.col("starting_balance_cents").alias("amount_cents"),
        F.lit(OPENING_PAYEE).alias("payee"),
        F.lit(OPENING_PAYEE).alias("imported_payee"),
        F.lit(OPENING_NOTES).alias("notes"),
        F.when(~F.col("off_budget"), F.lit(OPENING_CATEGORY)).alias("category_id"),
        "imported_id",
        F.lit(True).alias("cleared"),
        F.lit(True).alias("starting_balance_flag"),
        F.lit(False).alias("is_parent"),
        F.lit(False).alias("tombstone"),
    )
    columns = [c for c in created.columns if c in existing.columns]
    return kept.unionByName(created.select(*columns), allowMissingColumns=True)
