"""Import of new rows into the budget store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.identity import payee_name
from stmtflow.functions.ranking import first_in_group
from stmtflow.operators.keys import KEY
from stmtflow.operators.ledger import NEW, UNCHANGED
from stmtflow.operators.matching import BLOCK, adoptable, match_assign, match_exact
from stmtflow.operators.rules import rule_outcomes
from stmtflow.session import cut_lineage

CREATED, ADOPTED, UPDATED, KEPT = "created", "adopted", "updated", "unchanged"
NOTES_LENGTH = 500  # fixed value of the budget store


def resolve_accounts(sources: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sources with their budget account by name; ``error`` where there is none.

    Of accounts that share a name the open one counts, then the smallest id.
    """
    named = first_in_group(accounts, ["name"], [F.coalesce("closed", F.lit(False)), "id"]).select(
        F.col("name").alias("actual_account"), F.col("id").alias("account_id"), "off_budget"
    )
    return (
        sources.select(F.col("id").alias("source_id"), "actual_account")
        .join(named, "actual_account", "left")
        .withColumn(
            "error",
            F.when(F.col("account_id").isNull(), F.concat(F.lit("no account named "), "actual_account")),
        )
    )


def importable(partitioned: DataFrame, resolved: DataFrame) -> DataFrame:
    """New rows in the shape of the budget store. Changed rows are recorded, never imported."""
    accounts = resolved.where("error is null").select("source_id", "account_id")
    return partitioned.where(F.col("dedup_status") == NEW).join(accounts, "source_id").select(
        "source_id",
        "source_key",
        "account_id",
        "imported_id",
        "booking_date",
        "amount_cents",
        payee_name().alias("payee"),
        F.left("purpose", F.lit(NOTES_LENGTH)).alias("notes"),
    )


def import_plan(rows: DataFrame, existing: DataFrame, block: int = BLOCK) -> DataFrame:
    """What happens to each new row: ``action`` and the transaction it concerns, if any.

    Exact matches have an import id and adoptable transactions have none, so the two steps
    cannot compete for a transaction. A dry run computes the same plan and writes nothing.
    """
    # read by both branches here and by every later step of the import
    exact = cut_lineage(match_exact(rows, existing))
    found = exact.where("matched_id is not null").withColumn(
        "action", F.when(F.col("differs"), UPDATED).otherwise(KEPT)
    )
    missing = exact.where("matched_id is null").drop("matched_id")
    adopted = match_assign(missing, adoptable(existing), block).withColumnRenamed("id", "matched_id")
    other = missing.join(adopted, KEY, "left").withColumn(
        "action", F.when(F.col("matched_id").isNotNull(), ADOPTED).otherwise(CREATED)
    )
    return found.unionByName(other).drop("differs")


def import_counts(plan: DataFrame, partitioned: DataFrame) -> DataFrame:
    """Counters per source. Changed rows are counted nowhere."""
    planned = plan.groupBy("source_id").agg(
        F.count_if(F.col("action") == CREATED).alias("added"),
        F.count_if(F.col("action").isin(ADOPTED, UPDATED)).alias("updated"),
        F.count_if(F.col("action") == KEPT).alias("_kept"),
    )
    known = partitioned.groupBy("source_id").agg(
        F.count_if(F.col("dedup_status") == UNCHANGED).alias("_known")
    )
    return (
        known.join(planned, "source_id", "left")
        .fillna(0)
        .select("source_id", "added", "updated", (F.col("_known") + F.col("_kept")).alias("unchanged"))
    )


def with_payees(plan: DataFrame, payees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan with payee ids, and the payee table with the names that were missing."""
    known = first_in_group(payees.where("not tombstone"), ["name"], ["id"]).select(
        F.col("name").alias("payee"), F.col("id").alias("payee_id")
    )
    concerned = plan.where(F.col("action").isin(CREATED, ADOPTED))
    missing = concerned.select("payee").distinct().join(known, "payee", "left_anti")
    created = missing.select(
        F.concat(F.lit("payee-"), F.md5("payee")).alias("id"), F.col("payee").alias("name"),
        F.lit(None).cast("string").alias("transfer_acct"), F.lit(False).alias("tombstone"),
    )
    every = known.unionByName(created.select(F.col("name").alias("payee"), F.col("id").alias("payee_id")))
    return plan.join(every, "payee", "left"), payees.unionByName(created)


def with_categories(plan: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules run over the rows that are created, in the same step."""
    created = plan.where(F.col("action") == CREATED)
    outcome = rule_outcomes(
        created.select("payee_id", F.col("payee").alias("imported_payee")), rules
    ).select("payee_id", F.col("imported_payee").alias("payee"), F.col("rule_category").alias("category_id"))
    return plan.join(outcome, ["payee_id", "payee"], "left")


def apply_plan(existing: DataFrame, plan: DataFrame) -> DataFrame:
    """Next version of the budget transactions.

    Matched rows get date or import id; payee and notes are only filled where they are empty.
    """
    ids = [c for c in ("payee_id",) if c in plan.columns]
    changes = plan.where(F.col("action").isin(ADOPTED, UPDATED)).select(
        F.col("matched_id").alias("id"),
        F.col("action").alias("_action"),
        *[F.col(c).alias(f"_{c}") for c in ("booking_date", "imported_id", "payee", "notes")],
        *[F.col("payee_id").alias("_payee_id") for _ in ids],
    )
    adopted = F.col("_action") == ADOPTED
    updated = F.col("_action") == UPDATED

    def filled(name: str):
        empty = F.coalesce(F.col(name), F.lit("")) == ""
        return F.when(adopted & empty, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    after = existing.join(changes, "id", "left")
    replaced = {
        "booking_date": F.when(updated, F.col("_booking_date")).otherwise(F.col("booking_date")),
        "cleared": F.col("_action").isNotNull() | F.coalesce("cleared", F.lit(False)),
        "imported_id": F.when(adopted, F.col("_imported_id")).otherwise(F.col("imported_id")),
        "imported_payee": F.when(adopted, F.col("_payee")).otherwise(F.col("imported_payee")),
        "payee": filled("payee"),
        "notes": filled("notes"),
        **{c: filled(c) for c in ids},
    }
    kept = after.select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in existing.columns]
    )
    created = plan.where(F.col("action") == CREATED).select(
        F.sha2(F.concat_ws("/", "account_id", "imported_id"), 256).alias("id"),
        "account_id", "booking_date", "amount_cents", "payee", "notes", "imported_id",
        F.lit(True).alias("cleared"), F.col("payee").alias("imported_payee"),
        *[c for c in ("payee_id", "category_id") if c in plan.columns],
        *[F.lit(False).alias(c) for c in ("is_parent", "tombstone", "starting_balance_flag") if c in existing.columns],
    )
    return kept.unionByName(created, allowMissingColumns=True)
