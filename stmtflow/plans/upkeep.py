"""Jobs beside the import that write: opening balances and the rules over what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ranking import first_in_group
from stmtflow.operators import balances, importing, ledger, rules, runs
from stmtflow.session import cut_lineage, scratch
from stmtflow.sources.registry import registry
from stmtflow.sources.store import SnapshotStore

INCOME_GROUP = "Income"  # fixed value of the budget store


def _named(table: DataFrame, name: str) -> str | None:
    """Id of the first live row of that name."""
    found = first_in_group(table.where((F.col("name") == name) & ~F.col("tombstone")), ["name"], ["id"]).first()
    return found.id if found else None


def _added(table: DataFrame, **values) -> DataFrame:
    """The table with one more row; columns that are not named are null."""
    row = table.sparkSession.createDataFrame([tuple(values.get(f.name) for f in table.schema)], table.schema)
    return table.unionByName(row)


def opening_balances(store: SnapshotStore, sources: DataFrame, run_id: str, *, dry_run: bool = False) -> DataFrame:
    """Creates or adjusts the opening row of each source so that its account totals the last stated balance.

    The row has the payee and, on budget, the income category that the budget store gives to opening balances; both
    are created where they are missing. Returns one row per source with what was done.
    """
    with scratch(store.spark):
        state = store.state(before=run_id)
        people, kinds, groups, rows = (state(n) for n in ("payee", "category", "category_group", "budget_txn"))
        openings = cut_lineage(
            balances.opening_balance(
                importing.resolve_accounts(registry(sources), state("account")),
                runs.latest_statement_balance(state("import_run")),
                ledger.earliest_booking(state("import_ledger")),
                balances.account_balance(rows, state("account")),
                rows,
            )
        )
        tables = {}
        if not dry_run:
            created = openings.where("action = 'created'")
            payee = _named(people, balances.OPENING_PAYEE)
            if payee is None and not created.isEmpty():
                payee = "payee-starting-balance"
                tables["payee"] = _added(people, id=payee, name=balances.OPENING_PAYEE, tombstone=False)
            category = _named(kinds, balances.OPENING_CATEGORY)
            if category is None and not created.where("not off_budget").isEmpty():
                group = _named(groups, INCOME_GROUP)
                if group is None:
                    group = "group-income"
                    tables["category_group"] = _added(groups, id=group, name=INCOME_GROUP, tombstone=False)
                category = "category-starting-balances"
                tables["category"] = _added(kinds, id=category, name=balances.OPENING_CATEGORY, group_id=group, hidden=False, tombstone=False)
            after = balances.apply_opening(rows, openings)
            fresh = F.col("_new").isNotNull()
            new = created.select(F.sha2(F.concat_ws("/", "account_id", "imported_id"), 256).alias("id"), F.lit(True).alias("_new"))
            tables["budget_txn"] = (
                after.join(new, "id", "left")
                .withColumn("payee_id", F.when(fresh, F.lit(payee)).otherwise(F.col("payee_id")))
                .withColumn("category_id", F.when(fresh & F.col("category_id").isNotNull(), F.lit(category)).otherwise(F.col("category_id")))
                .select(*rows.columns)
            )
            store.write(run_id, tables)
        done = openings.drop("opening_id", "imported_id", "off_budget")
        return store.spark.createDataFrame(done.collect(), done.schema)  # one row per source


def apply_rules(store: SnapshotStore, run_id: str, *, uncategorized_only: bool = True) -> DataFrame:
    """Runs the stored rules over the transactions and writes the categories they set.

    By default over those without a category; returns one row: considered, categorized, rules.
    """
    with scratch(store.spark):
        state = store.state(before=run_id)
        rows = state("budget_txn")
        considered = (
            rules.uncategorized(rows, state("payee"), state("account")) if uncategorized_only else rules.live(rows)
        )
        applied = cut_lineage(rules.apply_rules(considered, state("rule")).select("id", "category_id", "new_category_id"))
        changed = applied.where(~F.equal_null("new_category_id", "category_id")).select("id", "new_category_id")
        after = rows.join(changed, "id", "left").withColumn("category_id", F.coalesce("new_category_id", "category_id"))
        store.write(run_id, {"budget_txn": after.select(*rows.columns)})
        done = rules.apply_stats(applied, state("rule"))
        return store.spark.createDataFrame(done.collect(), done.schema)
