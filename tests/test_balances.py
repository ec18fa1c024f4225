"""Opening rows in the budget transactions."""

from datetime import date

from stmtflow.operators import balances

TXN = "id string, account_id string, booking_date date, amount_cents bigint, imported_id string"
OPENING = (
    "action string, opening_id string, dated date, starting_balance_cents bigint, account_id string, imported_id string, "
    "off_budget boolean"
)


def test_openings_come_to_the_transactions(spark):
    day = date(2026, 1, 5)
    rows = spark.createDataFrame([("o1", "a", day, 5, "s:starting-balance"), ("t1", "a", day, 7, None), (None, "a", day, 9, None)], TXN)
    openings = spark.createDataFrame([("updated", "o1", date(2025, 1, 1), 50, "a", "s:starting-balance", False)], OPENING)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = balances.apply_opening(rows, openings)
        got = sorted((r.id or "", r.booking_date, r.amount_cents) for r in after.collect())
        plan = after._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("", day, 9), ("o1", date(2025, 1, 1), 50), ("t1", day, 7)]
    # one row per source is sent to the tasks; no transaction is shuffled for it
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
