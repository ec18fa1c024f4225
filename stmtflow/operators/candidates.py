"""What a categorisation round works on: candidates, categories, examples and their references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.functions.masking import mask_snippet
from stmtflow.functions.ranking import first_in_group

SNIPPETS = 2  # fixed value: purpose texts shown per payee
BATCH = 25
EXAMPLES = 60


def snippets(uncategorised: DataFrame) -> DataFrame:
    """First distinct masked notes per payee, as ``(payee, snippet, at)`` rows."""
    seen = (
        uncategorised.select("payee", mask_snippet("notes").alias("snippet"), F.struct("booking_date", "id").alias("at"))
        .where("snippet <> ''")
        .groupBy("payee", "snippet")
        .agg(F.min("at").alias("at"))
    )
    return first_in_group(seen, ["payee"], ["at"], SNIPPETS)


def excluded_payees(proposals: DataFrame) -> DataFrame:
    return proposals.where(F.col("status").isin("pending", "rejected")).select("payee").distinct()


def candidates(uncategorised: DataFrame, excluded: DataFrame, limit: int | None = BATCH) -> DataFrame:
    """Payees without a category, most transactions first, with average and sample notes."""
    rows = uncategorised.join(excluded, "payee", "left_anti")
    totals = rows.groupBy("payee").agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("amount_cents").alias("_sum")
    )
    top = totals.orderBy(F.desc("tx_count"), "payee").limit(limit) if limit else totals
    # notes are only needed for the payees that stay; at most two snippets per payee are collected
    noted = rows.join(top.select("payee"), "payee", "left_semi") if limit else rows
    shown = (
        snippets(noted)
        .groupBy("payee")
        .agg(F.sort_array(F.collect_list(F.struct("at", "snippet"))).alias("_s"))
        .select("payee", F.transform("_s", lambda s: s["snippet"]).alias("snippets"))
    )
    return top.join(shown, "payee", "left").select(
        "payee",
        "tx_count",
        F.expr("_sum div tx_count").alias("avg_amount_cents"),
        F.coalesce("snippets", F.array().cast("array<string>")).alias("snippets"),
    )


def visible_categories(categories: DataFrame, groups: DataFrame) -> DataFrame:
    named = groups.where("not tombstone").select(F.col("id").alias("group_id"), F.col("name").alias("group"))
    return (
        categories.where("not tombstone and not hidden")
        .join(named, "group_id", "left")
        .select("name", F.coalesce("group", F.lit("")).alias("group"))
    )


def _numbered(df: DataFrame, prefix: str, order: list[Column]) -> DataFrame:
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return df.withColumn("position", position).withColumn("ref", F.concat(F.lit(prefix), F.col("position").cast("string")))


def candidate_refs(shortlist: DataFrame) -> DataFrame:
    """References p1, p2, ... in list order. ``shortlist`` is bounded by its limit."""
    return _numbered(shortlist, "p", [F.desc("tx_count"), F.col("payee")])


def category_refs(visible: DataFrame) -> DataFrame:
    """References c1, c2, ... over (group, name); numbered per group, then shifted."""
    inside = Window.partitionBy("group").orderBy("name")
    sizes = visible.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        visible.withColumn("_i", F.row_number().over(inside))
        .join(shift, "group")
        .withColumn("position", (F.col("_i") + F.col("_before")).cast("bigint"))
        .withColumn("ref", F.concat(F.lit("c"), F.col("position").cast("string")))
        .drop("_i", "_before")
    )


def history_examples(
    transactions: DataFrame, payees: DataFrame, categories: DataFrame, taught: DataFrame
) -> DataFrame:
    """Most frequent category per payee in the categorised history; payees of rules left out."""
    people = payees.where("not tombstone").select(F.col("id").alias("payee_id"), F.col("name").alias("payee"))
    kinds = categories.where("not tombstone").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    # counted by id first, so the joins and the second count work on pairs, not on transactions
    pairs = (
        transactions.where("not tombstone and not is_parent and category_id is not null")
        .groupBy("payee_id", "category_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = (
        pairs.join(people, "payee_id").join(kinds, "category_id")
        .groupBy("payee", "category").agg(F.sum("_n").alias("tx_count"))
    )
    best = first_in_group(counts, ["payee"], [F.desc("tx_count"), F.asc("category")])
    return best.join(taught.select("payee"), "payee", "left_anti")


def categorization_examples(taught: DataFrame, history: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """Rules first, then history by frequency, cut to ``limit``; ``position`` gives the order."""
    place = ["rule_order", "rule_id", "position", "item"]
    first = taught.orderBy(*place).limit(limit).select(
        "payee", "category", F.lit("rule").alias("source"), F.lit(0).alias("_kind"),
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*place)).alias("_i"),
    )
    order = [F.desc("tx_count"), F.asc("payee"), F.asc("category")]
    second = history.orderBy(*order).limit(limit).select(
        "payee", "category", F.lit("history").alias("source"), F.lit(1).alias("_kind"),
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("_i"),
    )
    every = first.unionByName(second)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_kind", "_i"))
    return every.withColumn("position", position).where(F.col("position") <= limit).drop("_kind", "_i")
