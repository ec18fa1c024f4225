"""Category rules of the budget store.

A rule holds when all its conditions hold; among the rules that hold the highest order wins.
Conditions read a transaction's payee id or its original payee text, so rules are evaluated once
per distinct (payee, text) combination and the outcome is joined back to the transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ranking import first_in_group
from stmtflow.session import cut_lineage

CONDITIONS = "array<struct<field:string,op:string,value:string>>"
LISTED = "array<string>"
GRAM = 3


def uncategorized(transactions: DataFrame, payees: DataFrame, accounts: DataFrame) -> DataFrame:
    """Live rows without a category on open budget accounts, with the payee's name."""
    budget = accounts.where("not closed and not off_budget").select(F.col("id").alias("account_id"))
    people = payees.where("transfer_acct is null").select(
        F.col("id").alias("payee_id"), F.col("name").alias("payee")
    )
    return (
        transactions.where(
            "not tombstone and not is_parent and category_id is null"
            " and not coalesce(starting_balance_flag, false)"
        )
        .join(budget, "account_id", "left_semi")
        .join(people, "payee_id")
    )


def rule_conditions(rules: DataFrame) -> DataFrame:
    """One row per condition of every live rule that sets a category (its first such action)."""
    sets = F.filter(
        F.from_json("actions", CONDITIONS), lambda a: (a["field"] == "category") & (a["op"] == "set")
    )
    conditions = F.from_json("conditions", CONDITIONS)
    return (
        rules.where("not tombstone")
        .withColumn("category_id", F.get(sets, F.lit(0))["value"])
        .where("category_id is not null")
        .withColumn("size", F.size(conditions))
        .select(
            F.col("id").alias("rule_id"), "rule_order", "category_id", "size",
            F.posexplode(conditions).alias("position", "condition"),
        )
        .select("rule_id", "rule_order", "category_id", "size", "position", "condition.*")
    )


def _payee_conditions(conditions: DataFrame) -> DataFrame:
    """``is`` and ``oneOf`` conditions, one row per payee id and list position."""
    ids = F.when(F.col("op") == "is", F.array("value")).when(
        F.col("op") == "oneOf", F.from_json("value", LISTED)
    )
    return conditions.where("field = 'description'").select(
        "rule_id", "rule_order", "category_id", "size", "position",
        F.posexplode(ids).alias("item", "payee_id"),
    )


def _text_conditions(conditions: DataFrame) -> DataFrame:
    return conditions.where("field = 'imported_description' and op = 'contains'")


def rule_examples(rules: DataFrame, payees: DataFrame, categories: DataFrame) -> DataFrame:
    """Payee and category pairs the rules teach; the first rule that names a payee counts."""
    known = categories.where("not tombstone").select(
        F.col("id").alias("category_id"), F.col("name").alias("category")
    )
    live = payees.where("not tombstone").select(F.col("id").alias("payee_id"), F.col("name").alias("payee"))
    conditions = rule_conditions(rules)
    named = _payee_conditions(conditions).join(live, "payee_id")
    texts = _text_conditions(conditions).select(
        "rule_id", "rule_order", "category_id", "size", "position", F.lit(0).alias("item"),
        F.concat(F.lit("*"), "value", F.lit("*")).alias("payee"),
    )
    place = ["rule_order", "rule_id", "position", "item"]
    both = named.select(*texts.columns).unionByName(texts).join(known, "category_id")
    return first_in_group(both, ["payee"], place).select("payee", "category", *place)


def _contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) pairs where the text contains the pattern, ignoring case.

    Only true pairs are formed: a text is cut where a pattern's first characters occur, to the
    lengths of the patterns that begin so, and the pieces are joined with the patterns.
    """
    wanted = (
        patterns.select(F.lower("value").alias("pattern")).where("pattern <> ''").distinct()
        .withColumn("length", F.char_length("pattern"))
        .withColumn("gram", F.left("pattern", F.lit(GRAM)))
    )
    starts = wanted.select("gram", "length").distinct()
    lowered = texts.withColumn("_low", F.lower("imported_payee"))
    grams = F.transform(
        F.sequence(F.lit(1), F.char_length("_low")),
        lambda at: F.transform(
            F.array(*[F.lit(n) for n in range(1, GRAM + 1)]),
            lambda n: F.struct(at.alias("at"), F.substring("_low", at, n).alias("gram")),
        ),
    )
    pieces = (
        lowered.where("_low <> ''")
        .withColumn("_g", F.explode(F.array_distinct(F.flatten(grams))))
        .select("imported_payee", "_low", "_g.at", "_g.gram")
        .join(starts, "gram")
        .select("imported_payee", F.substring("_low", F.col("at"), F.col("length")).alias("pattern"))
        .distinct()
    )
    return pieces.join(wanted.select("pattern"), "pattern")


def rule_outcomes(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """Category the rules give to each distinct (payee_id, imported_payee) that matches any."""
    # far fewer than the transactions, and read by every kind of condition
    seen = cut_lineage(transactions.select("payee_id", "imported_payee").distinct())
    conditions = rule_conditions(rules)
    carried = ["rule_id", "rule_order", "category_id", "size", "position"]
    by_payee = seen.join(_payee_conditions(conditions).select(*carried, "payee_id").distinct(), "payee_id")
    texts = _text_conditions(conditions).withColumn("pattern", F.lower("value"))
    found = _contained(seen.select("imported_payee").distinct(), texts).join(
        texts.select(*carried, "pattern"), "pattern"
    )
    by_text = seen.join(found.drop("pattern"), "imported_payee")
    held = by_payee.select("payee_id", "imported_payee", *carried).unionByName(
        by_text.select("payee_id", "imported_payee", *carried)
    )
    full = (
        held.groupBy("payee_id", "imported_payee", "rule_id", "rule_order", "category_id", "size")
        .agg(F.count_distinct("position").alias("_held"))
        .where("_held = size")
    )
    return full.groupBy("payee_id", "imported_payee").agg(
        F.max_by("category_id", F.struct("rule_order", "rule_id")).alias("rule_category")
    )


def apply_rules(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """``transactions`` (already limited to those considered) with ``new_category_id``."""
    outcome = rule_outcomes(transactions, rules).select(
        F.col("payee_id").alias("_p"), F.col("imported_payee").alias("_t"), "rule_category"
    )
    same = F.col("payee_id").eqNullSafe(F.col("_p")) & F.col("imported_payee").eqNullSafe(F.col("_t"))
    return (
        transactions.join(outcome, same, "left")
        .withColumn("new_category_id", F.coalesce("rule_category", "category_id"))
        .drop("_p", "_t", "rule_category")
    )


def live(transactions: DataFrame) -> DataFrame:
    return transactions.where("not tombstone and not is_parent")


def apply_stats(applied: DataFrame, rules: DataFrame) -> DataFrame:
    changed = ~F.equal_null("new_category_id", "category_id")
    one, none = F.lit(1), F.lit(0)
    rows = applied.select(one.alias("considered"), changed.cast("int").alias("categorized"), none.alias("rules"))
    live_rules = rules.where("not tombstone").select(none.alias("considered"), none.alias("categorized"), one.alias("rules"))
    return rows.unionByName(live_rules).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("considered", "categorized", "rules")]
    )


def new_rules(approved: DataFrame, payees: DataFrame, categories: DataFrame) -> DataFrame:
    """A rule per approved (payee, category); ``error`` where a name is unknown.

    A name that several payees share means the first of them.
    """
    people = first_in_group(payees.where("not tombstone"), ["name"], ["id"]).select(
        F.col("name").alias("payee"), F.col("id").alias("payee_id")
    )
    kinds = first_in_group(categories.where("not tombstone"), ["name"], ["id"]).select(
        F.col("name").alias("category"), F.col("id").alias("category_id")
    )

    def clause(field: str, op: str, value: str):
        return F.to_json(
            F.array(F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.col(value).alias("value")))
        )

    return (
        approved.join(people, "payee", "left")
        .join(kinds, "category", "left")
        .withColumn(
            "error",
            F.when(F.col("payee_id").isNull(), F.lit("payee not found")).when(
                F.col("category_id").isNull(), F.lit("category not found")
            ),
        )
        .withColumn("rule_id", F.concat(F.lit("rule-"), F.md5(F.concat_ws("/", "payee_id", "category_id"))))
        .withColumn("conditions", clause("description", "is", "payee_id"))
        .withColumn("actions", clause("category", "set", "category_id"))
    )


def rule_backfill(uncategorised: DataFrame, created: DataFrame) -> DataFrame:
    """Uncategorised rows of the approved payees with the category they get."""
    usable = created.where("error is null").select(
        "payee_id", F.col("category_id").alias("new_category_id"), "rule_id"
    )
    return uncategorised.join(usable, "payee_id")
