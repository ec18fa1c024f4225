"""Category proposals: validate, store, list, select and decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ranking import first_in_group
from stmtflow.functions.text import loose_key, strip
from stmtflow.schemas import RAW_PROPOSALS

PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"
REASON_LENGTH = 300
SHORT_ID_LENGTH = 8
LISTED = 200


def read_proposals(raw: DataFrame) -> DataFrame:
    """One row per proposal of each JSON answer (``doc``, ``json``), in answer order ``pos``."""
    return raw.select(
        "doc",
        F.posexplode(F.from_json("json", RAW_PROPOSALS)["proposals"]).alias("pos", "p"),
    ).select("doc", "pos", "p.*")


def with_others(shortlist: DataFrame, others: DataFrame) -> DataFrame:
    """The round's candidates plus every other uncategorised payee, which has no reference."""
    more = others.join(shortlist.select("payee"), "payee", "left_anti")
    return shortlist.select("payee", "ref", "tx_count", "avg_amount_cents", "snippets").unionByName(
        more.select("payee", "tx_count", "avg_amount_cents", "snippets"), allowMissingColumns=True
    )


def _reference(value: str) -> Column:
    return F.nullif(F.lower(strip(value)), F.lit(""))


def _loose(value: str) -> Column:
    return F.nullif(loose_key(value), F.lit(""))


def _last_by_key(df: DataFrame, name: str, order: list[Column], alias: str) -> DataFrame:
    keyed = df.withColumn("_key", _loose(name)).where("_key is not null")
    return first_in_group(keyed, ["_key"], order).select("_key", F.col(name).alias(alias))


def resolve(proposals: DataFrame, candidates: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds the candidate and the category each proposal means: by reference, else by loose name.

    If two names share a loose key, the later one in list order counts.
    """
    refs = candidates.where("ref is not null")
    by_ref = refs.select(F.col("ref").alias("_ref"), F.col("payee").alias("_payee_r"))
    # list order: referenced candidates first, then the others; both by count, then payee
    later = [F.col("ref").isNull().desc(), F.asc("tx_count"), F.desc("payee")]
    by_name = _last_by_key(candidates, "payee", later, "_payee_n").withColumnRenamed("_key", "_loose")
    cat_ref = categories.select(F.col("ref").alias("_cref"), F.col("name").alias("_cat_r"))
    cat_name = _last_by_key(categories, "name", [F.desc("position")], "_cat_n").withColumnRenamed("_key", "_cloose")
    offered = proposals.select(
        "doc", "pos", "confidence", "reason",
        _reference("ref").alias("_ref"), _loose("payee").alias("_loose"),
        _reference("category_ref").alias("_cref"), _loose("category").alias("_cloose"),
    )
    return (
        offered.join(by_ref, "_ref", "left")
        .join(by_name, "_loose", "left")
        .join(cat_ref, "_cref", "left")
        .join(cat_name, "_cloose", "left")
        .select(
            "doc", "pos", "confidence", "reason",
            F.coalesce("_payee_r", "_payee_n").alias("payee"),
            F.coalesce("_cat_r", "_cat_n").alias("category"),
        )
    )


def clamp_confidence(value: Column | str) -> Column:
    """Into [0, 1] with three decimals; 0 for what is not a number."""
    number = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    # least and greatest skip nulls, so the missing number is handled on its own
    clamped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)), 3)
    return F.when(number.isNull(), F.lit(0.0)).otherwise(clamped)


def drop_reasons(resolved: DataFrame) -> DataFrame:
    """Why proposals were dropped; duplicates are not counted."""
    reason = F.when(F.col("payee").isNull(), "unknown_payee").when(F.col("category").isNull(), "unknown_category")
    return resolved.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(
        F.count(F.lit(1)).alias("dropped")
    )


def validate(resolved: DataFrame, candidates: DataFrame, model: str) -> DataFrame:
    """Usable proposals, the first one per payee."""
    usable = resolved.where("payee is not null and category is not null")
    return (
        first_in_group(usable, ["payee"], ["doc", "pos"])
        .join(candidates.drop("ref"), "payee")
        .select(
            "payee",
            "category",
            clamp_confidence("confidence").cast("decimal(4,3)").alias("confidence"),
            F.left(F.coalesce("reason", F.lit("")), F.lit(REASON_LENGTH)).alias("reason"),
            "tx_count",
            "avg_amount_cents",
            "snippets",
            F.lit(model).alias("model"),
        )
    )


_VALUES = ["category", "confidence", "reason", "tx_count", "avg_amount_cents", "snippets", "model"]


def store(state: DataFrame, proposals: DataFrame, run: str, now: Column) -> DataFrame:
    """Next proposal table: overwrite the pending row of a payee, else insert a pending row."""
    waiting = F.col("status") == PENDING
    decided = state.where(~waiting)
    key = F.md5(F.concat_ws("/", F.lit(run), "payee"))
    fresh = proposals.select("payee", *[F.col(c).alias(f"_{c}") for c in _VALUES], key.alias("_id"))
    joined = state.where(waiting).join(fresh, "payee", "full_outer")
    new = F.col("_id").isNotNull()
    pending = joined.select(
        F.coalesce("id", "_id").alias("id"),
        "payee",
        *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _VALUES],
        F.lit(PENDING).alias("status"),
        F.when(new, now).otherwise(F.col("created_at")).alias("created_at"),
        "decided_at",
        "rule_id",
    )
    return decided.select(*pending.columns).unionByName(pending)


def listing(state: DataFrame, status: str | None = PENDING, limit: int = LISTED) -> DataFrame:
    """Best proposals first; every status if ``status`` is None."""
    rows = state.where(F.col("status") == status) if status else state
    return (
        rows.orderBy(
            F.desc("confidence"), F.desc_nulls_last("tx_count"), F.desc("created_at"), F.asc("id")
        )
        .limit(limit)
        .withColumn("short_id", F.left("id", F.lit(SHORT_ID_LENGTH)))
    )


def select_proposals(state: DataFrame, ids: list[str], min_confidence: float | None = None) -> DataFrame:
    """Pending proposals picked by id prefix or by confidence, from the whole queue."""
    chosen = F.lit(False)
    for prefix in ids:
        chosen = chosen | F.startswith("id", F.lit(prefix))
    if min_confidence is not None:
        chosen = chosen | (F.col("confidence") >= F.lit(min_confidence))
    return state.where((F.col("status") == PENDING) & chosen).withColumn("short_id", F.left("id", F.lit(SHORT_ID_LENGTH)))


def decide(state: DataFrame, decisions: DataFrame, status: str, now: Column) -> DataFrame:
    """``decisions``: id and rule_id (null for a rejection)."""
    made = decisions.select("id", F.col("rule_id").alias("_rule"), F.lit(True).alias("_made"))
    hit = F.col("_made").isNotNull()
    return (
        state.join(made, "id", "left")
        .withColumn("status", F.when(hit, status).otherwise(F.col("status")))
        .withColumn("decided_at", F.when(hit, now).otherwise(F.col("decided_at")))
        .withColumn("rule_id", F.when(hit, F.col("_rule")).otherwise(F.col("rule_id")))
        .select(*state.columns)
    )
