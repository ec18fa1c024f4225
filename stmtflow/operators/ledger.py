"""Import ledger: which rows are known, and the next version of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.identity import imported_id, packed, unpacked
from stmtflow.operators.keys import KEY
from stmtflow.session import cut_lineage

NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"


def _packed_import_id() -> Column:
    """The import id unless it follows from the key."""
    follows = imported_id("source_id", "source_key")
    return F.when(~F.col("imported_id").eqNullSafe(follows), F.struct("imported_id"))


def _unpacked_import_id(own: Column, source: Column, key: Column) -> Column:
    return F.when(own.isNull(), imported_id(source, key)).otherwise(own["imported_id"])


def partition(txn: DataFrame, ledger: DataFrame, kept_by_key: bool = False, carrying: bool = False) -> DataFrame:
    """Adds ``dedup_status``. Both sides are unique per key, so no key can be skewed.

    Digests go to the join in half their size, and an import id that follows from the key not at all. ``kept_by_key`` leaves
    the key as it is, for a next join by ``KEY`` that finds the rows where this one has put them. ``carrying`` brings all rows of the
    ledger along as ``_before``, for ``record``, which then needs no join of its own; those that no row has met have no status.
    """
    key = F.col("source_key") if kept_by_key else packed("source_key")
    listed = F.col("raw_fingerprint").isNotNull()
    known = ledger.select(
        key.alias("_key"), F.col("source_id").alias("_source"), packed("raw_fingerprint").alias("_known"), listed.alias("_listed"),
        *[(_packed_import_id() if c == "imported_id" else F.col(c)).alias(f"_l_{c}") for c in _kept(ledger) if carrying],
    )
    sent = {"raw_fingerprint": packed("raw_fingerprint")}
    back = {"raw_fingerprint": unpacked("raw_fingerprint")}
    if not kept_by_key:
        sent["source_key"], back["source_key"] = key, unpacked("source_key")
        if "imported_id" in txn.columns:
            sent["imported_id"] = _packed_import_id()
            back["imported_id"] = _unpacked_import_id(F.col("imported_id"), F.col("source_id"), unpacked("source_key"))
    if carrying:
        before_key = F.col("_key") if kept_by_key else unpacked("_key")
        own = {"imported_id": _unpacked_import_id(F.col("_l_imported_id"), F.col("_source"), before_key)}
        back["_before"] = F.when(F.col("_here"), F.struct(
            before_key.alias("source_key"), F.col("_source").alias("source_id"), unpacked("_known").alias("raw_fingerprint"),
            *[own.get(c, F.col(f"_l_{c}")).alias(c) for c in _kept(ledger)],
        ))
        known, sent["_met"] = known.withColumn("_here", F.lit(True)), F.lit(True)
    # a status inside another, so that those who only want new rows need no fingerprints
    known_as = F.when(F.col("_known") != F.col("raw_fingerprint"), CHANGED).otherwise(UNCHANGED)
    same = (F.col("source_key") == F.col("_key")) & (F.col("source_id") == F.col("_source"))
    joined = txn.withColumns(sent).join(known, same, "full_outer" if carrying else "left")
    status = F.when(~F.coalesce("_listed", F.lit(False)), NEW).otherwise(known_as)
    return (
        joined.withColumn("dedup_status", F.when(F.col("_met"), status) if carrying else status)
        .withColumns(back)
        .select(*KEY, *[c for c in txn.columns if c not in KEY], "dedup_status", *["_before" for _ in range(carrying)])
    )


def _kept(ledger: DataFrame) -> list[str]:
    return [c for c in ledger.columns if c not in (*KEY, "raw_fingerprint")]


def only(carrying: DataFrame, *statuses: str) -> DataFrame:
    """``partition`` with the ledger's rows, of which only rows of these statuses are to be recorded."""
    wanted = F.when(F.col("dedup_status").isin(*statuses), F.col("dedup_status"))
    return carrying.withColumn("dedup_status", wanted).where("dedup_status is not null or _before is not null")


def partition_counts(partitioned: DataFrame) -> DataFrame:
    return partitioned.groupBy("source_id").agg(
        *[
            F.count_if(F.col("dedup_status") == s).alias(f"{s}_rows")
            for s in (NEW, CHANGED, UNCHANGED)
        ]
    )


def record(ledger: DataFrame, partitioned: DataFrame, accounts: DataFrame, run: str | Column, now: Column) -> DataFrame:
    """Next ledger after an import: insert new rows, refresh changed ones, touch unchanged ones.

    ``accounts``: source_id, actual_account_id. Insert, update and touch are one outer join, which a partition that carries the
    rows of this ledger has made already.
    """
    run = F.lit(run) if isinstance(run, str) else run
    columns = ["imported_id", "booking_date", "amount_cents", "raw_fingerprint", "dedup_status"]
    owner = accounts.select("source_id", "actual_account_id")
    if "_before" in partitioned.columns:
        recorded = F.col("dedup_status").isNotNull()
        joined = (
            partitioned.alias("d")
            .join(owner.alias("o"), (F.col("d.source_id") == F.col("o.source_id")) & recorded, "left")
            .withColumn("_run", F.when(recorded, run))
        )
        old, new = F.col("_before").getField, lambda name: F.col(f"o.{name}" if name == "actual_account_id" else name if name == "_run" else f"d.{name}")
        keys = [F.when(F.col("_before").isNull(), F.col(f"d.{k}")).otherwise(old(k)).alias(k) for k in KEY]
    else:
        delta = partitioned.select(*KEY, *columns).join(owner, "source_id", "left").withColumn("_run", run)
        joined = ledger.alias("l").join(delta.alias("d"), KEY, "full_outer")
        old, new = lambda name: F.col(f"l.{name}"), lambda name: F.col(f"d.{name}")
        keys = KEY
    seen = new("dedup_status").isNotNull()
    refreshed = new("dedup_status").isin(NEW, CHANGED)

    def latest(name: str) -> Column:
        return F.when(refreshed, new(name)).otherwise(old(name)).alias(name)

    def first(name: str, otherwise: Column) -> Column:
        return F.when(old("imported_id").isNotNull(), old(name)).otherwise(otherwise).alias(name)

    return joined.select(
        *keys,
        first("imported_id", F.when(seen, new("imported_id"))),
        first("actual_account_id", new("actual_account_id")),
        latest("booking_date"),
        latest("amount_cents"),
        latest("raw_fingerprint"),
        first("first_run_id", new("_run")),
        F.when(seen, new("_run")).otherwise(old("last_run_id")).alias("last_run_id"),
        first("first_seen_at", now),
        F.when(seen, now).otherwise(old("last_seen_at")).alias("last_seen_at"),
    )


def record_fetched(
    txn: DataFrame, ledger: DataFrame, statuses: list[str], accounts: DataFrame, run: str | Column, now: Column
) -> DataFrame:
    """``record`` of what ``partition`` gives one of these statuses, in one join.

    Keys that the ledger has more than once, if any, go through two joins, which pair each of their rows with each.
    """
    twice = cut_lineage(
        ledger.groupBy(packed("source_key").alias("_key"), "source_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select(unpacked("_key").alias("source_key"), "source_id")
    )

    def once(txn: DataFrame, ledger: DataFrame) -> DataFrame:
        return record(ledger, only(partition(txn, ledger, carrying=True), *statuses), accounts, run, now)

    if twice.isEmpty():
        return once(txn, ledger)
    repeated, again = (df.join(twice, KEY, "left_semi") for df in (txn, ledger))
    delta = partition(repeated, again).where(F.col("dedup_status").isin(statuses))
    return once(*(df.join(twice, KEY, "left_anti") for df in (txn, ledger))).unionByName(record(again, delta, accounts, run, now))


def forget_source(table: DataFrame, source_ids: list[str]) -> DataFrame:
    """Ledger or run table without the given sources; budget rows stay as they are."""
    return table.where(~F.col("source_id").isin(source_ids))


def ledger_size(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("source_id").agg(F.count(F.lit(1)).alias("ledger_rows"))


def earliest_booking(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("source_id").agg(F.min("booking_date").alias("earliest_booking"))


def orphan_sources(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that have ledger rows but are no longer configured."""
    return ledger.select("source_id").distinct().join(
        sources.select(F.col("id").alias("source_id")), "source_id", "left_anti"
    )
