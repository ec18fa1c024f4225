"""Statement rows to budget transactions: exact by import id, else one-to-one adoption.

A row adopts a transaction of the same account and amount that was entered by hand (it has no
import id) and lies within seven days. Rows choose in (source, booking date, key) order; each
takes its best transaction that is still free: same payee first, then nearest day, then earlier
day, then id.

No step emits pairs. Reach is counted between (account, amount, day) classes by a window of fifteen
days. Rows and transactions that have only each other are settled by another. What is contested
falls into segments of an (account, amount) group that lie more than seven days apart. A segment is walked in
blocks of rows, whatever its size; what a block took is carried to the later ones as counts (see ``settle_in_blocks``).
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stmtflow.functions.identity import is_digest, packed_tail
from stmtflow.functions.ranking import number_in_blocks
from stmtflow.operators.keys import KEY
from stmtflow.session import cut_lineage

DAYS = 7
GROUP = ["account_id", "amount_cents"]
SEGMENT = [*GROUP, "segment"]
BLOCK = 50_000  # rows that one task walks


def match_exact(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows with the transaction that already carries their import id, if any.

    ``date_changed`` tells whether one of the two owned fields (date, cleared) differs.
    """
    # ids and import ids go to the join with their hex digits in half their size
    own, seen = is_digest("id"), [F.col("booking_date").alias("date"), "cleared"]
    known = existing.where("imported_id is not null and imported_id <> ''").select(
        F.col("account_id").alias("_account"),
        packed_tail("imported_id").alias("_imported"),
        F.when(own, F.struct(F.unhex("id").alias("id"), *seen)).alias("_digest"),
        F.when(~F.coalesce(own, F.lit(False)), F.struct("id", *seen)).alias("_other"),
    )
    # the smallest id: digests are in the order of their bytes, and what is left to compare are two texts
    first = known.groupBy("_account", "_imported").agg(F.min("_digest").alias("_digest"), F.min("_other").alias("_other"))
    digest, other = F.col("_digest"), F.col("_other")
    text = F.lower(F.hex(digest["id"]))
    takes_other = other.isNotNull() & (digest.isNull() | other["id"].isNull() | (other["id"] < text))

    def taken(name: str, of_digest: Column) -> Column:
        return F.when(takes_other, other[name]).otherwise(of_digest)

    date, cleared = (taken(n, digest[n]) for n in ("date", "cleared"))
    matched = taken("id", text)
    return (
        rows.withColumn("_own", packed_tail("imported_id"))
        .join(first, (F.col("account_id") == F.col("_account")) & (F.col("_own") == F.col("_imported")), "left")
        .withColumns({"matched_id": matched, "_date": date, "_cleared": cleared})
        .withColumn(
            "differs",
            F.col("matched_id").isNotNull()
            & ((F.col("_date") != F.col("booking_date")) | ~F.coalesce("_cleared", F.lit(False))),
        )
        .select("account_id", "imported_id", *[c for c in rows.columns if c not in ("account_id", "imported_id")], "matched_id", "differs")
    )


def adoptable(existing: DataFrame) -> DataFrame:
    return existing.where("coalesce(imported_id, '') = ''").select(
        *GROUP, F.col("booking_date").alias("day"), "payee", "id"
    )


def _classes(df: DataFrame, keys: list[str], day: str, *values: Column) -> DataFrame:
    """One row per key and day, with the day as a number: ``_at``."""
    return df.where(F.col(day).isNotNull()).groupBy(*keys, F.unix_date(day).alias("_at")).agg(*values)


def _around(keys: list[str], first: int, last: int) -> WindowSpec:
    """Classes of the same keys from ``first`` to ``last`` days off; a group has at most one of a kind per day."""
    return Window.partitionBy(*keys).orderBy("_at").rangeBetween(first, last)


def _reach(left: DataFrame, day: str, right: DataFrame, other: str, name: str) -> DataFrame:
    """``left`` with the number of ``right`` rows of its group within seven days."""
    asking = _classes(left, GROUP, day, F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_asks"))
    asked = _classes(right, GROUP, other, F.count(F.lit(1)).alias("_n"), F.lit(False).alias("_asks"))
    counts = (
        asking.unionByName(asked)
        .withColumn(name, F.sum("_n").over(_around(GROUP, -DAYS, DAYS)))
        .where(F.col("_asks") & (F.col(name) > 0))
        .select(*GROUP, F.date_from_unix_date("_at").alias(day), name)
    )
    return left.join(counts, [*GROUP, day], "left").fillna(0, [name])


def match_candidates(rows: DataFrame, free: DataFrame) -> DataFrame:
    """Rows with the number of transactions they could adopt and the one they like best.

    Of a group's days only the nearest before and after a row's can hold what it likes best, so no class is
    looked up once per day.
    """
    counted = _reach(rows, "booking_date", free, "day", "candidates")

    def best(keys: list[str], name: str) -> DataFrame:
        asking = _classes(rows, keys, "booking_date", F.min(F.lit(None).cast("string")).alias("id"), F.lit(True).alias("_asks"))
        offered = _classes(free, keys, "day", F.min("id").alias("id"), F.lit(False).alias("_asks"))
        seat = F.when(~F.col("_asks"), F.struct("_at", "id"))
        before, after = F.col("_before"), F.col("_after")
        nearest = (
            F.when(before.isNull(), after).when(after.isNull(), before)
            .when(F.col("_at") - before["_at"] <= after["_at"] - F.col("_at"), before).otherwise(after)
        )
        return (
            asking.unionByName(offered)
            .withColumn("_before", F.max(seat).over(_around(keys, -DAYS, 0)))
            .withColumn("_after", F.min(seat).over(_around(keys, 0, DAYS)))
            .where(F.col("_asks") & F.coalesce(before, after).isNotNull())
            .select(*keys, F.date_from_unix_date("_at").alias("booking_date"), nearest.alias(name))
        )

    same = best([*GROUP, "payee"], "_same")
    anyone = best(GROUP, "_any")
    chosen = F.coalesce("_same", "_any")
    return (
        counted.join(anyone, [*GROUP, "booking_date"], "left")
        .join(same, [*GROUP, "payee", "booking_date"], "left")
        .withColumn("best_id", chosen["id"])
        .withColumn("best_same_payee", F.col("_same").isNotNull())
        .drop("_same", "_any")
    )


def _only_pairs(rows: DataFrame, seats: DataFrame) -> DataFrame:
    """``source_id, source_key, id`` of rows and transactions that have only each other.

    Such a row is alone on its day, and so is such a transaction; one window finds one at the side of the other.
    """
    alone = F.count(F.lit(1)).alias("_n")
    null = F.lit(None).cast("string")
    asking = _classes(
        rows, GROUP, "booking_date", alone, F.min("source_id").alias("source_id"), F.min("source_key").alias("source_key"),
        F.min(null).alias("id"), F.lit(True).alias("_asks"),
    )
    offered = _classes(
        seats, GROUP, "day", alone, F.min(null).alias("source_id"), F.min(null).alias("source_key"), F.min("id").alias("id"),
        F.lit(False).alias("_asks"),
    )
    seat = F.max(F.when(~F.col("_asks"), F.struct("id"))).over(_around(GROUP, -DAYS, DAYS))
    return (
        asking.unionByName(offered).where("_n = 1").withColumn("_seat", seat)
        .where(F.col("_asks") & F.col("_seat").isNotNull())
        .select("source_id", "source_key", F.col("_seat.id").alias("id"))
    )


def _walker(reach: int, keys: list[str]):
    """The walk of one block of rows, which choose by their number. Days are day numbers.

    An inner function travels to the workers by value, so they need not have this package.
    """

    def walk(rows: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        by_day, by_payee, seats = defaultdict(list), defaultdict(list), {}
        last_first = free.sort_values("id", ascending=False)
        for day, payee, ident in last_first[["day", "payee", "id"]].itertuples(index=False):
            by_day[day].append(ident)
            by_payee[day, payee].append(ident)
            seats[ident] = day, payee
        offsets = sorted(range(-reach, reach + 1), key=lambda n: (abs(n), n))
        used = set()

        def first_free(stack):
            while stack and stack[-1] in used:
                stack.pop()
            return stack[-1] if stack else None

        taken = []
        ordered = rows.sort_values("n")
        for day, payee in ordered[["day", "payee"]].itertuples(index=False):
            choices = (
                first_free(stacks[key])
                for stacks, places in (
                    (by_payee, [(day + n, payee) for n in offsets]),
                    (by_day, [day + n for n in offsets]),
                )
                for key in places
                if key in stacks
            )
            ident = next((i for i in choices if i is not None), None)
            if ident is not None:
                used.add(ident)
            taken.append(ident)
        out = ordered[[*keys, "source_id", "source_key"]].assign(id=taken)
        out = out.loc[out["id"].notna()]
        places = [seats[i] for i in out["id"]]
        return out.assign(day=[d for d, _ in places], payee=[p for _, p in places]).astype(object)

    return walk


def _in_order(rows: DataFrame, block: int) -> DataFrame:
    """Rows numbered in an order that gives the same result as theirs, and cut into blocks of that many rows.

    Two rows can only want the same seat if they lie within 14 days of each other. A source that comes later in the order
    of choice is moved back by 15 days, so of two such rows the same one goes first, and each block needs the
    seats of few days although every source has rows on all of them.
    """
    sources = rows.select(*SEGMENT, "source_id").distinct()
    rank = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("source_id")) - 1
    moved = rows.join(sources.withColumn("_rank", rank), [*SEGMENT, "source_id"]).select(
        *SEGMENT, F.unix_date("booking_date").alias("day"), F.coalesce("payee", F.lit("\0")).alias("payee"), "source_id", "source_key",
        F.struct((F.unix_date("booking_date") + (2 * DAYS + 1) * F.col("_rank")).alias("time"), F.left("source_key", F.lit(2)).alias("part")).alias("row_block"),
    )
    numbered = number_in_blocks(moved, SEGMENT, "row_block", ["source_id", "source_key"], "n")
    return numbered.withColumn("block", F.floor(F.col("n") / block)).drop("row_block")


def settle_in_blocks(rows: DataFrame, free: DataFrame, block: int = BLOCK) -> DataFrame:
    """Contested segments of any size, a block of rows to a task.

    Seats of one class (day and payee) are taken in the order of their ids, so what a block leaves to later ones is one
    number per class: how many it took. What was taken before a block is the sum over the blocks before it. All blocks
    run at once with what is known of that; those for which it turns out otherwise run again. The first block of a segment
    is right at once, and each round makes at least one more of each segment right, so there are at most as many rounds as the
    longest segment has blocks, and one for nearly all data. A task holds ``block`` rows and as many seats
    of each class that they can reach.
    """
    at = [*SEGMENT, "block"]
    seat_class = [*SEGMENT, "day", "payee"]
    rows = cut_lineage(_in_order(rows, block))
    seats = free.select(*SEGMENT, F.unix_date("day").alias("day"), F.coalesce("payee", F.lit("\1")).alias("payee"), "id", F.left("id", F.lit(2)).alias("_part"))
    seats = number_in_blocks(seats, seat_class, "_part", ["id"], "seat").drop("_part")
    seats = cut_lineage(seats.withColumn("lot", F.floor(F.col("seat") / block)))
    days = rows.select(*at, "day").distinct()
    days = days.withColumn("day", F.explode(F.transform(F.sequence(F.lit(-DAYS), F.lit(DAYS)), lambda n: F.col("day") + n))).distinct()
    reach = cut_lineage(days.join(seats.groupBy(*seat_class).agg(F.count(F.lit(1)).alias("held")), [*SEGMENT, "day"]))
    known = reach.withColumn("before", F.lit(0).cast("bigint"))
    last = rows.agg(F.max("block")).first()[0]
    walk = _walker(DAYS, at)
    schema = "account_id string, amount_cents bigint, segment bigint, block bigint, source_id string, source_key string, id string, day int, payee string"
    result, run_again = None, None
    while True:
        active = known if run_again is None else known.join(run_again, at, "left_semi")
        # the next ``block`` seats of a class lie in two lots at most
        lots = F.array(F.floor(F.col("before") / block), F.floor(F.col("before") / block) + 1)
        wanted = active.where("before < held").select(*at, "day", "payee", "before", F.explode(lots).alias("lot"))
        loaded = wanted.join(seats, [*seat_class, "lot"]).where(F.col("seat").between(F.col("before"), F.col("before") + block - 1))
        asking = rows if run_again is None else rows.join(run_again, at, "left_semi")
        found = asking.groupBy(*at).cogroup(loaded.select(*at, "day", "payee", "id").groupBy(*at)).applyInPandas(walk, schema)
        if run_again is not None:
            found = result.join(run_again, at, "left_anti").unionByName(found)
        result = cut_lineage(found)
        if not last:
            break
        taken = result.groupBy(*at, "day", "payee").agg(F.count(F.lit(1)).alias("_taken"))
        earlier = Window.partitionBy(*seat_class).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        now = known.join(taken, [*at, "day", "payee"], "left").withColumn(
            "now", F.least("held", F.coalesce(F.sum(F.coalesce("_taken", F.lit(0))).over(earlier), F.lit(0)))
        )
        now = cut_lineage(now.select(*known.columns, "now"))
        run_again = cut_lineage(now.where("now <> before").select(*at).distinct())
        if run_again.isEmpty():
            break
        known = now.drop("before").withColumnRenamed("now", "before")
    return result.select("source_id", "source_key", "id")


def _segments(rows: DataFrame, seats: DataFrame) -> DataFrame:
    """Segment number of every day of a group on which a row or a transaction lies."""
    days = (
        rows.select(*GROUP, F.col("booking_date").alias("day"))
        .unionByName(seats.select(*GROUP, "day"))
        .distinct()
    )
    in_order = Window.partitionBy(*GROUP).orderBy("day")
    apart = F.date_diff("day", F.lag("day").over(in_order)) > DAYS
    return days.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int")).select(
        *GROUP, "day", F.sum("_apart").over(in_order).alias("segment")
    )


def match_assign(rows: DataFrame, free: DataFrame, block: int = BLOCK) -> DataFrame:
    """``source_id, source_key, id`` for every row that adopts a transaction."""
    rows = rows.select(*KEY, *GROUP, "booking_date", "payee")
    wanted = _reach(rows, "booking_date", free, "day", "seats").where("seats > 0")
    offered = _reach(free, "day", rows, "booking_date", "askers").where("askers > 0")
    wanted, offered = cut_lineage(wanted), cut_lineage(offered)
    settled = cut_lineage(_only_pairs(wanted.where("seats = 1"), offered.where("askers = 1")))
    rest = wanted.join(settled, KEY, "left_anti")
    seats = offered.join(settled, "id", "left_anti")
    segments = cut_lineage(_segments(rest, seats))
    rest = rest.join(segments.withColumnRenamed("day", "booking_date"), [*GROUP, "booking_date"])
    seats = seats.join(segments, [*GROUP, "day"])
    return settled.unionByName(settle_in_blocks(rest, seats, block))
