"""Mixing sources to target weights by Pfair scheduling [native].

A source is a stream of blocks of ``block_bytes``. Shares are whole numbers; a round is one block slot for every
unit of share. In a round of T slots the j-th of a stream's b blocks is released at floor(j*T/b) and due at
ceil((j+1)*T/b) (its Pfair window), and in each slot the released block with the earliest deadline goes next. As
the windows of a stream follow each other, the blocks it has had after any slot differ from its weight b/T times
the slots by less than one block. No rows are dropped or repeated: a stream that runs out takes part in its last
round with what it has left, and the others go on in the proportion of their shares.

Rounds with the same blocks have the same order, so it is worked out once for each kind of round, of which there
are at most two per stream and one. Everything about rows is arithmetic on a running sum of bytes inside the
stream; sums are formed in chunks of hashed rows, so a stream with most of the rows has many tasks.

Defined results: rows without a source are a stream of their own; null text has one byte; equal rows are separate
rows; an empty table gives no rows. Sources whose share of ``period`` would round to nothing, or that a recipe
does not name, form one stream together, so there are never more than 2 * period + 1 streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stmtflow.llm.common import column_of, fenced, let, with_row_identity
from stmtflow.session import cut_lineage

BLOCK_BYTES = 64 << 10
PERIOD = 200
TEMPERATURE = 0.5
#: The stream of all sources that have none of their own.
REST = "*"


def _streams(rows: DataFrame, recipe: dict[str, int] | None, period: int, temperature: float) -> list[dict]:
    """Key, bytes and share of each stream, by key; at most 2 * period + 1, so they may be collected."""
    by_source = cut_lineage(rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n")))
    if recipe is None:
        power = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
        whole = by_source.agg(F.sum(power)).first()[0] or 1.0
        part = F.lit(float(period)) * power / F.lit(whole)
        own = F.round(part) >= 1
    else:
        shares = {f"={k}": v for k, v in recipe.items() if k != REST}
        part = F.lit(float(recipe.get(REST, 1)))
        for key, share in shares.items():
            part = F.when(F.col("_source") == key, F.lit(float(share))).otherwise(part)
        own = F.col("_source").isin(list(shares))
    named = by_source.withColumns({"part": part, "key": F.when(own, F.col("_source")).otherwise(F.lit(REST))})
    # the shares of pooled sources add up, unless a recipe names the pool's share
    pooled = F.sum("part") if recipe is None else F.max("part")
    share = F.greatest(F.lit(1), F.round(pooled)).cast("bigint")
    found = named.groupBy("key").agg(F.sum("size").alias("size"), share.alias("share")).orderBy("key")
    return [r.asDict() for r in found.collect()]


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _left(blocks: Column, shares: Column, at: Column) -> Column:
    """Blocks of each stream in round ``at``."""
    return F.zip_with(blocks, shares, lambda n, a: F.greatest(F.lit(0).cast("bigint"), F.least(a, n - at * a)))


def _earliest_deadline_first(b: Column) -> Column:
    """The stream of every slot of a round with ``b`` blocks per stream: array of stream numbers."""

    def of_total(total: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            def window(blocks: Column, i: Column) -> Column:
                had = F.get(acc["had"], i)
                released = (had < blocks) & (F.floor(had * total / blocks) <= t)
                return F.when(released, F.struct(F.ceil((had + 1) * total / blocks).alias("due"), i.alias("i")))

            return let(
                F.array_min(F.transform(b, window))["i"],
                lambda best: F.struct(
                    F.transform(acc["had"], lambda v, i: v + F.when(i == best, 1).otherwise(0)).alias("had"),
                    F.concat(acc["order"], F.array(best)).alias("order"),
                ),
            )

        zero = F.struct(
            F.transform(b, lambda _: F.lit(0).cast("bigint")).alias("had"), F.array().cast("array<int>").alias("order")
        )
        slots = F.sequence(F.lit(0).cast("bigint"), total - 1)
        return F.aggregate(slots, zero, step, lambda acc: acc["order"])

    return let(F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x), of_total)


def _schedule(spark: SparkSession, blocks: list[int], shares: list[int]) -> DataFrame:
    """Slot, release and deadline inside its round of block j of each stream, per kind of round.

    ``kind`` is the first round of a run of equal rounds. At most (2 * streams + 1) * (sum of shares) rows.
    """
    n, a = _array(blocks), _array(shares)
    ends = F.zip_with(n, a, lambda x, y: F.floor(x / y))
    starts = F.array_distinct(F.concat(_array([0]), ends, F.transform(ends, lambda e: e + 1)))
    kinds = spark.range(1).select(F.explode(starts).alias("kind")).withColumn("b", _left(n, a, F.col("kind")))
    kinds = kinds.withColumn("total", F.aggregate("b", F.lit(0).cast("bigint"), lambda x, y: x + y)).where("total > 0")
    turns = kinds.select("kind", "b", "total", F.posexplode(_earliest_deadline_first(F.col("b"))).alias("turn", "stream"))
    nth = F.row_number().over(Window.partitionBy("kind", "stream").orderBy("turn")) - 1
    own = F.get("b", F.col("stream"))
    return (
        turns.withColumn("j", nth.cast("bigint"))
        .withColumns({"release": F.floor(F.col("j") * F.col("total") / own), "due": F.ceil((F.col("j") + 1) * F.col("total") / own)})
        .select("kind", "stream", "j", "turn", "release", "due")
    )


def mix(
    df: DataFrame, recipe: dict[str, int] | None = None, *, source: str = "source", text: str = "text",
    period: int = PERIOD, temperature: float = TEMPERATURE, block_bytes: int = BLOCK_BYTES, ordered: bool = False,
) -> DataFrame:
    """All rows and columns of ``df`` with stream, block, release, deadline, slot and offset.

    ``recipe`` maps sources to shares ("*": all others, share 1 by default). Without one, a source's share follows
    the number of its rows to the power ``temperature``, in units of 1 / ``period``. Release, deadline and slot
    count block slots of the whole mix; ``offset`` is where the row begins in its block. (slot, offset) is the
    order of the mix; ``ordered`` sorts the rows by it, so files written hold consecutive stretches.
    """
    spark = df.sparkSession
    inner, back = fenced(df)
    name = F.col(column_of(df, source)).cast("string")
    rows = with_row_identity(inner, "_place").withColumns(
        {
            "_source": F.coalesce(F.concat(F.lit("="), name), F.lit("!")),
            "_size": F.coalesce(F.octet_length(F.col(column_of(df, text))), F.lit(0)).cast("bigint") + 1,
        }
    )
    streams = _streams(rows, recipe, period, temperature)
    keys = [s["key"] for s in streams] or [REST]
    blocks = [-(-s["size"] // block_bytes) for s in streams] or [1]
    shares = [s["share"] for s in streams] or [1]
    size = sum(s["size"] for s in streams)

    known = F.when(F.col("_source").isin(keys), F.col("_source")).otherwise(F.lit(REST))
    number = F.array_position(F.array(*[F.lit(k) for k in keys]), known).cast("int") - 1
    chunks = max(1, size // (block_bytes * 16))
    rows = rows.withColumns({"_stream": number, "_chunk": F.pmod(F.xxhash64(F.lit(1), "_place"), F.lit(chunks))})

    # where a row begins in its stream: inside its chunk, plus the chunks before
    earlier = (Window.unboundedPreceding, -1)
    sums = rows.groupBy("_stream", "_chunk").agg(F.sum("_size").alias("_bytes")).select(
        "_stream", "_chunk",
        F.coalesce(F.sum("_bytes").over(Window.partitionBy("_stream").orderBy("_chunk").rowsBetween(*earlier)), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("_stream", "_chunk").orderBy("_place", *inner.columns).rowsBetween(*earlier)
    share = F.get(_array(shares), F.col("_stream"))
    placed = (
        rows.withColumn("_at", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .join(sums, ["_stream", "_chunk"])
        .withColumn("_at", F.col("_at") + F.col("_before"))
        .withColumns({"_block": F.floor(F.col("_at") / block_bytes), "_offset": F.col("_at") % block_bytes})
        .withColumns({"_round": F.floor(F.col("_block") / share), "j": F.col("_block") % share})
    )

    # at most (2 * streams + 1) * (period + streams) rows by the bound on streams: safe to broadcast
    schedule = cut_lineage(_schedule(spark, blocks, shares)).withColumnRenamed("stream", "_stream")
    starts = sorted({0} | {n // a + i for n, a in zip(blocks, shares, strict=True) for i in (0, 1)})
    kind = F.array_max(F.filter(_array(starts), lambda k: k <= F.col("_round")))
    begin = F.aggregate(
        F.zip_with(_array(blocks), _array(shares), lambda n, a: F.struct(n.alias("n"), a.alias("a"))),
        F.lit(0).cast("bigint"), lambda acc, s: acc + F.least(s["n"], F.col("_round") * s["a"]),
    )
    mixed = (
        placed.withColumns({"kind": kind, "_begin": begin})
        .join(F.broadcast(schedule), ["kind", "_stream", "j"])
        .withColumns({c: F.col("_begin") + F.col(x) for c, x in (("_slot", "turn"), ("_release", "release"), ("_due", "due"))})
        .withColumn("_name", F.get(F.array(*[F.lit(k.removeprefix("=")) for k in keys]), F.col("_stream")))
    )
    if ordered:
        mixed = mixed.orderBy("_slot", "_offset", "_place")
    return back(
        mixed,
        {"stream": "_name", "block": "_block", "release": "_release", "deadline": "_due", "slot": "_slot", "offset": "_offset"},
    )
