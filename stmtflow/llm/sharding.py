"""Two-pass external shuffle into shards [native].

Pass one scatters the records uniformly over buckets that fit in memory, by a seeded hash of each record's place.
Pass two permutes each bucket by Fisher-Yates (what ``shuffle`` of an array does). The buckets in order are one
uniform permutation of all records; record number g of it goes to shard g mod n, slot g div n. So the law is
``rows``: shard counts are at most one apart, whatever keys or sizes the records have, and slots have no gaps.

Defined results: null text is a record like any other; equal rows are records of their own and spread like
others; a record larger than a bucket makes its bucket larger by that record; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.llm.common import fenced, with_row_identity

BUCKET_BYTES = 8 << 20
#: Buckets whose sizes are summed by one task.
SUMMED = 4096


def shuffle_shards(
    df: DataFrame, shards: int = 8, seed: int = 20, bucket_bytes: int = BUCKET_BYTES, size: str | None = None
) -> DataFrame:
    """All rows and columns of ``df`` with ``law`` (string), ``shard`` (int) and ``slot`` (long).

    ``size`` is an expression for a record's bytes; by default the length of its text columns.
    """
    inner, back = fenced(df)
    texts = [f"_c{i}" for i, (_, kind) in enumerate(df.dtypes) if kind == "string"]
    weight = F.lit(64)
    for c in texts:
        weight = weight + F.coalesce(F.octet_length(c), F.lit(0))
    total = (df.agg(F.sum(F.expr(size))) if size else inner.agg(F.sum(weight))).first()[0] or 0
    n = max(1, -(-int(total) // bucket_bytes))

    rows = with_row_identity(inner, "_place").withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(n)))
    # pass one; records in a fixed order, so that a task that runs again permutes the same way
    record = F.struct("_place", *inner.columns)
    buckets = rows.groupBy("_bucket").agg(F.sort_array(F.collect_list(record)).alias("_records"))
    # where each bucket begins: sums inside runs of buckets, then over the runs
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_run", F.floor(F.col("_bucket") / SUMMED))
    runs = counts.groupBy("_run").agg(F.sum("_n").alias("_n")).select(
        "_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_run_at")
    )
    inside = Window.partitionBy("_run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(runs, "_run").select(
        "_bucket", (F.col("_at") + F.col("_run_at")).alias("_at")
    )
    # pass two
    permuted = (
        buckets.join(begins, "_bucket").sortWithinPartitions("_bucket")
        .select("_at", F.posexplode(F.shuffle("_records", seed)).alias("_i", "_r"))
        .select((F.col("_at") + F.col("_i")).alias("_g"), "_r.*")
        .withColumns(
            {"_law": F.lit("rows"), "_shard": (F.col("_g") % shards).cast("int"), "_slot": F.floor(F.col("_g") / shards)}
        )
    )
    return back(permuted, {"law": "_law", "shard": "_shard", "slot": "_slot"})


def write_shards(df: DataFrame, path: str, shards: int = 8, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes one folder per shard (``shard=0`` ...); files hold stretches of consecutive slots."""
    shuffled = shuffle_shards(df, shards, seed, bucket_bytes)
    # every bucket holds consecutive records of all shards, so writers only split by shard; no third shuffle
    shuffled.write.mode("errorifexists").partitionBy("shard").parquet(path)
