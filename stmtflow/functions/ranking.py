"""Numbering inside groups of any size.

``row_number`` over a group puts the whole group into one task. These helpers number inside
blocks of bounded size first and add the size of the earlier blocks, which is a small aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str | Column],
    name: str,
    spanning: DataFrame | None = None,
) -> DataFrame:
    """Position (from 0) inside each ``keys`` group in (``block``, ``order``) order.

    ``spanning`` may hold the rows (``keys`` and ``block``) of which a group can lie in more than
    one block; only those are counted, so the usual small group pays for one shuffle only.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    counted = df if spanning is None else spanning
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.sum("_size").over(earlier))
        .where("_before > 0")
        .drop("_size")
    )
    return (
        df.withColumn(name, F.row_number().over(inside) - 1)
        .join(offsets, [*keys, block], "left")
        .withColumn(name, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_before")
    )


def first_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1
) -> DataFrame:
    """First ``n`` rows of each group. Spark limits each group before the shuffle already."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(spec)).where(F.col("_rank") <= n).drop("_rank")
