"""The configured sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ranking import first_in_group


def registry(configured: DataFrame) -> DataFrame:
    """First entry per id wins. ``configured`` carries the list position in ``position``."""
    return first_in_group(configured, ["id"], ["position"]).drop("position")


def lookup(requested: DataFrame, sources: DataFrame) -> DataFrame:
    """Requested ``source_id`` values with their configuration; unknown ones carry an error."""
    found = requested.join(sources, requested["source_id"] == sources["id"], "left")
    return found.withColumn(
        "error",
        F.when(F.col("id").isNull(), F.concat(F.lit("unknown source "), "source_id")),
    ).drop("id")
