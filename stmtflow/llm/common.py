"""What the operators share: tables, the identity of stored rows, columns whose names cannot clash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.session import cut_lineage

#: Words everywhere in this package: runs of anything but space and the controls 9 to 13 (fixed value).
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def fenced(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame, dict[str, str]], DataFrame]]:
    """``df`` with columns ``_c0, _c1 ...`` and a way back that adds computed columns.

    An operator's own columns can then have any name. The way back gives the input columns their names again;
    a computed column replaces an input column of the same name.
    """
    names = df.columns
    inner = df.toDF(*[f"_c{i}" for i in range(len(names))])

    def back(done: DataFrame, computed: dict[str, str]) -> DataFrame:
        kept = [F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n not in computed]
        return done.select(*kept, *[F.col(source).alias(name) for name, source in computed.items()])

    return inner, back


def column_of(df: DataFrame, name: str) -> str:
    """The fenced name of column ``name``."""
    return f"_c{df.columns.index(name)}"


def _from_files(df: DataFrame, name: str, value: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with a value made of the path of each row's file and the row's number in it.

    A frame that is not a plain read of files is written to the shared folder first: a place that is computed twice in two
    orders would lose rows when an executor is lost.
    """

    def placed(frame: DataFrame) -> DataFrame:
        place = frame.metadataColumn("_metadata")
        return frame.withColumn(name, value(place["file_path"], place["row_index"]))

    try:
        return placed(df)
    except AnalysisException:
        return placed(cut_lineage(df))


def with_row_identity(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a long that stays the same however often a row is read again.

    It is a hash of the row's place in the files, so equal rows differ too and a hot key spreads. Two rows may share a
    value; it spreads rows and breaks ties between equal rows, nothing else.
    """
    return _from_files(df, name, F.xxhash64)


def with_place(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a string that no two rows share: 128 bits for the path of the file (names alone repeat from folder to
    folder of a partitioned table) and the row's number in it."""
    return _from_files(df, name, lambda path, row: F.concat(F.md5(path.cast("binary")), row.cast("string")))


def in_file_order(df: DataFrame) -> DataFrame:
    """The rows in the order of the files they were written to, over partitions and inside them.

    Spark reads the largest files first and several of them in one task. Names of its writers hold two numbers, of the task and
    of the task's file. A frame that is not a plain read of files is written first.
    """

    def placed(frame: DataFrame) -> DataFrame:
        place = frame.metadataColumn("_metadata")
        file = place["file_name"]
        numbers = [F.regexp_extract(file, found, 1).try_cast("bigint") for found in (r"^part-(\d+)", r"-c(\d+)\.")]
        order = {"_part": numbers[0], "_nth": numbers[1], "_file": file, "_row": place["row_index"]}
        return frame.withColumns(order).repartitionByRange(*order).sortWithinPartitions(*order)

    inner, back = fenced(df)
    try:
        return back(placed(inner), {})
    except AnalysisException:
        return back(placed(cut_lineage(inner)), {})
