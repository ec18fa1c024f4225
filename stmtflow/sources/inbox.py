"""The inbox: which files belong to which source, and their lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.sources import storage

PROCESSED = "processed"  # files below a folder of this name have been consumed
LINE_SCHEMA = "value string"


def _relative(path: Column, inbox: str) -> Column:
    """Path below the inbox folder, whatever scheme the folder is given with."""
    folder = inbox.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    return F.substring_index(path, folder + "/", -1)


def _not_processed(rel: Column) -> Column:
    return ~F.array_contains(F.split(rel, "/"), PROCESSED)


def inbox_files(spark: SparkSession, inbox: str) -> DataFrame:
    """Regular files below the inbox that were not set aside: ``doc, modified_at``.

    Only names and times are read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inbox)
        .select(_relative(F.col("path"), inbox).alias("doc"), F.col("modificationTime").alias("modified_at"))
    )
    return files.where(_not_processed(F.col("doc")))


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression: ``**/`` any folders, ``*`` and ``?`` inside one name."""
    escaped = F.regexp_replace(glob, r"([.+()|^$\\{}])", r"\\$1")
    folders = F.regexp_replace(escaped, r"\*\*/", "\u0001")
    names = F.regexp_replace(F.regexp_replace(folders, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(F.replace(names, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("[!"), F.lit("[^")), F.lit("$"))


def source_files(files: DataFrame, formats: DataFrame) -> DataFrame:
    """Files with the source whose pattern they match: ``source_id, doc, modified_at``.

    Joined on the fixed leading folder of the pattern, so files and sources are never crossed.
    """
    fixed = F.regexp_extract("inbox_glob", r"^((?:[^*?\[/]*/)*)", 1)
    wanted = formats.where("inbox_glob is not null").select(
        "source_id", fixed.alias("folder"), glob_pattern(F.col("inbox_glob")).alias("pattern")
    )
    parts = F.split("doc", "/")
    folders = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))),
    )
    return (
        files.withColumn("folder", F.explode(folders))
        .join(wanted, "folder")
        .where(F.regexp_like("doc", F.col("pattern")))
        .select("source_id", "doc", "modified_at")
    )


def unprocessed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files of a source that no import has consumed in this version (path and time)."""
    done = processed.select("source_id", "doc", "modified_at")
    return files.join(done, ["source_id", "doc", "modified_at"], "left_anti")


def finished(listed: DataFrame, processed: DataFrame) -> DataFrame:
    """``doc, modified_at`` of the listed files that every source which reads them has consumed in this version."""
    left = unprocessed(listed, processed).select("doc")
    return listed.select("doc", "modified_at").distinct().join(left, "doc", "left_anti")


def set_aside(spark: SparkSession, inbox: str, archive: str, files: DataFrame) -> int:
    """Moves files from the inbox to the same place below ``archive``; a name that is taken gets the file's time.

    One after another, as the names arrive from the executors; a call that was cut short goes on with what is left.
    """
    moved = 0
    named = files.select("doc", F.unix_micros("modified_at").alias("time"))
    for r in named.toLocalIterator():
        folder, _, name = r.doc.rpartition("/")
        stem, dot, suffix = name.rpartition(".")
        timed = f"{stem}.{r.time}.{suffix}" if dot and stem else f"{name}.{r.time}"
        target = f"{archive.rstrip('/')}/{folder}/" if folder else f"{archive.rstrip('/')}/"
        moved += storage.move(spark, f"{inbox.rstrip('/')}/{r.doc}", target + name, target + timed)
    return moved


def raw_lines(frame: DataFrame, inbox: str) -> DataFrame:
    """Lines of a text read, batch or stream, with their file, split and place in the split."""
    return frame.select(
        _relative(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), inbox).alias("doc"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("raw"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    ).where(_not_processed(F.col("doc")))


def read_lines(spark: SparkSession, inbox: str, docs: list[str] | None = None) -> DataFrame:
    """Lines of the given files, or of all below the inbox. Large files are split; bytes are kept as they are.

    Only files that are named are opened, so what has been consumed costs nothing. The names come from a listing, which
    the driver holds for a scan anyway.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if docs is None:
        return raw_lines(reader.text(inbox), inbox)
    if not docs:
        return spark.createDataFrame([], "doc string, block bigint, line_no bigint, raw string, modified_at timestamp")
    # a path is a pattern to the reader: special characters of a name stand for themselves
    paths = [f"{inbox.rstrip('/')}/" + re.sub(r"([*?\[\]{}\\])", r"\\\1", doc) for doc in docs]
    return raw_lines(reader.text(paths), inbox)


def lines_of(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of the given files, once per source that reads the file."""
    return lines.drop("modified_at").join(files, "doc")
