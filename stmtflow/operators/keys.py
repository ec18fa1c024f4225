"""Content keys per document and the merge of overlapping documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.functions.identity import canonical_text, fingerprint, imported_id, source_key
from stmtflow.functions.ranking import first_in_group, number_in_blocks
from stmtflow.schemas import TXN_CONTENT
from stmtflow.session import cut_lineage


KEY = ["source_key", "source_id"]
# Equal texts of a source have these in common, and the rows bring them along.
PLACE = ["source_id", "booking_date", "amount_cents"]
# the digest first: it tells rows apart in the first bytes a sort compares
TEXT = ["canon", *PLACE]
GROUP = [*TEXT, "doc"]
BUCKETS = 1 << 16
CROWD = 100_000  # rows of a bucket beyond which its groups are numbered block by block
TASK_ROWS = 250_000  # rows that a task numbers on average, however many there are


def spanning_documents(rows: DataFrame, block: str = "block") -> DataFrame:
    """Documents that lie in more than one block."""
    blocks = rows.groupBy("source_id", "doc").agg(F.min(block).alias("_a"), F.max(block).alias("_b"))
    return blocks.where("_a < _b").select("source_id", "doc")


def _bucket() -> Column:
    """Rows of one source and canonical text share a bucket; it takes no text to tell."""
    return F.pmod(F.xxhash64(*PLACE), F.lit(BUCKETS))


def _crowds(rows: DataFrame, crowd: int) -> tuple[DataFrame, int]:
    """Buckets that may hold a group too large for one task, and those with rows without a document or block; how many rows there are."""
    unplaced = F.col("source_id").isNull() | F.col("doc").isNull() | F.col("block").isNull()
    sizes = cut_lineage(rows.groupBy(_bucket().alias("_bucket")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(unplaced).alias("_unplaced")
    ))  # at most BUCKETS rows
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    return sizes.where((F.col("_rows") > crowd) | (F.col("_unplaced") > 0)).select("_bucket"), total


def _spread(rows: DataFrame, total: int, task_rows: int, *keys: str) -> DataFrame:
    """An explicit exchange; the session's number of partitions would give a task ever more rows to sort."""
    tasks = math.ceil(total / task_rows)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys) if tasks > 1 else rows.repartition(*keys)


def _with_canon(rows: DataFrame) -> DataFrame:
    return rows.withColumn("canon", F.unhex(source_key(canonical_text(), F.lit(0))))


def _numbered(rows: DataFrame, total: int, task_rows: int) -> DataFrame:
    """All copies of a text in a source meet in one task, which numbers those of each document.

    They meet by what equal texts have in common, so the digests are made where the rows have come to and do not travel.
    """
    place = Window.partitionBy(*GROUP).orderBy("block", "row_no")
    # without the document: the merge of documents needs no other exchange
    spread = _with_canon(_spread(rows, total, task_rows, *PLACE))
    return spread.withColumn("ordinal", (F.row_number().over(place) - 1).cast("bigint"))


def _numbered_in_blocks(rows: DataFrame, long_documents: DataFrame, total: int, task_rows: int) -> DataFrame:
    """The same for groups of any size (see ``number_in_blocks``)."""
    # Only these documents can have a group that spans blocks.
    spanning = rows.join(long_documents, ["source_id", "doc"], "left_semi").select(*GROUP, "block")
    # on the full key: a partitioning by document alone could be skewed
    spread = _spread(rows, total, task_rows, *GROUP, "block")
    return number_in_blocks(spread, GROUP, "block", ["row_no"], "ordinal", spanning)


def _number(
    rows: DataFrame, long_documents: DataFrame | None, crowd: int, task_rows: int
) -> tuple[DataFrame, DataFrame | None]:
    """The rows with ``canon`` and ``ordinal``: those of small groups, and those of crowded buckets if there are any.

    ``canon`` is the key of the first row of a text, so only its copies need another digest.
    """
    crowds, total = _crowds(rows, crowd)
    if crowds.isEmpty():
        return _numbered(rows, total, task_rows), None
    if long_documents is None:
        long_documents = spanning_documents(rows)
    placed, crowds = rows.withColumn("_bucket", _bucket()), F.broadcast(crowds)
    few = placed.join(crowds, "_bucket", "left_anti").drop("_bucket")
    many = placed.join(crowds, "_bucket", "left_semi").drop("_bucket")
    return (
        _numbered(few, total, task_rows),
        _numbered_in_blocks(_with_canon(many), long_documents, total, task_rows),
    )


def _identified(numbered: DataFrame) -> DataFrame:
    copy = source_key(canonical_text(), "ordinal")
    return (
        numbered.withColumn("source_key", F.when(F.col("ordinal") == 0, F.lower(F.hex("canon"))).otherwise(copy))
        .withColumn("imported_id", imported_id("source_id", "source_key"))
        .withColumn("raw_fingerprint", fingerprint())
        .withColumn("currency", F.upper("currency"))
        .select(
            "source_id", "account_ref", "doc", "ordinal", "source_key", "imported_id",
            "raw_fingerprint", *TXN_CONTENT,
        )
    )


def assign_keys(
    rows: DataFrame, long_documents: DataFrame | None = None, crowd: int = CROWD, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Key every booked row of every document.

    Rows of one document that say the same are told apart by their position among themselves.
    Where more than ``crowd`` rows may say the same, the numbering is done per block of a document, so
    the copies of one row in a document are spread over tasks however many they are. ``long_documents`` may
    name the documents of several blocks if they are known already.
    """
    few, many = _number(rows, long_documents, crowd, task_rows)
    return _identified(few if many is None else few.unionByName(many))


def keyed_once(
    rows: DataFrame, long_documents: DataFrame | None = None, crowd: int = CROWD, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``merge_documents`` of ``assign_keys``; rows are merged where they were numbered, and what is left gets its key."""
    few, many = _number(rows, long_documents, crowd, task_rows)
    merged = merge_documents(few, in_place=True)
    return _identified(merged if many is None else merged.unionByName(merge_documents(many, ["canon", "source_id", "ordinal"])))


def merge_documents(keyed: DataFrame, key: list[str] = KEY, in_place: bool = False) -> DataFrame:
    """One row per key; the first document that has it wins.

    Spark keeps one row per key and task before the shuffle, so copies in many documents
    do not travel. Rows numbered ``in_place`` are sorted by text and document already: those of a document
    stay whose number no earlier document has reached.
    """
    if not in_place:
        return first_in_group(keyed, key, ["doc"])
    earlier = Window.partitionBy(*TEXT).orderBy("doc", "block", "row_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    reached = keyed.withColumn("_reached", F.max("ordinal").over(earlier))
    return reached.where("_reached is null or ordinal > _reached").drop("_reached")
