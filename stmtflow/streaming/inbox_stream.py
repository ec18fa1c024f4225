"""The inbox as a stream: every micro-batch runs the batch import on the files that arrived."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stmtflow.plans.importer import ImportJob
from stmtflow.sources import inbox as box


def start(
    job: ImportJob, checkpoint: str, clock: Callable[[int], datetime], files_per_batch: int = 10_000
) -> StreamingQuery:
    """Imports what is in the inbox and stops.

    Files of a source that could not be imported wait in the store, and every later micro-batch tries them again.

    The run id follows from the checkpoint and the batch id, so a batch that is delivered again starts from the same
    state and writes the same snapshots. Files may be archived by the source, but neither the
    checkpoint nor the ledger depends on it.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
    source = (
        job.spark.readStream.schema(box.LINE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("lineSep", "\n")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .text(job.inbox)
    )

    def import_batch(lines: DataFrame, batch_id: int) -> None:
        placed = box.raw_lines(lines, job.inbox)
        arrived = placed.groupBy("doc").agg(F.max("modified_at").alias("modified_at"))
        files = box.source_files(arrived, job.formats())
        job.run_arrived(placed, files, f"stream-{stream}-{batch_id}", clock(batch_id))

    # the metadata column only exists directly above the scan, which foreachBatch hands over
    return (
        source.select("value", "_metadata")
        .writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distinct_events(events: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """First delivery of each content key, over all micro-batches.

    With ``watermark`` (column, delay) the state is bounded: a copy is only recognised if it
    arrives within the delay.
    """
    if watermark is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
