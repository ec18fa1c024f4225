"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a single-machine session may fall back on a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="stmtflow-", dir="/tmp")
    return _LOCAL[app]


class _Open(threading.local):
    """The blocks of :func:`scratch` that a thread is in, with the tables each has cut; jobs in other threads have theirs."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_OPEN = _Open()


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """The same rows as a table written to the shared folder.

    It survives the loss of any executor, and its size is known to the planner afterwards. (A
    checkpointed frame keeps the size estimate of the plan behind it, which grows with every join
    of a loop.) Inside :func:`scratch` the table goes when the block ends; with ``keep``
    it is the block's result and goes with the block around it, if there is one.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if len(_OPEN.blocks) > keep:
        _OPEN.blocks[-1 - keep].append(path)
    with _shuffles_go(df.sparkSession):
        # mostly digests in hex, which only an entropy coder makes smaller
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict[str, tuple[int, str | None]] = {}  # blocks of a session that are open, and its setting before them
_LOCK = threading.Lock()


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """A command that begins in the block deletes its shuffle files when it ends; nothing reads them again, and they would
    stay until the driver collects garbage. Threads that share a session may be in the block together.
    """
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        depth, before = _CLEANING.get(session, (0, None))
        if not depth:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _CLEANING[session] = depth + 1, before
    try:
        yield
    finally:
        with _LOCK:
            depth, before = _CLEANING.pop(session)
            if depth > 1:
                _CLEANING[session] = depth - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that the block cuts, when it ends or fails.

    For jobs whose results are written or collected inside the block; a frame that is read later must not depend on
    them.
    """
    _OPEN.blocks.append([])
    try:
        yield
    finally:
        for path in _OPEN.blocks.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
