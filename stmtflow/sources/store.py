"""State tables as Parquet snapshots with a chain of commits.

A run writes new snapshots next to the old ones, each attempt to a folder of its own, and then creates the next file
of the commit chain, which makes all of them current at once. Nothing that is current is ever overwritten: a run
that dies, also one that is a repeat, leaves the state as it was. Of two runs that started from the same
state the second to commit is refused, as its result lacks what the first has written. A run that is repeated
starts from the state it started from, as long as no other run has committed since.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from stmtflow.schemas import TABLES
from stmtflow.sources import storage

PARTITIONED = {"import_ledger": "source_id"}
NOTHING = {"seq": 0, "run_id": None, "tables": {}}


class StateChanged(Exception):
    """Another run has committed since this run read the state."""


class Staged(NamedTuple):
    """A snapshot that is written and not yet current."""

    path: str
    frame: DataFrame


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._list = f"{self.root}/_commits"
        self._started: dict[str, int] = {}  # run -> commit whose state it has read

    def _commit(self, seq: int) -> dict:
        return json.loads(storage.read_text(self.spark, f"{self._list}/{seq:012d}.json")) if seq else NOTHING

    def _last(self) -> dict:
        files = [n for n in storage.names(self.spark, self._list) if n.endswith(".json")]
        return self._commit(int(files[-1][:12])) if files else NOTHING

    def _base(self, run_id: str | None) -> dict:
        """The newest commit before the trailing ones of ``run_id``."""
        commit = self._last()
        while commit["seq"] and run_id is not None and commit["run_id"] == run_id:
            commit = self._commit(commit["seq"] - 1)
        return commit

    def state(self, before: str | None = None) -> Callable[[str], DataFrame]:
        """Reader of the current snapshots, or of those a run started from if it is repeated."""
        base = self._base(before)
        if before is not None:
            self._started[before] = base["seq"]
        paths = base["tables"]

        def read(name: str) -> DataFrame:
            if name not in paths:
                return self.spark.createDataFrame([], TABLES[name])
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{paths[name]}")

        return read

    def read(self, name: str) -> DataFrame:
        return self.state()(name)

    def stage(self, run_id: str, name: str, df: DataFrame) -> Staged:
        """Writes a snapshot that a later ``write`` of the run makes current; until then nobody else sees it."""
        path = f"{name}/{run_id}-{uuid.uuid4().hex[:12]}"
        ordered = df.select(*self.spark.createDataFrame([], TABLES[name]).columns)
        key = PARTITIONED.get(name)
        # with a key, large sources are split and small ones share a task; without one, every task writes one file of what it
        # has, and a whole table does not travel once more to be written
        rows = ordered.hint("rebalance", key) if key else ordered
        # mostly keys and texts, which an entropy coder makes smaller
        writer = rows.write.mode("errorifexists").option("compression", "zstd")
        (writer.partitionBy(key) if key else writer).parquet(f"{self.root}/{path}")
        return Staged(path, self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{path}"))

    def write(self, run_id: str, tables: dict[str, DataFrame | Staged]) -> None:
        """Makes new versions of the tables current, all at once."""
        started = self._started.get(run_id)
        staged = {name: df if isinstance(df, Staged) else self.stage(run_id, name, df) for name, df in tables.items()}
        paths = {name: s.path for name, s in staged.items()}
        last, base = self._last(), self._base(run_id)
        if started is not None and base["seq"] != started:
            raise StateChanged(f"run {run_id} started from commit {started}, but commit {base['seq']} is another run's")
        commit = {"seq": last["seq"] + 1, "run_id": run_id, "tables": {**base["tables"], **paths}}
        try:
            storage.create_text(self.spark, f"{self._list}/{commit['seq']:012d}.json", json.dumps(commit))
        except storage.Taken:
            raise StateChanged(f"another run has written commit {commit['seq']} while {run_id} was writing") from None

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the snapshots that none of the newest ``keep`` commits names; how many they were."""
        last = self._last()["seq"]
        used = {path for seq in range(max(1, last - keep + 1), last + 1) for path in self._commit(seq)["tables"].values()}
        gone = 0
        for name in TABLES:
            for folder in storage.names(self.spark, f"{self.root}/{name}"):
                if f"{name}/{folder}" not in used:
                    storage.delete(self.spark, f"{self.root}/{name}/{folder}")
                    gone += 1
        return gone
