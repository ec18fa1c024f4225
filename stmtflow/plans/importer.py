"""Fetch, dedup and import of all sources in one job; the same steps serve batch and stream."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.operators import balances, fetch, importing, ledger, runs
from stmtflow.session import cut_lineage, scratch
from stmtflow.sources import inbox as box
from stmtflow.sources.profiles import profiles_frame, resolve_profiles
from stmtflow.sources.registry import registry
from stmtflow.sources.statements import ParsedStatements
from stmtflow.sources.store import SnapshotStore


@dataclass
class ImportJob:
    """Configuration of an import: where files arrive, which sources exist, where state lives.

    With ``archive`` (a folder outside the inbox, on the same store) consumed files leave the inbox: each run first sets aside
    what runs before it have consumed and committed. So a run that is repeated finds its files again, a later one lists
    only what is new or could not be read, and the list of processed files holds no more than the inbox does.
    """

    spark: SparkSession
    inbox: str
    sources: DataFrame
    store: SnapshotStore
    profiles: DataFrame | None = None
    archive: str | None = None

    def formats(self) -> DataFrame:
        return resolve_profiles(registry(self.sources), self.profiles or profiles_frame(self.spark))

    def run(self, run_id: str, now: datetime, *, dry_run: bool = False, trigger: str = "batch") -> DataFrame:
        """Import everything the inbox holds. Returns one row of counters per source."""
        with scratch(self.spark):
            if not dry_run:
                self.set_aside(run_id)
            listed = box.source_files(box.inbox_files(self.spark, self.inbox), self.formats())
            return self._run(listed, None, run_id, now, dry_run, trigger)

    def run_arrived(self, lines: DataFrame, files: DataFrame, run_id: str, now: datetime, trigger: str = "stream") -> DataFrame:
        """Import files that have just arrived (``lines`` holds theirs) and those that wait for their source.

        A file that no longer exists has nothing to wait for.
        """
        with scratch(self.spark):
            self.set_aside(run_id)
            late = self.store.state(before=run_id)("waiting_files").select("source_id", "doc")
            there = box.inbox_files(self.spark, self.inbox).join(late, "doc").select("source_id", "doc", "modified_at")
            every = files.unionByName(there).groupBy("source_id", "doc").agg(F.max("modified_at").alias("modified_at"))
            return self._run(every, lines, run_id, now, False, trigger)

    def set_aside(self, run_id: str) -> int:
        """Moves the files that runs before this one have consumed to the archive, if there is one."""
        if self.archive is None:
            return 0
        listed = box.source_files(box.inbox_files(self.spark, self.inbox), self.formats())
        done = box.finished(listed, self.store.state(before=run_id)("processed_files"))
        return box.set_aside(self.spark, self.inbox, self.archive, done)

    def _lines(self, waiting: DataFrame, arrived: DataFrame | None) -> DataFrame:
        docs = waiting.select("doc").distinct()
        if arrived is not None:
            here = arrived.select("doc").distinct()
            docs = docs.join(here, "doc", "left_anti")
        names = sorted(r.doc for r in docs.collect())  # file names, as a scan's listing
        read = box.read_lines(self.spark, self.inbox, names)
        return read if arrived is None else arrived.unionByName(read)

    def _run(
        self, files: DataFrame, arrived: DataFrame | None, run_id: str, now: datetime, dry_run: bool, trigger: str
    ) -> DataFrame:
        state = self.store.state(before=run_id)
        at = F.lit(now).cast("timestamp")
        formats = self.formats()
        waiting = cut_lineage(box.unprocessed(files, state("processed_files")))
        parsed = ParsedStatements(box.lines_of(self._lines(waiting, arrived), waiting), formats)
        stats = cut_lineage(parsed.stats)

        # one document that cannot be read stops its source, and only that source
        resolved = importing.resolve_accounts(registry(self.sources), state("account"))
        broken = stats.where("error is not null").groupBy("source_id").agg(F.min("error").alias("_file_error"))
        status = cut_lineage(
            formats.select("source_id", "config_error")
            .join(resolved, "source_id")
            .join(broken, "source_id", "left")
            .select(
                "source_id", "account_id", F.col("actual_account").alias("account"),
                F.coalesce("config_error", "_file_error", "error").alias("error"),
            )
        )
        usable = status.where("error is null")
        rows = parsed.rows.join(usable.select("source_id"), "source_id", "left_semi")
        parted = cut_lineage(ledger.partition(fetch.fetch_transactions(rows, parsed.long_documents()), state("import_ledger")))

        people = state("payee")
        names = people.select(F.col("id").alias("payee_id"), F.col("name").alias("payee"))
        existing = state("budget_txn").join(names, "payee_id", "left")
        accounts = usable.select("source_id", "account_id", F.lit(None).cast("string").alias("error"))
        plan = importing.import_plan(
            importing.importable(parted, accounts), existing.where("not tombstone and not is_parent")
        )
        plan, people = importing.with_payees(plan, people)
        plan = cut_lineage(importing.with_categories(plan, state("rule")))
        counters = self._counters(status, parted, plan, stats)
        log = self._open_log(state("import_run"), at)
        if dry_run:
            result = self._kept(counters.withColumn("actual_balance_cents", F.lit(None).cast("bigint")))
            # what a dry run has fetched can still be imported, until it expires
            ok = F.col("status") == runs.OK
            fetched = self._run_rows(result, run_id, at, trigger).withColumns(
                {"finished_at": F.when(~ok, F.col("finished_at")), "status": F.when(ok, runs.FETCHED).otherwise(F.col("status"))}
            )
            self.store.write(run_id, {"import_run": log.unionByName(fetched)})
            return result

        # written where it will stay; balances are read from it
        after = self.store.stage(run_id, "budget_txn", importing.apply_plan(existing, plan))
        worth = balances.account_balance(after.frame, state("account"))
        result = self._kept(
            counters.join(worth.select("account_id", F.col("balance_cents").alias("_b")), "account_id", "left")
            .withColumn("actual_balance_cents", F.when(F.col("status") == runs.OK, F.col("_b")))
            .drop("_b")
        )
        owners = usable.select("source_id", F.col("account_id").alias("actual_account_id"))
        consumed = waiting.join(usable.select("source_id"), "source_id", "left_semi")
        left = waiting.join(usable.select("source_id"), "source_id", "left_anti")
        self.store.write(
            run_id,
            {
                "budget_txn": after,
                "payee": people,
                "import_ledger": ledger.record(state("import_ledger"), parted, owners, run_id, at),
                "processed_files": self._remembered(state("processed_files")).unionByName(
                    consumed.withColumn("run_id", F.lit(run_id))
                ),
                "waiting_files": left.select("source_id", "doc", "modified_at"),
                "import_run": log.unionByName(self._run_rows(result, run_id, at, trigger)),
            },
        )
        return result

    def _remembered(self, processed: DataFrame) -> DataFrame:
        """The processed files that a later run could still meet."""
        if self.archive is None:
            return processed
        return processed.join(box.inbox_files(self.spark, self.inbox), ["doc", "modified_at"], "left_semi").select(*processed.columns)

    def _kept(self, result: DataFrame) -> DataFrame:
        """The counters, one row per source, without the tables they were computed from."""
        return self.spark.createDataFrame(result.collect(), result.schema)

    @staticmethod
    def _open_log(log: DataFrame, at: Column) -> DataFrame:
        """The run log when a run starts: what was fetched too long ago has expired, the rest belongs to a run before."""
        return runs.abandon_stale(runs.expire(log, at), at)

    @staticmethod
    def _counters(status: DataFrame, parted: DataFrame, plan: DataFrame, stats: DataFrame) -> DataFrame:
        fetched = fetch.fetch_stats(parted, stats.select("source_id", "doc", "pending_rows"))
        dedup = ledger.partition_counts(parted)
        done = importing.import_counts(plan, parted)
        stated = fetch.newest_statement_balance(stats.where("error is null")).drop("statement_doc")
        counts = ["fetched", "pending_rows", "files", "new_rows", "changed_rows", "unchanged_rows", "added", "updated", "unchanged"]
        failed = F.col("error").isNotNull()
        return (
            status.join(fetched, "source_id", "left")
            .join(dedup, "source_id", "left")
            .join(done, "source_id", "left")
            .join(stated, "source_id", "left")
            .fillna(0, counts)
            # a source that failed imports and reports nothing
            .withColumns({c: F.when(failed, F.lit(0)).otherwise(F.col(c)) for c in counts if c != "files"})
            .withColumns(
                {
                    c: F.when(~failed, F.col(c))
                    for c in ("window_from", "window_to", "statement_balance_cents", "statement_balance_date")
                }
            )
            .withColumn("status", F.when(failed, runs.ERROR).otherwise(runs.OK))
        )

    @staticmethod
    def _run_rows(result: DataFrame, run_id: str, at, trigger: str) -> DataFrame:
        return result.select(
            F.concat_ws(":", F.lit(run_id), "source_id").alias("id"),
            "source_id",
            at.alias("started_at"),
            at.alias("finished_at"),
            "window_from",
            "window_to",
            "fetched",
            F.col("added").alias("new_rows"),
            F.col("updated").alias("updated_rows"),
            F.col("unchanged").alias("unchanged_rows"),
            "pending_rows",
            "status",
            "error",
            F.lit(trigger).alias("trigger_source"),
            "statement_balance_cents",
            "statement_balance_date",
            "actual_balance_cents",
        )
