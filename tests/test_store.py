"""The state store: nothing committed is lost, and no run overwrites another's work."""

import pytest
from pyspark.sql import functions as F

from stmtflow.schemas import TABLES
from stmtflow.session import cut_lineage, scratch
from stmtflow.sources import storage
from stmtflow.sources.store import SnapshotStore, StateChanged


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "state"))


def accounts(store, *ids):
    return store.spark.createDataFrame([(i, f"Name {i}", False, False) for i in ids], TABLES["account"])


def ids(store):
    return sorted(r.id for r in store.read("account").collect())


def test_a_failed_repeat_keeps_the_state(store):
    store.write("r1", {"account": accounts(store, "a")})
    broken = store.spark.range(3).select(
        *[F.when(F.rand() < 2, F.raise_error(F.lit("no"))).cast("string").alias(c) if c == "id" else F.lit(None).cast("string").alias(c)
          for c in ("id", "name", "transfer_acct")], F.lit(False).alias("tombstone"))
    with pytest.raises(Exception, match="no"):
        store.write("r1", {"account": accounts(store), "payee": broken})
    assert ids(store) == ["a"] and store.read("payee").count() == 0


def test_a_repeat_starts_from_the_state_before_it(store):
    store.write("r1", {"account": accounts(store, "a")})
    for _ in range(2):
        before = store.state(before="r2")("account")
        store.write("r2", {"account": before.unionByName(accounts(store, "b"))})
        assert ids(store) == ["a", "b"]
    assert SnapshotStore(store.spark, store.root).read("account").count() == 2


def test_the_second_of_two_runs_is_refused(store):
    store.write("r0", {"account": accounts(store, "a")})
    other = SnapshotStore(store.spark, store.root)
    mine, theirs = store.state(before="r1")("account"), other.state(before="r2")("account")
    other.write("r2", {"account": theirs.unionByName(accounts(store, "b"))})
    with pytest.raises(StateChanged):
        store.write("r1", {"account": mine.unionByName(accounts(store, "c"))})
    assert ids(store) == ["a", "b"]
    # a run that starts now sees both
    store.write("r3", {"account": store.state(before="r3")("account").unionByName(accounts(store, "c"))})
    assert ids(store) == ["a", "b", "c"]


def test_one_file_has_one_writer(spark, tmp_path):
    path = str(tmp_path / "x" / "1.json")
    storage.create_text(spark, path, "first ä")
    with pytest.raises(storage.Taken):
        storage.create_text(spark, path, "second")
    assert storage.read_text(spark, path) == "first ä" and storage.names(spark, str(tmp_path / "none")) == []


def test_vacuum_keeps_what_is_current(store):
    for i in range(5):
        store.write(f"r{i}", {"account": accounts(store, *[str(k) for k in range(i + 1)])})
    assert store.vacuum(keep=1) == 4 and len(ids(store)) == 5
    assert store.vacuum(keep=1) == 0


def test_scratch_tables_go(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    with scratch(spark):
        kept = cut_lineage(spark.range(5))
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert storage.names(spark, path)
    assert not storage.names(spark, path)
    assert spark.conf.get("spark.checkpoint.dir", None) == folder


def test_a_table_without_a_key_is_written_where_its_rows_are(spark, tmp_path):
    """No exchange: as many files as tasks, with the same rows."""
    store = SnapshotStore(spark, str(tmp_path))
    rows = spark.range(0, 300, 1, 3).selectExpr(
        "concat('p', id) id", "concat('n', id) name", "cast(null as string) transfer_acct", "false tombstone"
    )
    store.write("r", {"payee": rows})
    assert len(list((tmp_path / "payee").glob("*/*.zstd.parquet"))) == 3
    assert sorted(r.id for r in store.read("payee").collect()) == sorted(f"p{i}" for i in range(300))
