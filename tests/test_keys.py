"""Content keys: stable, independent of document order, and numbered right in groups of any size."""

import hashlib
from datetime import date

from pyspark.sql import functions as F

from stmtflow.functions.identity import packed, unpacked
from stmtflow.functions.ranking import number_in_blocks
from stmtflow.operators import ledger
from stmtflow.operators.fetch import fetch_transactions
from stmtflow.operators.keys import assign_keys, keyed_once, merge_documents
from stmtflow.schemas import RAW_TXN

BASE = {
    "source_id": "pb", "account_ref": "giro", "doc": "a", "block": 0, "row_no": 0, "booking_date": date(2026, 1, 5),
    "value_date": None, "amount_cents": -350, "currency": "EUR", "counterpart_name": None, "counterpart_iban": None,
    "purpose": "Kauf 04.01.2026 12:03", "posting_text": None, "bank_reference": None, "end_to_end_id": None, "pending": False,
}


def keyed(spark, *changes):
    rows = [{**BASE, "row_no": i, **c} for i, c in enumerate(changes)]
    return assign_keys(spark.createDataFrame(rows, RAW_TXN))


def keys(frame):
    return [r.source_key for r in frame.orderBy("ordinal", "source_key").collect()]


def test_identical_rows_get_distinct_keys(spark):
    rows = keyed(spark, {}, {}).collect()
    assert len({r.source_key for r in rows}) == 2
    assert all(r.imported_id == "pb:" + r.source_key[:32] for r in rows)


def test_key_text(spark):
    parts = ["v1", "giro", "2026-01-05", "-350", "EUR", "", "", "", "KAUF 04.01.2026 12:03", "", "0"]
    assert keys(keyed(spark, {})) == [hashlib.sha256("\x1f".join(parts).encode()).hexdigest()]


def test_value_date_changes_fingerprint_only(spark):
    a, b = keyed(spark, {"value_date": date(2026, 1, 5)}).first(), keyed(spark, {"value_date": date(2026, 1, 6)}).first()
    assert a.source_key == b.source_key and a.raw_fingerprint != b.raw_fingerprint


def test_spacing_case_and_reference(spark):
    assert keys(keyed(spark, {})) == keys(keyed(spark, {"purpose": "KAUF  04.01.2026 12:03 "}))
    assert keys(keyed(spark, {"end_to_end_id": "E1"})) != keys(keyed(spark, {"end_to_end_id": "E2"}))
    assert keys(keyed(spark, {"end_to_end_id": "E1"})) == keys(keyed(spark, {"bank_reference": "E1"}))


def test_merge_collapses_overlap_and_keeps_first_document(spark):
    rows = keyed(
        spark, {}, {"amount_cents": -100}, {"amount_cents": -100, "doc": "b", "purpose": "kauf 04.01.2026 12:03"},
        {"booking_date": date(2026, 1, 9), "doc": "b"},
    )
    merged = merge_documents(rows).collect()
    assert len(merged) == 3
    assert {r.doc for r in merged if r.amount_cents == -100} == {"a"}


def test_document_order_does_not_change_keys(spark):
    changes = [{"doc": d, "amount_cents": -a} for d in "ab" for a in (1, 1, 2)]
    one = set(keys(merge_documents(keyed(spark, *changes))))
    two = set(keys(merge_documents(keyed(spark, *reversed(changes)))))
    assert one == two and len(one) == 3


def test_numbering_across_blocks(spark):
    rows = [{**BASE, "block": i // 7, "row_no": i, "value_date": date(2026, 1, 1 + i % 28)} for i in range(60)]
    frame = assign_keys(spark.createDataFrame(rows, RAW_TXN)).orderBy("ordinal")
    assert [r.ordinal for r in frame.collect()] == list(range(60))
    assert [r.value_date.day for r in frame.collect()] == [1 + i % 28 for i in range(60)]


def test_numbering_equals_row_number(spark):
    frame = spark.range(500).select(
        (F.col("id") % 3).alias("k"), F.expr("id div 40").alias("block"), F.col("id").alias("pos")
    )
    got = number_in_blocks(frame, ["k"], "block", ["pos"], "n")
    assert got.where("n <> pos div 3").count() == 0


def overlapping(spark):
    """Three documents of several blocks with many copies, a row without a block and one without a document."""
    rows = [
        {**BASE, "doc": d, "block": i // 9, "row_no": i, "amount_cents": -(i % k), "value_date": date(2026, 1, 1 + i % 28)}
        for d, n, k in (("a", 40, 3), ("b", 70, 4), ("c", 20, 2)) for i in range(n)
    ]
    return spark.createDataFrame([*rows, {**BASE, "block": None, "row_no": None}, {**BASE, "doc": None}], RAW_TXN)


def test_crowded_groups_get_the_same_keys(spark):
    rows = overlapping(spark)
    columns = ["doc", "ordinal", "source_key", "imported_id", "raw_fingerprint", "value_date"]
    usual, crowded = ([tuple(r) for r in assign_keys(rows, crowd=n).select(columns).collect()] for n in (1000, 5))
    assert sorted(map(str, usual)) == sorted(map(str, crowded)) and len(usual) == 132


def test_merge_in_place_equals_merge_by_key(spark):
    rows = overlapping(spark).where("doc is not null")
    want = sorted(map(str, merge_documents(assign_keys(rows)).collect()))
    for crowd in (1000, 5):
        assert sorted(map(str, keyed_once(rows, crowd=crowd).collect())) == want


def test_fetched_rows_travel_once(spark):
    rows = [{**BASE, "block": i // 7, "row_no": i, "doc": d} for d in "ab" for i in range(60)]
    frame = fetch_transactions(spark.createDataFrame(rows, RAW_TXN))
    assert frame.count() == 60
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_fingerprints_travel_packed_and_come_back(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "earlier", "", None, "ü", "0" * 63]
    frame = spark.createDataFrame([(t, "s", t) for t in texts], "source_key string, source_id string, raw_fingerprint string")
    both = frame.select("raw_fingerprint", unpacked(packed("raw_fingerprint")).alias("back"), F.length(packed("raw_fingerprint")).alias("n")).collect()
    assert [r.back for r in both] == texts and both[0].n == 33
    parted = ledger.partition(frame.where("source_key <> ''"), frame.replace("earlier", "later", "raw_fingerprint"))
    assert {r.source_key: r.dedup_status for r in parted.collect()} == {t: "changed" if t == "earlier" else "unchanged" for t in texts if t}
    assert "packed" not in parted.columns and {r.raw_fingerprint for r in parted.collect()} == {t for t in texts if t}


def test_tasks_that_number_rows_grow_in_number_not_in_size(spark):
    """The session's four partitions do not bound how many tasks share the rows."""
    rows = spark.createDataFrame([{**BASE, "row_no": i, "amount_cents": i // 3, "doc": "ab"[i % 2]} for i in range(600)], RAW_TXN)
    few, many = (keyed_once(rows, task_rows=n) for n in (1000, 25))
    assert many.rdd.getNumPartitions() == 24 > few.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(few.collect())
    assert sorted(assign_keys(rows, crowd=0, task_rows=25).collect()) == sorted(assign_keys(rows).collect())


def test_new_rows_are_told_without_fingerprints_and_keys_travel_packed(spark):
    digest = "0f" * 32
    rows = [(k, "s", i, "p") for k, i in ((digest, "s:" + digest[:32]), (digest.upper(), "own"), ("k", None), ("l", "s:l"), ("x", "s:x"))]
    txn = spark.createDataFrame(rows, "source_key string, source_id string, imported_id string, raw_fingerprint string")
    before = spark.createDataFrame([(digest, "s", "p"), ("k", "s", "q"), ("x", "s", None)], "source_key string, source_id string, raw_fingerprint string")
    for kept in (False, True):
        parted = ledger.partition(txn, before, kept)
        assert parted.columns == [*txn.columns, "dedup_status"]
        assert {tuple(r) for r in parted.collect()} == {
            (*r, {digest: "unchanged", "k": "changed"}.get(r[0], "new")) for r in rows
        }
    new = ledger.partition(txn, before).where("dedup_status = 'new'").select("source_id", "source_key", "imported_id")
    assert "unhex(raw_fingerprint" not in new._jdf.queryExecution().optimizedPlan().toString()


def test_digests_are_made_where_the_rows_meet(spark):
    rows = [{**BASE, "row_no": i, "amount_cents": i // 3, "doc": "ab"[i % 2]} for i in range(60)]
    for frame in (fetch_transactions(spark.createDataFrame(rows, RAW_TXN)), assign_keys(spark.createDataFrame(rows, RAW_TXN))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "sha2" not in plan[plan.index("Exchange "):]


LEDGER = (
    "source_id string, source_key string, imported_id string, actual_account_id string, booking_date date, amount_cents bigint, raw_fingerprint string, "
    "first_run_id string, last_run_id string, first_seen_at timestamp, last_seen_at timestamp"
)


def ledger_tables(spark):
    """Rows and a ledger that share some keys, with digests, other texts, own import ids and nulls."""
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(6)]
    day, at = date(2026, 1, 5), F.lit("2026-01-01").cast("timestamp")
    known = [
        ("s", digests[0], "s:" + digests[0][:32], "x", day, 1, digests[5], "r0", "r0"), ("s", digests[1], "own", "x", day, 2, "p", "r0", "r0"),
        ("s", "k", None, "x", None, 3, None, "r0", "r0"), ("z", digests[2], "z:1", None, day, 4, "p", "r0", "r0"), (None, "n", "i", "x", day, 5, "p", "r0", "r0"),
    ]
    types = LEDGER.split(", first_seen_at")[0]
    before = spark.createDataFrame(known, types).select("*", at.alias("first_seen_at"), at.alias("last_seen_at"))
    txn = spark.createDataFrame(
        [("s", digests[0], "s:" + digests[0][:32], day, 1, digests[5]), ("s", digests[1], "own", day, 2, "q"), ("s", "k", "s:k", day, 3, "p"),
         ("s", digests[3], "s:" + digests[3][:32], day, 9, digests[4]), ("t", digests[3], None, None, None, None), (None, "n", None, day, 5, "p")],
        "source_id string, source_key string, imported_id string, booking_date date, amount_cents bigint, raw_fingerprint string",
    )
    return txn, before, spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "y")], "source_id string, actual_account_id string")


def test_ledger_carried_through_the_partition_is_recorded_alike_in_one_join(spark):
    txn, before, accounts = ledger_tables(spark)
    now = F.lit("2026-02-01").cast("timestamp")
    for statuses in ([ledger.NEW, ledger.CHANGED], [ledger.UNCHANGED], [ledger.NEW, ledger.CHANGED, ledger.UNCHANGED]):
        parted = ledger.partition(txn, before)
        want = ledger.record(before, parted.where(F.col("dedup_status").isin(statuses)), accounts, "r1", now)
        got = ledger.record(before, ledger.only(ledger.partition(txn, before, carrying=True), *statuses), accounts, "r1", now)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("Join ") == 2


def test_keys_that_the_ledger_has_twice_are_recorded_as_before(spark):
    txn, before, accounts = ledger_tables(spark)
    now, more = F.lit("2026-02-01").cast("timestamp"), before.where("amount_cents in (1, 4)")
    for known in (before, before.unionByName(more.withColumn("raw_fingerprint", F.lit("other")))):
        for statuses in ([ledger.NEW, ledger.CHANGED], [ledger.UNCHANGED]):
            parted = ledger.partition(txn, known).where(F.col("dedup_status").isin(statuses))
            want = ledger.record(known, parted, accounts, "r1", now)
            got = ledger.record_fetched(txn, known, statuses, accounts, "r1", now)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
