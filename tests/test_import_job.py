"""Batch and stream imports over real files and stored state."""

import os
from datetime import UTC, date, datetime, timedelta

import pytest

from stmtflow.plans import upkeep
from stmtflow.plans.importer import ImportJob
from stmtflow.plans.review import ReviewRound
from stmtflow.schemas import SOURCE, TABLES
from stmtflow.sources import inbox
from stmtflow.sources.store import SnapshotStore
from stmtflow.streaming import inbox_stream
from tests import files

NOW = datetime(2026, 3, 1, 8, 0)
SOURCES = [
    ("pb", "manual_import", "Giro", "giro", "EUR", "postbank-csv", "pb/*.csv", None),
    ("bad", "manual_import", "Second", "second", "EUR", "postbank-csv", "bad/*.csv", None),
    ("lost", "manual_import", "Nowhere", "lost", "EUR", "postbank-csv", "lost/*.csv", None),
]


@pytest.fixture
def job(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    frame = spark.createDataFrame
    store.write(
        "init",
        {
            "account": frame([("A1", "Giro", False, False), ("A2", "Second", False, False)], TABLES["account"]),
            "payee": frame([("P1", "Bäckerei Probe", None, False)], TABLES["payee"]),
            "category": frame([("C1", "Food", "G1", False, False), ("C2", "Power", "G1", False, False)], TABLES["category"]),
            "category_group": frame([("G1", "Usual", False)], TABLES["category_group"]),
            "rule": frame(
                [("R1", 1, '[{"field":"imported_description","op":"contains","value":"stadtWERKE"}]',
                  '[{"field":"category","op":"set","value":"C2"}]', False)],
                TABLES["rule"],
            ),
            "budget_txn": frame(
                [("T1", "A1", date(2026, 2, 8), -420, "P1", None, None, None, None, False, False, False, False)],
                TABLES["budget_txn"],
            ),
        },
    )
    files.write(tmp_path / "inbox", "pb/a.csv", files.bank_text())
    files.write(tmp_path / "inbox", "pb/b.csv", files.bank_text(files.ROWS[2:]))
    files.write(tmp_path / "inbox", "bad/a.csv", "no;header\n")
    return ImportJob(spark, str(tmp_path / "inbox"), frame([(*s, i) for i, s in enumerate(SOURCES)], SOURCE.rstrip() + ", position int"), store)


def counters(frame):
    return {r.source_id: r for r in frame.collect()}


def test_import_is_idempotent(job, spark, tmp_path):
    dry = counters(job.run("dry", NOW, dry_run=True))
    assert (dry["pb"].added, dry["pb"].updated) == (3, 1)
    assert job.store.read("import_ledger").count() == 0

    first = counters(job.run("r1", NOW))
    pb = first["pb"]
    assert (pb.fetched, pb.pending_rows, pb.files, pb.new_rows, pb.added, pb.updated, pb.unchanged) == (4, 2, 2, 4, 3, 1, 0)
    assert (pb.window_from, pb.window_to, pb.statement_balance_cents) == (date(2026, 2, 3), date(2026, 2, 13), 120456)
    assert pb.statement_balance_date == datetime.fromtimestamp(os.stat(tmp_path / "inbox/pb/a.csv").st_mtime, UTC).date()
    assert pb.actual_balance_cents == -7500 - 420 - 420 + 250000
    assert (first["bad"].status, first["bad"].error) == ("error", "no header row with column Buchungstag")
    assert first["lost"].error == "no account named Nowhere"

    ledger = job.store.read("import_ledger")
    assert ledger.count() == 4 == ledger.select("source_id", "source_key").distinct().count()
    rows = {r.id: r for r in job.store.read("budget_txn").collect()}
    assert rows["T1"].imported_id is not None and rows["T1"].cleared and rows["T1"].notes == "Kauf 05.02.2026"
    assert {r.category_id for r in rows.values() if r.amount_cents == -7500} == {"C2"}
    assert {r.name for r in job.store.read("payee").collect()} == {"Bäckerei Probe", "Stadtwerke Probe", "Firma Probe AG"}
    log = {(r.id, r.status, r.error) for r in job.store.read("import_run").where("source_id = 'pb'").collect()}
    assert log == {("r1:pb", "ok", None), ("dry:pb", "abandoned", "pipeline restarted before import")}
    assert {r.status for r in job.store.read("import_run").where("id like 'r1:%' and source_id <> 'pb'").collect()} == {"error"}

    # the same run again writes the same state; a new run finds nothing
    before = sorted(map(str, job.store.read("budget_txn").collect()))
    job.run("r1", NOW)
    assert sorted(map(str, job.store.read("budget_txn").collect())) == before
    again = counters(job.run("r2", NOW))["pb"]
    assert (again.files, again.fetched, again.added) == (0, 0, 0)

    # an overlapping export brings two rows, one of them shown in another way
    changed = files.ROWS[0].replace("Abschlag Februar", "ABSCHLAG  Februar")
    extra = files.bank_row("20.2.2026", "Kartenzahlung", "Markt Probe", "Kauf 19.02.2026", debit="-9,99")
    files.write(tmp_path / "inbox", "pb/c.csv", files.bank_text([changed, *files.ROWS[1:4], extra]))
    later = counters(job.run("r3", NOW))["pb"]
    assert (later.new_rows, later.changed_rows, later.unchanged_rows, later.added, later.unchanged) == (1, 1, 3, 1, 3)
    runs = {r.last_run_id for r in job.store.read("import_ledger").collect()}
    assert runs == {"r3"} and job.store.read("import_ledger").where("first_run_id = 'r1'").count() == 4


def test_consumed_files_leave_the_inbox(job, tmp_path):
    """A run sets aside what committed runs before it have consumed; a repeated run still finds its own files."""
    inbox, job.archive = tmp_path / "inbox", str(tmp_path / "archive")
    there = lambda folder: {str(p.relative_to(folder)) for p in folder.rglob("*.csv")}
    job.run("r1", NOW)
    first = sorted(map(str, job.store.read("import_ledger").collect()))
    assert there(inbox) == {"pb/a.csv", "pb/b.csv", "bad/a.csv"}
    job.run("r1", NOW)
    assert sorted(map(str, job.store.read("import_ledger").collect())) == first and len(first) == 4
    again = counters(job.run("r2", NOW))["pb"]
    assert (again.files, again.added) == (0, 0) and there(inbox) == {"bad/a.csv"}
    assert there(tmp_path / "archive") == {"pb/a.csv", "pb/b.csv"} and job.store.read("processed_files").count() == 0
    files.write(inbox, "pb/a.csv", files.bank_text([files.bank_row("21.2.2026", "Kartenzahlung", "Kiosk", "x", debit="-1,00")]))
    assert counters(job.run("r3", NOW))["pb"].added == 1
    assert job.set_aside("r4") == 1 and job.set_aside("r4") == 0
    aside = there(tmp_path / "archive")
    assert len(aside) == 3 and there(inbox) == {"bad/a.csv"} and any(n.startswith("pb/a.") and n.count(".") == 2 for n in aside)


def test_stream_equals_batch(job, spark, tmp_path):
    query = inbox_stream.start(job, str(tmp_path / "checkpoint"), lambda batch: NOW, files_per_batch=1)
    query.awaitTermination(240)
    assert query.exception() is None
    rows = job.store.read("budget_txn")
    assert rows.count() == 4
    assert job.store.read("import_ledger").count() == 4
    assert job.store.read("processed_files").count() == 2  # the unreadable file may come again
    by_run = {r.new_rows for r in job.store.read("import_run").where("source_id = 'pb' and fetched > 0").collect()}
    assert sum(by_run) >= 3


def test_a_failed_source_loses_no_file(job, tmp_path):
    """The good file of a source that failed arrives once its bad file is gone."""
    bad = files.write(tmp_path / "inbox", "pb/bad.csv", "no;header\n")

    def stream():
        query = inbox_stream.start(job, str(tmp_path / "checkpoint"), lambda batch: NOW)
        query.awaitTermination(240)
        assert query.exception() is None

    stream()
    assert job.store.read("import_ledger").count() == 0
    assert {r.doc for r in job.store.read("waiting_files").collect()} == {"pb/a.csv", "pb/b.csv", "pb/bad.csv", "bad/a.csv"}
    bad.unlink()
    files.write(tmp_path / "inbox", "pb/new.csv", files.bank_text([files.bank_row("21.2.2026", "Kartenzahlung", "Kiosk", "x", debit="-1,00")]))
    stream()
    assert job.store.read("import_ledger").count() == 5
    assert {r.doc for r in job.store.read("waiting_files").collect()} == {"bad/a.csv"}


def test_consumed_files_are_not_read(job, spark, tmp_path):
    job.run("r1", NOW)
    os.chmod(tmp_path / "inbox/pb/a.csv", 0o644)
    listed = inbox.source_files(inbox.inbox_files(spark, job.inbox), job.formats())
    waiting = inbox.unprocessed(listed, job.store.read("processed_files"))
    assert [r.doc for r in waiting.collect()] == ["bad/a.csv"]
    lines = job._lines(waiting, None)
    assert [os.path.basename(f) for f in lines.inputFiles()] == ["a.csv"] and "/bad/" in lines.inputFiles()[0]
    assert inbox.read_lines(spark, job.inbox, []).count() == 0


def test_odd_file_names(spark, tmp_path):
    names = ["pb/a [1]*{x}.csv", "pb/ä + b%20.csv", "pb/c?.csv"]
    for name in names:
        files.write(tmp_path / "inbox", name, "one\ntwo\n", "utf-8")
    files.write(tmp_path / "inbox", "pb/cx.csv", "other\n", "utf-8")
    folder = str(tmp_path / "inbox")
    listed = sorted(r.doc for r in inbox.inbox_files(spark, folder).collect())
    assert set(names) <= set(listed)
    got = inbox.read_lines(spark, folder, names).groupBy("doc").count().collect()
    assert {(r.doc, r["count"]) for r in got} == {(n, 2) for n in names}


def test_errors_stay_with_their_source(job, spark, tmp_path):
    huge = files.bank_row("3.2.2026", "SEPA-Lastschrift", "X", "y", debit="-99999999999999999999,00")
    files.write(tmp_path / "inbox", "bad/a.csv", files.bank_text([huge, files.ROWS[0]]))
    twin = spark.createDataFrame([("A0", "Giro", False, True), ("A9", "Giro", False, False)], TABLES["account"])
    job.store.write("more", {"account": job.store.read("account").unionByName(twin)})
    got = counters(job.run("r1", NOW))
    assert (got["bad"].status, got["bad"].error) == ("error", "cannot parse amount")
    assert (got["pb"].status, got["pb"].fetched, got["pb"].added) == ("ok", 4, 3)
    assert {r.account_id for r in job.store.read("budget_txn").collect()} == {"A1"}  # open, then the smallest id


def test_opening_balances_are_written(job, spark):
    job.run("r1", NOW)
    first = {r.source_id: r for r in upkeep.opening_balances(job.store, job.sources, "o1").collect()}
    assert (first["pb"].action, first["pb"].dated) == ("created", date(2026, 2, 2))
    assert first["bad"].error == "no statement balance known"
    rows = job.store.read("budget_txn")
    opening = rows.where("starting_balance_flag").first()
    names = {r.id: r.name for t in ("payee", "category", "category_group") for r in job.store.read(t).collect()}
    assert (names[opening.payee_id], names[opening.category_id], opening.imported_id) == ("Starting Balance", "Starting Balances", "pb:starting-balance")
    assert {r.name for r in job.store.read("category_group").collect()} == {"Usual", "Income"}
    assert rows.where("account_id = 'A1'").groupBy().sum("amount_cents").first()[0] == 120456
    # the same again, and after a change: one row, adjusted; payee and category are not created twice
    assert upkeep.opening_balances(job.store, job.sources, "o2").where("source_id = 'pb'").first().action == "unchanged"
    more = spark.createDataFrame([("T9", "A1", date(2026, 2, 9), 1000, "P1", None, None, None, None, False, False, False, False)], TABLES["budget_txn"])
    job.store.write("manual", {"budget_txn": job.store.read("budget_txn").unionByName(more)})
    dry = upkeep.opening_balances(job.store, job.sources, "o3", dry_run=True).where("source_id = 'pb'").first()
    assert (dry.action, dry.starting_balance_cents) == ("updated", opening.amount_cents - 1000)
    assert job.store.read("budget_txn").where("starting_balance_flag").first().amount_cents == opening.amount_cents
    upkeep.opening_balances(job.store, job.sources, "o4")
    assert job.store.read("budget_txn").where("starting_balance_flag").first().amount_cents == opening.amount_cents - 1000
    assert job.store.read("payee").where("name = 'Starting Balance'").count() == 1


def test_rules_are_applied_and_written(job, spark):
    job.run("r1", NOW)
    rule = spark.createDataFrame(
        [("R2", 2, '[{"field":"description","op":"is","value":"P1"}]', '[{"field":"category","op":"set","value":"C1"}]', False)], TABLES["rule"]
    )
    job.store.write("rule", {"rule": job.store.read("rule").unionByName(rule)})
    done = upkeep.apply_rules(job.store, "a1").first()
    assert (done.categorized, done.rules) == (2, 2) and done.considered >= 2
    assert job.store.read("budget_txn").where("payee_id = 'P1' and category_id = 'C1'").count() == 2
    assert upkeep.apply_rules(job.store, "a2", uncategorized_only=False).first().categorized == 0


def test_fetched_runs_expire(job, spark):
    job.run("dry", NOW, dry_run=True)
    assert {r.status for r in job.store.read("import_run").where("source_id = 'pb'").collect()} == {"fetched"}
    job.run("dry2", NOW + timedelta(hours=2), dry_run=True)
    reasons = {r.id: r.error for r in job.store.read("import_run").where("source_id = 'pb'").collect()}
    assert reasons == {"dry:pb": "batch expired before import", "dry2:pb": None}


def test_review_round(job, spark):
    job.run("r1", NOW)
    step = ReviewRound(job.store, "v1", NOW, "m")
    short = {r.payee: r for r in step.shortlist().collect()}
    assert set(short) == {"Bäckerei Probe", "Firma Probe AG"} and short["Bäckerei Probe"].ref == "p1"
    text = step.prompt().first().prompt
    assert "- [c1] Food — Usual" in text
    assert "- *stadtWERKE* → Power  (rule)" in text
    assert '- [p1] Bäckerei Probe: 2 transactions, avg 4 EUR expense, purpose: "Kauf 05.02.#"' in text
    answer = (
        '{"proposals":[{"ref":"P1","category_ref":"c1","confidence":1.7,"reason":"bread"},'
        '{"payee":"bäckerei probe","category":"Power","confidence":0.2},'
        '{"payee":"firma probe ag!","category":"POWER","confidence":"n/a"},'
        '{"payee":"Nobody","category":"Food"},{"payee":"Firma Probe AG","category":"Salary"}]}'
    )
    dropped = {r.reason: r.dropped for r in step.store_answers(spark.createDataFrame([("1", answer)], "doc string, json string")).collect()}
    assert dropped == {"unknown_payee": 1, "unknown_category": 1}
    queue = {r.payee: r for r in job.store.read("category_proposal").collect()}
    assert (queue["Bäckerei Probe"].category, float(queue["Bäckerei Probe"].confidence)) == ("Food", 1.0)
    assert (queue["Firma Probe AG"].category, float(queue["Firma Probe AG"].confidence)) == ("Power", 0.0)
    made = ReviewRound(job.store, "v2", NOW).approve([], min_confidence=0.9).collect()
    assert [(r.payee, r.applied_to) for r in made] == [("Bäckerei Probe", 2)]
    assert job.store.read("rule").count() == 2
    assert job.store.read("budget_txn").where("category_id = 'C1'").count() == 2
    other = queue["Firma Probe AG"].id
    ReviewRound(job.store, "v3", NOW).reject([other[:8]])
    status = {r.payee: r.status for r in job.store.read("category_proposal").collect()}
    assert status == {"Bäckerei Probe": "approved", "Firma Probe AG": "rejected"}
    assert ReviewRound(job.store, "v4", NOW).shortlist().count() == 0
