"""One-to-one adoption against a plain walk over all rows."""

import random
from datetime import date, timedelta

import pytest

from stmtflow.operators import importing, matching
from stmtflow.plans import queries
from stmtflow.session import cut_lineage

START = date(2026, 1, 1)
ROWS = "source_id string, source_key string, account_id string, imported_id string, booking_date date, amount_cents bigint, payee string, notes string"
FREE = "account_id string, amount_cents bigint, day date, payee string, id string"


def case(seed, rows, seats, days, payees, accounts=2):
    rng = random.Random(seed)

    def payee():
        return rng.choice([*[f"p{i}" for i in range(payees)], None])

    left = [
        (f"s{rng.randrange(2)}", f"{rng.getrandbits(64):016x}", f"a{rng.randrange(accounts)}", f"i{i}",
         START + timedelta(rng.randrange(days)), 100 * rng.randrange(1, 3), payee(), "n")
        for i in range(rows)
    ]
    right = [
        (f"a{rng.randrange(accounts)}", 100 * rng.randrange(1, 3), START + timedelta(rng.randrange(days)), payee(),
         f"{rng.getrandbits(64):016x}")
        for _ in range(seats)
    ]
    return left, right


def plain_walk(left, right):
    used, out = set(), {}
    for source, key, account, _, day, amount, payee, _ in sorted(left, key=lambda r: (r[0], r[4], r[1])):
        best = None
        for a, c, d, p, ident in right:
            if a != account or c != amount or ident in used or abs((d - day).days) > 7:
                continue
            rank = (not (p is not None and p == payee), abs((d - day).days), d, ident)
            if best is None or rank < best:
                best = rank
        if best:
            used.add(best[3])
            out[source, key] = best[3]
    return out


CASES = [
    case(1, 60, 60, 30, 3),  # mixed
    case(2, 120, 80, 10, 2, 1),  # crowded: everything reaches everything
    case(3, 80, 120, 60, 4),  # more seats than rows
    case(4, 90, 30, 20, 1),  # many rows go empty
    case(5, 20, 20, 400, 2),  # sparse: mostly settled without a contest
]


@pytest.mark.parametrize("sample,block", [(c, matching.BLOCK) for c in CASES] + [(c, 9) for c in CASES[:4]] + [(CASES[1], 1)])
def test_assignment_equals_plain_walk(spark, sample, block):
    left, right = sample
    rows, free = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, FREE)
    got = {
        (r.source_id, r.source_key): r.id
        for r in matching.match_assign(rows, free, block).collect()
    }
    assert got == plain_walk(left, right)
    assert len(set(got.values())) == len(got)


def dense(size, days, payees):
    """One segment in which everything is contested."""
    left, right = case(11, size, size, days, payees, 1)
    return [(*r[:5], 100, *r[6:]) for r in left], [(a, 100, *r) for a, _, *r in right]


@pytest.mark.parametrize("days,payees", [(60, 3), (1, 2)])
def test_dense_segment_in_few_jobs(spark, monkeypatch, days, payees):
    left, right = dense(1500, days, payees)
    written = []
    monkeypatch.setattr(matching, "cut_lineage", lambda df, cut=matching.cut_lineage: written.append(1) or cut(df))
    rows, free = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, FREE)
    got = {(r.source_id, r.source_key): r.id for r in matching.match_assign(rows, free, 250).collect()}
    assert got == plain_walk(left, right)
    # seven tables before the rounds; three in each of at most six rounds, as there are six blocks
    assert len(written) <= 7 + 3 * 6


def test_plan_updates_adopts_and_creates(spark):
    rows = spark.createDataFrame(
        [
            ("s", "k1", "a", "s:1", date(2026, 1, 5), -100, "Shop", "note"),
            ("s", "k2", "a", "s:2", date(2026, 1, 6), -200, "Shop", "note"),
            ("s", "k3", "a", "s:3", date(2026, 1, 7), -300, "Shop", "note"),
            ("s", "k4", "a", "s:4", date(2026, 1, 8), -400, "Shop", "note"),
        ],
        ROWS,
    )
    existing = spark.createDataFrame(
        [
            ("t1", "a", date(2026, 1, 5), -100, "Shop", "old", "s:1", True, "Shop"),
            ("t2", "a", date(2026, 1, 4), -200, "Shop", "old", "s:2", True, "Shop"),
            ("t3", "a", date(2026, 1, 9), -300, None, "", None, False, None),
            ("t4", "a", date(2026, 1, 8), -400, "Shop", "old", "other:9", True, "Shop"),
        ],
        "id string, account_id string, booking_date date, amount_cents bigint, payee string, notes string, "
        "imported_id string, cleared boolean, imported_payee string",
    )
    plan = importing.import_plan(rows, existing)
    assert {r.source_key: r.action for r in plan.collect()} == {
        "k1": "unchanged", "k2": "updated", "k3": "adopted", "k4": "created",
    }
    after = {r.id: r for r in importing.apply_plan(existing, plan).collect()}
    assert len(after) == 5
    assert after["t2"].booking_date == date(2026, 1, 6)
    assert (after["t3"].imported_id, after["t3"].payee, after["t3"].notes, after["t3"].cleared) == ("s:3", "Shop", "note", True)
    assert after["t3"].booking_date == date(2026, 1, 9)  # an adopted row keeps its own date
    assert after["t4"].imported_id == "other:9"
    again = importing.import_plan(rows, importing.apply_plan(existing, plan))
    # the adopted row kept its date, which the import owns from now on
    assert {r.source_key: r.action for r in again.collect()} == {
        "k1": "unchanged", "k2": "unchanged", "k3": "updated", "k4": "unchanged",
    }


def test_candidates_equal_plain_search(spark):
    for left, right in CASES[:4]:
        rows, free = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, FREE)
        got = {(r.source_id, r.source_key): (r.candidates, r.best_id, r.best_same_payee) for r in matching.match_candidates(rows, free).collect()}
        want = {}
        for source, key, account, _, day, amount, payee, _ in left:
            near = [
                (not (p is not None and p == payee), abs((d - day).days), d, i)
                for a, c, d, p, i in right if (a, c) == (account, amount) and abs((d - day).days) <= 7
            ]
            best = min(near, default=(True, 0, None, None))
            want[source, key] = len(near), best[3], not best[0]
        assert got == want


def test_no_class_is_copied_per_day(spark):
    left, right = CASES[0]
    rows, free = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, FREE)
    plan = matching.match_candidates(rows, free)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_exact_match_takes_the_smallest_id_of_any_shape(spark):
    digest = lambda c: c * 64
    day = date(2026, 1, 5)
    ids = {"i1": [digest("b"), digest("a")], "i2": ["zz", digest("b")], "i3": ["A", digest("0")], "i4": [None, digest("a")], "i5": ["y", "x"], "": ["e"],
           "s:" + "0f" * 16: ["long"], "s:" + "0F" * 16: ["capital"], "i7": [digest("A"), digest("a")]}
    existing = spark.createDataFrame(
        [("a", i, n, day if n != "x" else START, n != "A") for i, names in ids.items() for n in names],
        "account_id string, imported_id string, id string, booking_date date, cleared boolean",
    )
    left = [("s", f"k{n}", "a", i, day, 1, None, "n") for n, i in enumerate([*ids, "none", None])]
    out = matching.match_exact(spark.createDataFrame(left, ROWS), existing)
    assert out.columns[:2] == ["account_id", "imported_id"] and out.columns[-2:] == ["matched_id", "differs"]
    want = {i: min(names, key=lambda n: (n is not None, n or "")) for i, names in ids.items() if i}
    assert {r.imported_id: r.matched_id for r in out.collect()} == want | {"": None, "none": None, None: None}
    assert {r.imported_id for r in out.where("differs").collect()} == {"i5"}


@pytest.mark.parametrize("name", ["match_exact", "match_candidates", "match_assign", "import_plan"])
def test_new_rows_are_written_before_the_budget_is_built(spark, monkeypatch, name):
    """So that what the fetch has shuffled does not lie on the disk beside what the budget takes."""
    order = []
    rows = spark.createDataFrame(
        [("s", "k", "a", "s:k", date(2026, 1, 5), 5, "p", "n")],
        "source_id string, source_key string, account_id string, imported_id string, booking_date date, amount_cents bigint, payee string, notes string",
    )
    budget = spark.createDataFrame(
        [("t", "a", date(2026, 1, 6), 5, "p", None, False), ("u", "a", date(2026, 1, 6), 5, "q", "s:x", True)],
        "id string, account_id string, booking_date date, amount_cents bigint, payee string, imported_id string, cleared boolean",
    )
    monkeypatch.setattr(queries, "_importable", lambda t: rows)
    monkeypatch.setattr(queries, "cut_lineage", lambda frame: order.append("cut") or cut_lineage(frame))
    monkeypatch.setattr(queries.st, "budget_transactions", lambda t: order.append("budget") or budget)
    found = getattr(queries, name)(None).first()
    assert order[:2] == ["cut", "budget"] and found.source_key == "k"
