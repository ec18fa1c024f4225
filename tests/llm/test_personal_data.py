import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stmtflow.llm import personal_data as pd
from tests.llm.helpers import DOC, odd_rows, stored

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PRIVATE = "Call +1 (389) 555-4387 now. Later (389) 555-4387 or 389.555.4387. Card 4328325728555127, again 4328.3257.2855.5127. Mail bob.1@mail6.example.com or bob.1@mail6, not 1234567890."


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()%éB\n", max_size=60))
def test_base_equals_the_patterns(text):
    assert pd.base_spans(text) == plain(text)


def test_address_parts_of_any_length():
    zeros = "0" * 5000
    for text, found in ((f"{zeros}.1.1.1", True), (f"1.1.1.{zeros}255", True), (f"{'9' * 6000}.1.1.1", False), (f"1.{zeros}256.1.1", False)):
        assert [s for s in pd.base_spans(text) if s[0] == "ip"] == ([("ip", 0, len(text))] if found else [])


def test_base_on_numbers_and_very_long_runs():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["4328325728555127", " ", "-", ".", "1", "25", "255", "+49", "@", "a", "9", "("]) for _ in range(14))
        assert pd.base_spans(text) == plain(text)
    for piece in ("7", "a", "1.", "a@", "+1", "1 ", "a.b@c."):
        pd.base_spans(piece * 200_000)  # a quadratic scan would not end


@pytest.fixture(scope="module")
def model(spark):
    return pd.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_similar_units_get_the_label_of_the_full_form(model):
    base = pd.base_spans(PRIVATE)
    added = {(kind, PRIVATE[a:b]) for kind, a, b in pd.added_spans(PRIVATE, base, model)}
    assert {("phone", "(389) 555-4387"), ("card", "4328.3257.2855.5127"), ("email", "bob.1@mail6")} <= added
    assert not any("1234567890" in x for _, x in added)
    alone = "Later (389) 555-4387 and 4328.3257.2855.5127"
    assert pd.added_spans(alone, pd.base_spans(alone), model) == []


def test_clean_documents_are_left_alone(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    extra = sum(len(pd.added_spans(r.text or "", pd.base_spans(r.text or ""), model)) for r in rows)
    assert extra <= 2


def test_messages_are_exact_on_a_tree_and_agree_on_a_loop():
    rng = np.random.default_rng(1)
    node, potential = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    edges = [(0, 1, potential), (1, 2, potential), (1, 3, potential)]
    want = np.zeros((4, 3))
    for x in itertools.product(range(3), repeat=4):
        w = np.exp(sum(node[i, x[i]] for i in range(4)) + sum(p[x[i], x[j]] for i, j, p in edges))
        for i in range(4):
            want[i, x[i]] += w
    got = pd.marginals(node, edges)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-3)
    same = np.eye(3) * 5
    loop = pd.marginals(np.array([[9.0, 0, 0], [0, 0.5, 0], [0, 0.5, 0]]), [(0, 1, same), (1, 2, same), (0, 2, same)])
    assert (loop.argmax(axis=1) == 0).all()


def test_query_columns_and_odd_rows(spark, tmp_path, model):
    rows = odd_rows([(30, PRIVATE, "en", "a", 1), (30, PRIVATE, "en", "a", 1)])
    docs = stored(spark, tmp_path, [(*r, "x") for r in rows], DOC + ", spans string")
    out = docs.select("doc_id", "text", pd.finder(model, F.col("text")).alias("f")).collect()
    assert len(out) == len(rows)
    for r in out:
        base = plain(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.f.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.f[f"n_{k}"] for k in pd.KINDS] == [sum(s[0] == k for s in base) for k in pd.KINDS]
        spans = [s.split(":") for s in r.f.spans.split(",") if s]
        assert set(base) <= {(k, int(a), int(b)) for k, a, b in spans}
        if not spans:
            assert r.f.redacted == r.text
        else:
            assert pd.base_spans(r.f.redacted) == [] and "555" not in r.f.redacted
    assert pd.fit(docs.where("false")).similar.max() > 0


def test_redaction_merges_overlaps():
    assert pd.redact("ab 12 cd", [("card", 3, 5), ("phone", 4, 7)]) == "ab [CARD]d"
    assert pd.redact("x", []) == "x"
