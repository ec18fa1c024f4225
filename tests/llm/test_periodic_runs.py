import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from stmtflow.llm import periodic_runs as pr
from stmtflow.llm import queries
from tests.llm.helpers import DOC, odd_rows, stored


def brute(words):
    """Every period by itself: stretches in which words so far apart are the same."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q) and i > start:
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def report(doc_id, text):
    """The row of the query, as its contract says."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        str(doc_id), len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def repeated(rng, n):
    words = [str(rng.randrange(rng.choice([1, 2, 3, 60]))) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n), 1 + rng.randrange(rng.choice([3, 10, 60]))
        for i in range(a, min(n, a + p * rng.randrange(2, 9) + rng.randrange(9))):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("stored_words", [64, 1 << 15])
def test_runs_equal_every_period_tried(monkeypatch, stored_words):
    monkeypatch.setattr(pr, "STORED", stored_words)
    monkeypatch.setattr(pr, "CHUNK", 50)
    monkeypatch.setattr(pr, "LONG", 30)
    rng = random.Random(11)
    for _ in range(500):
        words = repeated(rng, rng.choice([1, 23, 24, 25, 64, 65, 150, 400]))
        ids = pr.numbered(" ".join(words).encode())[1]
        assert [tuple(r) for r in pr.runs_of(ids).tolist()] == brute(words)


def test_extensions_equal_word_by_word():
    rng = random.Random(12)
    for _ in range(200):
        ids = pr.numbered(" ".join(repeated(rng, rng.choice([2, 21, 22, 100, 500]))).encode())[1]
        i = np.array([rng.randrange(len(ids) - 1) for _ in range(30)])
        j = np.array([rng.randrange(a + 1, len(ids)) for a in i])
        want = []
        for a, b in zip(i, j, strict=True):
            m = 0
            while b + m < len(ids) and ids[a + m] == ids[b + m]:
                m += 1
            want.append(m)
        assert pr.Extensions(ids).between(i, j).tolist() == want


def test_cover():
    assert {int(a - b) % pr.MODULUS for a in pr.COVER for b in pr.COVER} == set(range(pr.MODULUS))


def test_query_equals_its_contract(spark, tmp_path):
    rng = random.Random(13)
    rows = [r for r in odd_rows() if r[0] != 6]
    rows += [(i, " ".join(repeated(rng, rng.randrange(1, 300))), "en", "a", 1) for i in range(20, 160)]
    rows += [(i, rng.choice([None, "", "one", " \n", "a\x0bb\x0c", "x " * 40, "é   " * 30]), None, None, None) for i in range(160, 320)]
    stored(spark, tmp_path, rows)
    out = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in out) == sorted(report(r[0], r[1]) for r in rows)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 10 and any(r.n_runs > 1 for r in out)


def test_very_long_texts(spark, tmp_path):
    rows = [(1, "same " * 300_000, "en", "a", 1), (2, " ".join(str(i % 50_001) for i in range(200_000)), "en", "a", 1)]
    out = {r.doc_id: r for r in pr.find_runs(stored(spark, tmp_path, rows)).collect()}
    assert tuple(out[1].best) == (0, 300_000, 1) and len(out[1].runs) == 1 and out[1].collapsed == "same"
    assert tuple(out[2].best) == (0, 200_000, 50_001) and out[2].collapsed == " ".join(str(i) for i in range(50_001))


def test_clashing_names_and_empty_table(spark, tmp_path):
    df = stored(spark, tmp_path, odd_rows(), DOC).withColumnRenamed("lang", "runs").withColumnRenamed("source", "best").withColumnRenamed("text", "collapsed")
    found = pr.find_runs(df, "collapsed")
    assert found.count() == 12 and set(found.columns) == {"doc_id", "n_chars", "n_words", "runs", "best", "collapsed"}
    assert pr.find_runs(df.where("false"), "collapsed").count() == 0
