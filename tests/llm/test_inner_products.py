import math
import random
from fractions import Fraction

import numpy as np
import pytest

from stmtflow.llm import inner_products as ip
from tests.llm.helpers import stored

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, scale=1024):
    """Every product with Python's integers."""
    single = lambda c: float(np.float32(c))
    ok = [(i, [math.floor(Fraction(single(c)) * scale) for c in v]) for i, v in rows if i is not None and v is not None and None not in v and all(math.isfinite(single(c)) for c in v)]
    out = set()
    for q, x in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        near = [(-min(max(sum(a * b for a, b in zip(x, v)), -(2**63)), 2**63 - 1), i) for i, v in ok if i != q and len(v) == len(x)]
        out |= {(q, x, n + 1, i, -s) for n, (s, i) in enumerate(sorted(near)[:k])}
    return sorted((q, n, i, s) for q, _, n, i, s in out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def asked(df):
    return ip.top_products(df, df.vec_id % 100 == 0)


@pytest.mark.parametrize("shape", ["unit", "lengths", "clusters", "small"])
def test_equals_all_products(spark, tmp_path, monkeypatch, shape):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(1500, 12))
    if shape == "unit":
        m /= np.linalg.norm(m, axis=1)[:, None]
    elif shape == "lengths":
        m *= rng.pareto(1.0, size=(1500, 1)) + 0.01
    elif shape == "clusters":  # near the axes, so that coordinates prune
        m = 0.02 * m + 10 * np.eye(12)[rng.integers(0, 12, 1500)]
    else:
        m *= 0.002  # many ties
    rows = [(i, v) for i, v in enumerate(m.tolist())]
    df = stored(spark, tmp_path, [(*r, 0) for r in rows], SCHEMA)
    want = brute(rows)
    assert got(ip.top_products(df, df.vec_id % 100 == 0, block=200, queries=4, first=300, growth=2)) == want


def test_both_ways_of_pruning_are_used():
    rng = np.random.default_rng(5)
    near = 0.02 * rng.normal(size=(4000, 40)) + 10 * np.eye(40)[rng.integers(0, 40, 4000)]
    for m, single in ((np.floor(near * 1024), True), (np.floor(rng.normal(size=(4000, 8)) * 1024), False)):
        sizes = np.linalg.norm(m, axis=1)
        ids = np.arange(len(m))
        made = m[:40] @ m.T
        least = np.sort(made, axis=1)[:, -12]
        chosen = []
        for low in range(0, 4000, 1000):
            b = ip.Bucket(m[low : low + 1000], ids[low : low + 1000], sizes[low : low + 1000])
            chosen.append(np.isfinite(b.choose(m[:40], sizes[:40], least / (sizes[:40] * sizes[low : low + 1000].max()))))
        assert any(chosen) if single else not all(chosen)
        done = ip.best_of_block(m, ids, sizes, m[:40], ids[:40], sizes[:40], np.full(40, -np.inf), 10)
        for i in range(40):
            want = sorted((-made[i, j], j) for j in range(4000) if j != i)[:10]
            assert [(-s, j) for s, j in zip(done.scores[i].tolist(), done.ids[i].tolist())] == want


def test_odd_vectors(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(120)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(500)]  # one vector many times
    rows += [(100, [0.0] * 5), (100, [1.0, 0.0, -1.0, 2.0, 0.5]), (100, [1.0, 0.0, -1.0, 2.0, 0.5]), (7, [3.0] * 5), (7, [3.0] * 5)]
    rows += [(200, None), (300, []), (400, []), (301, []), (500, [1.0, None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 5), (700, [float("inf")] * 5)]
    rows += [(800, [1.0, 2.0]), (801, [2.0, 1.0]), (None, [9.0] * 5), (900, [-0.0, 0.0, -0.0, 0.0, 0.0])]
    df = stored(spark, tmp_path, [(*r, None) for r in rows], SCHEMA)
    assert got(asked(df)) == brute(rows)
    wide = df.withColumnRenamed("label", "block").withColumnRenamed("vec_id", "least").withColumnRenamed("embedding", "asked")
    assert got(ip.top_products(wide, wide["least"] % 100 == 0, vec_id="least", embedding="asked")) == brute(rows)


def test_large_components(spark, tmp_path):
    """Products beyond 2^53 are exact, and beyond a long they count as its end."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randrange(0, 7) for _ in range(4)]) for i in range(300)]
    rows += [(400, [3e38, 1.0, 0.0, 0.0]), (401, [3e38, -3e38, 1.0, 2.0]), (402, [-3e38, 0.0, 0.0, 0.0])]
    df = stored(spark, tmp_path, [(*r, None) for r in rows], SCHEMA)
    assert got(asked(df)) == brute(rows)


def test_few_or_no_rows(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (7, [2.0, 2.0])]
    df = stored(spark, tmp_path, [(*r, 0) for r in rows], SCHEMA)
    assert got(asked(df)) == brute(rows) != []
    assert asked(df.where("false")).count() == 0 and asked(df.where("vec_id = 0")).count() == 0 and asked(df.where("vec_id = 7")).count() == 0
