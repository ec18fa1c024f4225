import numpy as np
import pytest

from stmtflow.llm import neighbours as nn
from tests.llm.helpers import stored

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    usable = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    m, ids = np.array([v for _, v in usable]), np.array([i for i, _ in usable])
    out = {}
    for i, v in usable:
        if i % 20 == 0:
            d = np.sqrt(((m - v) ** 2).sum(axis=1))
            order = np.lexsort((ids, d))
            out[i] = [(int(ids[j]), float(d[j])) for j in order if ids[j] != i][:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("structured", [True, False])
def test_recall_and_scores(spark, tmp_path, structured):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16)) * (4 if structured else 0)
    rows = [(i, (centre[i % 40] + rng.normal(size=16)).tolist()) for i in range(6000)]
    df = stored(spark, tmp_path, [(*r, 0) for r in rows], SCHEMA)
    got, want = answers(nn.search(df, df.vec_id % 20 == 0, least=100, sample=2000)), brute(rows, 10)
    assert got.keys() == want.keys()
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)
    exact = {(q, i): s for q, near in brute(rows, 6000).items() for i, s in near} if structured else {}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        for i, s in near:
            assert not exact or s == pytest.approx(exact[q, i], abs=1e-12)


def test_odd_vectors_ties_and_hot_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(120)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(700)]  # one vector many times
    rows += [(2000, None), (2020, []), (2040, [0.0] * 5), (2060, [1.0, None, 1.0, 1.0, 1.0]), (2080, [float("nan")] * 5),
             (2100, [float("inf")] * 5), (2120, [1.0, 2.0]), (None, [1.0] * 5), (2140, [1e15, 0.0, 0.0, 0.0, 1.0])]
    df = stored(spark, tmp_path, [(*r, None) for r in rows], SCHEMA)
    got = answers(nn.search(df, df.vec_id % 20 == 0, least=10**6, centroids=4))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 5], 10)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]


def test_blocks_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nn, "QUERY_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(800)]
    df = stored(spark, tmp_path, [(*r, 0) for r in rows], SCHEMA)
    got, want = answers(nn.search(df, df.vec_id % 20 == 0, least=10**6, centroids=3)), brute(rows, 10)
    assert {q: [i for i, _ in n] for q, n in got.items()} == {q: [i for i, _ in n] for q, n in want.items()}


def test_few_or_no_rows(spark, tmp_path):
    df = stored(spark, tmp_path, [(0, [1.0, 2.0], 0), (7, [2.0, 2.0], 0), (7, [2.0, 2.0], 0)], SCHEMA)
    assert answers(nn.search(df, df.vec_id % 20 == 0)) == {0: [(7, 1.0), (7, 1.0)]}
    assert nn.search(df.where("false"), df.vec_id % 20 == 0).count() == 0
    assert nn.search(df.where("vec_id = 0"), df.vec_id % 20 == 0).count() == 0
    wide = df.withColumnRenamed("label", "cell").withColumnRenamed("vec_id", "bin").withColumnRenamed("embedding", "v")
    assert nn.search(wide, wide["bin"] % 20 == 0, vec_id="bin", embedding="v").count() == 2


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(4)
    a, b = rng.random(7), rng.random(5)
    cells = nn.walk(a, b, {i: 1 for i in range(35)}, 35)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)
