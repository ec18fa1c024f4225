import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stmtflow.llm import language_model as lm
from stmtflow.llm import quality_classifier as qc
from stmtflow.llm import queries
from tests.llm.helpers import DOC, odd_rows, stored

FOLDER = "/root/testdata/sf0.01"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def held(doc_id, folds, rest):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == rest


@pytest.mark.parametrize("dictionary", [10, 1 << 17])
def test_base_scores_are_exact(spark, tmp_path, monkeypatch, dictionary):
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    monkeypatch.setattr(lm, "FREQUENT", 6)
    monkeypatch.setattr(lm, "HELD", 20)
    rows = odd_rows([(50 + i, f"New Words n{i} n{i % 3}", "en", "a", 1) for i in range(40)])
    stored(spark, tmp_path, [(*r, 1.0) for r in rows], DOC + ", score double")
    got = queries.op6_language_model(spark, str(tmp_path)).collect()
    count = Counter(w for r in rows if not held(r[0], 7, 2) for w in words(r[1]))
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        w = words(r[1])
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want.append((r[0] or -1, held(r[0], 7, 2), len(w), sum(count[x] > 0 for x in w), n, round(base, 6)))
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = {}
    for r in got:  # equal texts have equal scores
        same.setdefault((r.n_tokens, round(r.base_score, 9)), set()).add(round(r.score, 6))


def test_language_model_is_a_distribution_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    counts = lm.word_counts(docs, "text")
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    common = counts.orderBy(F.desc("n"), "word").limit(4000).toArrow()
    v = lm.Vocabulary(common.column("word").to_pylist(), common.column("n").to_numpy(), total, distinct)
    histories = lm.history_counts(docs, "text", v)
    by_class, by_word = lm.train_classes(histories), lm.train_words(histories, v)
    assert np.allclose(np.exp(by_class.astype(float)).sum(axis=1), 1, atol=1e-4)
    for previous in (0, 17, 255):
        p = np.exp(by_class[previous * lm.SKIP + 3].astype(float))[v.classes] * np.exp(by_word[previous].astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    scored = queries.op6_language_model(spark, FOLDER)
    n, base, score = scored.where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert score / n > base / n + 0.05


def test_language_model_of_nothing(spark, tmp_path):
    docs = stored(spark, tmp_path, odd_rows())
    assert lm.score(docs.where("false"), F.lit(False)).count() == 0
    unseen = lm.score(docs, F.lit(True)).collect()  # no training rows at all
    assert len(unseen) == docs.count() and {r.n_known for r in unseen} == {0} and {r.train_tokens for r in unseen} == {0}


def test_learns_word_order(spark, tmp_path):
    rows = [(i, "red green blue " * 30, "en", "a", 0) for i in range(200)] + [(1000, "red green blue " * 5, "en", "a", 0), (1001, "blue green red " * 5, "en", "a", 0)]
    docs = stored(spark, tmp_path, rows)
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") >= 1000).where("held_out").collect()}
    assert got[1000].base_score == pytest.approx(got[1001].base_score) and got[1000].score > got[1001].score + 5


def test_classifier_on_held_out_labels(spark):
    got = queries.op7_quality_classifier(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(r.predicted for r in bad) <= 0.15 * len(bad)
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (qc.classify(docs, x, fold).orderBy("doc_id").collect() for x in (labels, flipped))
    assert [r.doc_id for r in a] == [r.doc_id for r in b] and np.allclose([r.score for r in a], [r.score for r in b], atol=1e-6)


def test_classifier_on_odd_rows(spark, tmp_path):
    docs = stored(spark, tmp_path, [(*r, 0.1) for r in odd_rows()], DOC + ", score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (6, 1), (8, 0), (None, 1), (99, None)], "doc_id long, quality int")
    out = qc.classify(docs, labels, F.col("doc_id") == 7).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    none = qc.classify(docs, labels.where("quality = 0"), F.lit(False)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert qc.classify(docs.where("false"), labels.where("false"), F.lit(False)).count() == 0


def test_risk_gradient_matches_differences():
    rng = np.random.default_rng(0)
    f, y = rng.random((50, qc.WIDTH)), rng.random(50) < 0.3
    model = qc.Model(f.mean(axis=0), f.std(axis=0), rng.normal(size=qc.WIDTH + 1) * 0.1)
    prior = 0.4

    def risk(w):
        g = model.inputs(f) @ w
        loss = lambda z: np.log1p(np.exp(-z))
        return prior * loss(g[y]).mean() + loss(-g).mean() - prior * loss(-g[y]).mean()

    x, p = model.inputs(f), model.scores(f)
    gradient = p @ x / 50 - prior * x[y].mean(axis=0)
    step = np.zeros(qc.WIDTH + 1)
    step[5] = 1e-5
    w = model.weights
    assert (risk(w + step) - risk(w - step)) / 2e-5 == pytest.approx(gradient[5], abs=1e-6)


@pytest.mark.parametrize("dictionary, head", [(1 << 17, 1024), (1 << 17, 3), (8, 3), (0, 3)])
def test_every_pair_of_words_counts(spark, tmp_path, monkeypatch, dictionary, head):
    """Scores beside plain counting: the hashed model as a start, and the counts of all pairs, common, rare or new."""
    monkeypatch.setattr(lm, "DICTIONARY", dictionary)
    monkeypatch.setattr(lm, "FREQUENT", 6)
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "PART", 300)
    monkeypatch.setattr(lm, "CHUNK_TEXTS", 7)
    rows = odd_rows([(50 + i, f"New Words n{i} n{i % 3} words n{i % 7}", "en", "a", 1) for i in range(40)])
    docs = stored(spark, tmp_path, rows)
    got = lm.score(docs, F.col("doc_id") % 5 == 2).collect()
    train = [words(r[1]) for r in rows if r[0] is None or r[0] % 5 != 2]
    count, pair = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    fold = docs.where("coalesce(doc_id % 5, 0) <> 2")
    common = sorted(count, key=lambda w: (-count[w], w.encode()))[:dictionary]
    v = lm.Vocabulary([w.encode() for w in common], np.array([count[w] for w in common], dtype=np.int64), sum(count.values()), len(count))
    histories = lm.history_counts(fold, "text", v)
    by_class, by_word = lm.train_classes(histories), lm.train_words(histories, v)

    def plain(text):
        t = words(text)
        number = v.numbers([w.encode() for w in t])
        outcome = v.outcomes(number)
        one, two = v.histories(outcome)
        total = 0
        for i, w in enumerate(t):
            before = t[i - 1] if i else None
            start = math.exp(by_class[one[i] * lm.SKIP + two[i], v.classes[outcome[i]]] + by_word[one[i], outcome[i]])
            if outcome[i] == v.frequent:
                start *= (count[w] + 1) / v.rest_size
            seen = count[before] if i else len(train)
            total += math.log10((pair[before, w] + lm.SAMPLE * start) / (seen + lm.SAMPLE))
        return total

    want = sorted((r[0] or -1, plain(r[1])) for r in rows)
    have = sorted((r.doc_id or -1, r.score) for r in got)
    assert [d for d, _ in have] == [d for d, _ in want] and np.allclose([x for _, x in have], [x for _, x in want], atol=1e-4)


def test_pairs_beyond_the_slots_are_told_apart(spark, tmp_path):
    """Thousands of equally common words, so that many share each hashed history: what follows a word is learnt of that word."""
    rows = [(i, " ".join(f"w{j}" for k in range(20) for j in ((i * 7 + k * 31) % 3000, (i * 7 + k * 31) % 3000 + 3000)), "en", "a", 0) for i in range(1500)]
    texts = [" ".join(f"w{j}" for k in range(20) for j in ((k * 131) % 3000, (k * 131 + shift) % 3000 + 3000)) for shift in (0, 1)]
    docs = stored(spark, tmp_path, [*rows, *((10_000 + i, t, "en", "a", 0) for i, t in enumerate(texts))])
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") >= 10_000).where("held_out").collect()}
    assert got[10_000].score > got[10_001].score + 10
