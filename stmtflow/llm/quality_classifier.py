"""Quality classifier from positives and unlabelled text (non-negative positive-unlabelled learning).

Trusted positives are the documents labelled good in the training fold; everything else in that fold is unlabelled web
text, whose own labels are never looked at as classes. With the class prior pi, the risk of a classifier is

    pi * R_P(good) + max(0, R_U(bad) - pi * R_P(bad))

and with the logistic loss of a linear score its unbiased part is convex, with gradient mean_U(p * x) - pi * mean_P(x).
Newton steps minimise it; each step is one Spark job over the features that adds up gradient and Hessian, so all
documents of the fold take part. When the estimated risk on negatives would turn negative (the sign of
overfitting that the non-negative risk guards against), the step is halved, and then dropped. The prior is estimated as
the share of good ones among the labelled rows of the training fold.

Features are measures of the text alone: lengths, repetition, capitals, symbols, compressibility.

Defined results: null text counts as empty and is scored like any text; a document that is labelled good and bad
counts as not good; without any positive every score is 0.5; repeated rows are scored alike; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.session import cut_lineage

STEPS, RIDGE = 16, 1e-2
#: A step of Newton's method moves the score of no document by more than this on average.
LONGEST = 4.0
_SYMBOLS = frozenset("#*$%&|<>!?@^~_=+{}[]\\/")


def features(text: str) -> list[float]:
    """Measures of one text; each between 0 and about 10, continuous in the text."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    by_char = Counter(text)
    of = lambda test: sum(c for ch, c in by_char.items() if test(ch))
    raw = text.encode("utf-8", "replace")
    lengths = [len(w) for w in words]
    pairs = set(zip(lower, lower[1:], strict=False))
    base = [
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(pairs) / max(1, n - 1),
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        of(str.isupper) / letters,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        of(str.isdigit) / letters,
        of(_SYMBOLS.__contains__) / letters,
        by_char["!"] / n,
        (by_char["."] + by_char[","]) / n,
        of(lambda ch: not ch.isascii()) / letters,
        len(zlib.compress(raw, 1)) / max(16, len(raw)),
        letters / n / 5,
        max(lengths, default=0) / 50,
        sum(x <= 2 for x in lengths) / n,
        math.log1p(len(words)) / 5,
        math.log1p(size / max(1, len(lines))) / 5,
    ]
    return base + [x * x for x in base] + [math.sqrt(x) for x in base]


WIDTH = len(features(""))


def featurised(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, f): features of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [features(value.as_py() or "") for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, type=pa.list_(pa.float32()))], ["doc_id", "f"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, f array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)


def _added_up(rows: DataFrame, part) -> np.ndarray:
    """Sum over all rows of the vectors that ``part`` makes of (features, is positive); of fixed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = part(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    sums = rows.select("f", "positive").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(sums))
    for r in sums:
        out[r.i] = r.v
    return out


class Model:
    """Linear score on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -8, 8)
        return np.hstack([x, np.ones((len(f), 1))])

    def scores(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(f) @ self.weights, -40, 40)))


def train(rows: DataFrame, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Minimises the non-negative risk over ``rows`` (f, positive: labelled good)."""
    d = WIDTH + 1
    sums = _added_up(rows, lambda f, y: np.concatenate([[len(f), y.sum()], f.sum(axis=0), (f**2).sum(axis=0)]))
    blank = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(d))
    if not len(sums) or sums[1] == 0:
        return blank
    n, positives = sums[0], sums[1]
    mean = sums[2 : 2 + WIDTH] / n
    scale = np.sqrt(np.maximum(sums[2 + WIDTH :] / n - mean**2, 1e-12)) + 1e-6
    model = Model(mean, scale, np.zeros(d))

    def pieces(f: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, p = model.inputs(f), model.scores(f)
        y = y.astype(bool)
        loss = -np.log(np.maximum(1 - p, 1e-12))
        hessian = (x * (p * (1 - p))[:, None]).T @ x
        return np.concatenate([[loss.sum(), loss[y].sum()], p @ x, x[y].sum(axis=0), hessian.ravel()])

    kept, step = model.weights, None
    for _ in range(steps):
        s = _added_up(rows, pieces)
        if s[0] / n - prior * s[1] / positives < 0 and step is not None:
            # the estimated risk on negatives is below zero: the step has gone too far
            step = step / 2
            if np.abs(step).max() < 1e-2:
                break
            model = Model(mean, scale, kept - step)
            continue
        kept = model.weights
        gradient = s[2 : 2 + d] / n - prior * s[2 + d : 2 + 2 * d] / positives + ridge * kept
        step = np.linalg.solve(s[2 + 2 * d :].reshape(d, d) / n + ridge * np.eye(d), gradient)
        step *= min(1.0, LONGEST / (np.linalg.norm(step) + 1e-12))
        model = Model(mean, scale, kept - step)
        if np.abs(step).max() < 1e-3:
            break
    return Model(mean, scale, kept)


def classify(
    docs: DataFrame, labels: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; labels of held-out rows are never used.

    ``held_out`` is a condition on the column ``doc_id``.
    """
    # read by every step, and small beside the texts
    rows = cut_lineage(featurised(docs, doc_id, text).withColumn("held_out", F.coalesce(held_out, F.lit(False))))
    known = (
        labels.where(F.col(quality).isNotNull()).groupBy("doc_id").agg(F.min(quality).alias("_q"))
        .where(~F.coalesce(held_out, F.lit(False))).withColumnRenamed("doc_id", "_id")
    )
    good, total = known.agg(F.count_if(F.col("_q") == 1), F.count(F.lit(1))).first()
    prior = (good + 1) / (total + 2)
    fold = rows.where("not held_out").join(known.where("_q = 1"), F.col("doc_id") == F.col("_id"), "left")
    fold = cut_lineage(fold.select("f", F.col("_id").isNotNull().alias("positive")))
    model = train(fold, prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(_matrix(batch.column(2))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.select("doc_id", "held_out", "f").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
