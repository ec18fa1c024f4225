"""Approximate nearest neighbours with an inverted multi-index.

A vector's two halves are quantised separately, each with ``centroids`` centroids, so an entry lies in one of
centroids^2 cells. A query sorts the centroids of each half by distance and walks the pairs by summed distance with a
heap (the multi-sequence walk) until the cells it has passed hold a share of all entries; the entries of those
cells are reranked by the exact distance on the original vectors.

Centroids are fitted on a documented sample of ``SAMPLE`` vectors, and the share is measured on it: the smallest with
which the walk over the sample finds ``RECALL`` of the sample's true neighbours (a larger table needs a smaller
share, so this errs on the safe side). Vectors with structure need a few hundredths, random ones nearly half. Every
vector is indexed. Entries are kept by the first half's centroid in blocks of bounded size, dealt by hash, so a cell
with a third of all entries has many tasks, and the queries of a block are dealt likewise: a group has about
``BLOCK_ROWS`` entries and ``QUERY_ROWS`` queries, whatever the data.

Defined results: vectors that are null, zero, of another length than most of the sample, or that hold null or
non-finite components take no part; ties go to the smaller id; rows that share an id are candidates of their
own, but none of them is a candidate of a query with that id, and equal rows are asked once; fewer candidates than ``k`` give fewer rows; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, CENTROIDS, ROUNDS = 16_384, 32, 10
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Aimed at on the sample, with so many of its vectors as queries; no query reads fewer entries than LEAST.
RECALL, PROBES, LEAST = 0.95, 256, 2048


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(sample: np.ndarray, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 10) -> np.ndarray:
    """Centroids of one half by Lloyd's rounds from seeded distinct rows; an empty centroid moves to a far row."""
    rows = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centre = rows[rng.permutation(len(rows))[: min(centroids, len(rows))]].copy()
    for _ in range(rounds):
        apart = distances(rows, centre)
        nearest = apart.argmin(axis=1)
        for c in range(len(centre)):
            own = rows[nearest == c]
            centre[c] = own.mean(axis=0) if len(own) else rows[apart.min(axis=1).argmax()]
    return centre


def distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return (rows**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1)[None, :] - 2 * rows @ centre.T


def walk(first: np.ndarray, second: np.ndarray, sizes: dict[int, int], wanted: int) -> list[int]:
    """Cells in order of summed half distances until they hold ``wanted`` entries; empty cells are passed over."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    heap, seen, found, cells = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * len(b) + b[j]
        if cell in sizes:
            cells.append(cell)
            found += sizes[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return cells


def nearest_of(query: np.ndarray, entries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest entries, nearest first, ties to the smaller id."""
    rough = distances(query[None, :], entries)[0]
    if len(ids) > k:  # the product formula rounds; whatever may belong to the k is computed exactly
        limit = np.partition(rough, k - 1)[k - 1]
        close = np.flatnonzero(rough <= limit + 1e-9 * ((query**2).sum() + abs(limit)))
        entries, ids = entries[close], ids[close]
    exact = np.sqrt(((entries - query) ** 2).sum(axis=1))
    order = np.lexsort((ids, exact))[:k]
    return ids[order], exact[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Index:
    """Centroids of both halves, and the share of entries that a walk has to pass."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, recall: float = RECALL, k: int = 10):
        self.half = (sample.shape[1] + 1) // 2
        rest = sample[:, self.half :]
        self.first = fit(sample[:, : self.half], centroids)
        self.second = fit(rest, centroids) if rest.shape[1] else np.zeros((1, 0))
        self.share = self._share(sample, recall, k)

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(rows[:, : self.half], self.first), distances(rows[:, self.half :], self.second)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        one, two = self.halves(rows)
        return one.argmin(axis=1) * len(self.second) + two.argmin(axis=1)

    def _share(self, sample: np.ndarray, recall: float, k: int) -> float:
        probes = sample[:: max(1, len(sample) // PROBES)]
        cells = self.cells(sample)
        sizes = dict(Counter(cells.tolist()))
        apart = distances(probes, sample)
        needed: list[float] = []
        for i, (one, two) in enumerate(zip(*self.halves(probes), strict=True)):
            order = walk(one, two, sizes, len(sample))
            passed = dict(zip(order, np.cumsum([sizes[c] for c in order]) / len(sample), strict=True))
            # the probe itself is its first neighbour
            needed += [passed[c] for c in cells[np.argsort(apart[i], kind="stable")[1 : k + 1]].tolist()]
        return float(np.quantile(needed, recall)) if needed else 1.0


def search(
    vectors: DataFrame, is_query: Column, *, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    sample: int = SAMPLE, centroids: int = CENTROIDS, recall: float = RECALL, least: int = LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    kind = vectors.schema[embedding].dataType.simpleString()
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    # a uniform sample of fixed size: the rows whose hash is smallest
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(10)), "vec_id", "v").limit(sample).select("v").toArrow().column("v")
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = Counter(len(v) for v in drawn)
    size = max(lengths, key=lambda n: (lengths[n], n))
    index = Index(np.array([v.as_py() for v in drawn if len(v) == size], dtype=np.float64), centroids, recall, k)
    width = len(index.second)
    rows = rows.where(F.size("v") == size)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = pa.array(index.cells(_matrix(b.column(1))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cell], ["vec_id", "v", "cell"])

    entries = rows.select("vec_id", "v").mapInArrow(quantise, f"vec_id long, v {kind}, cell int")
    # one number per cell: at most centroids^2
    sizes = {r.cell: r["count"] for r in entries.groupBy("cell").count().collect()}
    wanted = max(least, int(np.ceil(index.share * sum(sizes.values()))))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, bins, cells = [], [], []
            for i, (one, two) in enumerate(zip(*index.halves(_matrix(b.column(1))), strict=True) if b.num_rows else ()):
                by_bin: dict[int, list[int]] = {}
                for cell in walk(one, two, sizes, wanted):
                    by_bin.setdefault(cell // width, []).append(cell)
                of += [i] * len(by_bin)
                bins += by_bin
                cells += by_bin.values()
            at = pa.array(of, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(bins, type=pa.int32()), pa.array(cells, type=pa.list_(pa.int32()))],
                ["query_id", "v", "bin", "cells"],
            )

    asked = rows.where("q").select("vec_id", "v").distinct()
    visits = asked.mapInArrow(visit, f"query_id long, v {kind}, bin int, cells array<int>")
    # one number per centroid of the first half
    visited = {r.bin: r["count"] for r in visits.groupBy("bin").count().collect()}
    held = Counter()
    for cell, n in sizes.items():
        held[cell // width] += n
    plan = [(b, -(-held[b] // BLOCK_ROWS), -(-n // QUERY_ROWS)) for b, n in sorted(visited.items())]
    deal = F.broadcast(spark.createDataFrame(plan, "bin int, blocks int, lots int"))  # at most ``centroids`` rows
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = entries.withColumn("bin", F.floor(F.col("cell") / width).cast("int")).join(deal, "bin").select(
        "bin", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), each("lots").alias("lot"), "vec_id", "v", "cell"
    )
    dealt_queries = visits.join(deal, "bin").select(
        "bin", each("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int").alias("lot"),
        "query_id", "v", "cells",
    )

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        owners, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            keys, cells = left.column("vec_id").to_numpy(), left.column("cell").to_numpy()
            m = _matrix(left.column("v").combine_chunks())
            for batch in right.to_batches(max_chunksize=128):
                for i, (own, vector, chosen) in enumerate(zip(
                    batch.column("query_id").to_pylist(), _matrix(batch.column("v")), batch.column("cells").to_pylist(), strict=True
                )):
                    inside = np.flatnonzero(np.isin(cells, chosen) & (keys != own))
                    near, apart = nearest_of(vector, m[inside], keys[inside], k)
                    owners.append(np.full(len(near), own))
                    ids.append(near)
                    scores.append(apart)
        merge = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"query_id": merge(owners, np.int64), "vec_id": merge(ids, np.int64), "score": merge(scores, np.float64)})

    keys = ["bin", "block", "lot"]
    partial = dealt.groupBy(*keys).cogroup(dealt_queries.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    # k rows of each block that a query met; their best are its answer
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return partial.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
