"""Exact top-k by inner product, over entries in buckets of like length.

An entry can only enter a query's answer if its length times the query's reaches the query's k-th score so far, and
inside a bucket (whose longest entry has length l) if its cosine to the query reaches ``threshold / (l * |query|)``,
the bucket's local threshold. Entries are ranged by falling length into blocks, and a task cuts its block into buckets.
Per bucket it looks at a few of its queries and decides from which local threshold on coordinates prune better than
lengths:

* **length**: the entries of the bucket long enough for the query, multiplied as one matrix;
* **coordinate**: with an angle g to spare (the threshold is its cosine), the entry's direction must lie within g of the
  query's in each coordinate alone, so only a span of the entries sorted by one of the query's largest coordinates is left,
  thinned by the next ones.

What is left is multiplied out, so the result is exact. Blocks go in rounds, the longest entries first and each round 16 times as large
as all before: the k-th score after a round prunes blocks, buckets and entries of the next, and few results of a block can still
count. A query meets a block in one task of at most ``BLOCK`` entries and about ``QUERIES`` queries. The
state between rounds, k rows a query, is a written table. Only one number per block goes through the driver.

Components are turned into ``floor(scale * x)``. Products are sums of integers below 2^53 in double precision where the
lengths allow nothing larger, and of Python's integers otherwise.

Defined results: vectors null or with null or non-finite components (also after scaling), and rows without an id,
take no part; zero vectors do; vectors meet those of the same number of components, empty ones with product 0; scores
beyond the range of a long count as its ends; ties go to the smaller id; rows that share an id are entries of their own but no answer to a
query of that id, a query row that is repeated is asked once, and different vectors under one id are queries of their
own, each with its ranks; fewer entries than ``k`` give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.session import cut_lineage

SCALE = 1024
BLOCK, QUERIES, BUCKET = 32_768, 16_384, 1024
#: Entries of the first round, and how much larger than all before each later one is.
FIRST, GROWTH = 16_384, 16
#: Queries looked at per bucket, coordinates looked at per query, and what an entry picked singly costs in entries of a matrix.
TRIED, FOCUS, PICKED = 16, 3, 8
SLACK = 1e-9
EXACT = 2.0**52
LONG = np.iinfo(np.int64)


def quantised(scale: int):
    """Batches of (vec_id, asked, embedding) as (vec_id, asked, length, x) without the rows that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, asked, vectors = (b.column(i) for i in range(3))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.empty(0, np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(flat * scale) + 0.0
                square = np.minimum(x * x, np.finfo(np.float64).max)
            ends = np.cumsum(sizes)
            sound = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (sound[ends] == sound[ends - sizes]) & ~vectors.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(good)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(x)).take(pa.array(rows))
            with np.errstate(over="ignore"):
                sums = [float(square[ends[i] - sizes[i] : ends[i]].sum()) for i in rows.tolist()]
            length = np.minimum(np.sqrt(sums), 1e308) if sums else np.empty(0)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([ids.take(at), asked.take(at), pa.array(length, pa.float64()), lists], names=["vec_id", "asked", "length", "x"])

    return run


def products(queries: np.ndarray, entries: np.ndarray, most: float) -> np.ndarray:
    """All inner products, exact; ``most`` is the greatest product of two lengths."""
    if most < EXACT:
        return queries @ entries.T
    whole = [[[int(c) for c in row] for row in m.tolist()] for m in (queries, entries)]
    return np.array(
        [[min(max(sum(a * b for a, b in zip(q, e, strict=True)), LONG.min), LONG.max) for e in whole[1]] for q in whole[0]], dtype=np.int64
    ).reshape(len(queries), len(entries))


class Bucket:
    """Entries of like length, the longest first, with their directions sorted by coordinate where that is asked for."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, length: np.ndarray):
        self.x, self.ids, self.length = x, ids, length
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.direction: np.ndarray | None = None
        self.switch: float | None = None

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if self.direction is None:
            self.direction = self.x / np.where(self.length > 0, self.length, 1)[:, None]
        if f not in self.sorted:
            order = np.argsort(self.direction[:, f], kind="stable")
            self.sorted[f] = order, self.direction[order, f]
        return self.sorted[f]

    def spans(self, query: np.ndarray, size: float, local: float) -> list[tuple[int, int, int, float, float]]:
        """For the query's largest coordinates the span of entries within reach: entries, from, coordinate, lowest, highest."""
        unit = query / size
        spare = np.arccos(min(local, 1.0)) + SLACK
        out = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + spare)) - SLACK, np.cos(max(0.0, angle - spare)) + SLACK
            values = self.by_coordinate(f)[1]
            start, stop = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            out.append((int(stop - start), int(start), f, low, high))
        return sorted(out)

    def picked(self, query: np.ndarray, size: float, local: float) -> np.ndarray:
        """Places of the entries that no looked-at coordinate rules out."""
        (count, start, f, *_), *others = self.spans(query, size, local)
        at = self.by_coordinate(f)[0][start : start + count]
        for _, _, g, low, high in others:
            at = at[(self.direction[at, g] >= low) & (self.direction[at, g] <= high)]
        return at

    def choose(self, queries: np.ndarray, sizes: np.ndarray, local: np.ndarray) -> float:
        """The local threshold from which on coordinates leave so few entries that picking them singly pays."""
        if self.switch is None:
            tried = np.flatnonzero(local > 0)
            tried = tried[np.argsort(-local[tried], kind="stable")][:: max(1, len(tried) // TRIED)]
            self.switch = np.inf
            for i in tried.tolist():
                if self.spans(queries[i], sizes[i], local[i])[0][0] * PICKED > len(self.ids):
                    break
                self.switch = local[i]
        return self.switch


class Answers:
    """The best of each query so far: at most k (score, id), and the score to reach."""

    def __init__(self, own: np.ndarray, least: np.ndarray, k: int):
        self.own, self.least, self.k = own, least.copy(), k
        self.scores = [np.empty(0, np.int64) for _ in own]
        self.ids = [np.empty(0, np.int64) for _ in own]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.least[i]) & (ids != self.own[i])
        if not ok.any():
            return
        scores = np.concatenate([self.scores[i], scores[ok].astype(np.int64)])
        ids = np.concatenate([self.ids[i], ids[ok]])
        order = np.lexsort((ids, -scores.astype(object) if scores.min() == LONG.min else -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], float(scores[order[-1]]))


def best_of_block(
    entries: np.ndarray, ids: np.ndarray, length: np.ndarray, queries: np.ndarray, own: np.ndarray, sizes: np.ndarray, least: np.ndarray,
    k: int, bucket: int = BUCKET,
) -> Answers:
    """Answers of the queries among the entries; ``least`` is each query's k-th score so far, -inf without one."""
    order = np.lexsort((ids, -length))
    entries, ids, length = entries[order], ids[order], length[order]
    answers = Answers(own, least, k)
    for start in range(0, len(ids), bucket):
        part = slice(start, start + bucket)
        b = Bucket(entries[part], ids[part], length[part])
        top = float(b.length[0])
        alive = np.flatnonzero(answers.least <= sizes * top * (1 + SLACK))
        if not len(alive):
            break  # what follows is shorter still
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            bound = sizes[alive] * top
            local = np.where(bound > 0, answers.least[alive] / bound, -np.inf)
            needed = np.where(sizes[alive] > 0, answers.least[alive] / sizes[alive], -np.inf)
        single = (local > 0) & (local >= b.choose(queries[alive], sizes[alive], local))
        for i, t in zip(alive[single].tolist(), local[single].tolist(), strict=True):
            at = b.picked(queries[i], sizes[i], t)
            if len(at):
                answers.add(i, products(queries[i : i + 1], b.x[at], sizes[i] * top)[0], b.ids[at])
        rest, needed = alive[~single], needed[~single]
        # queries that reach about as far into the bucket share a product
        reach = np.searchsorted(-b.length, -needed * (1 - SLACK), side="right")
        for low in range(0, len(rest), 256):
            some = rest[np.argsort(reach, kind="stable")[low : low + 256]]
            far = int(np.sort(reach, kind="stable")[low : low + 256].max())
            if far:
                made = products(queries[some], b.x[:far], float(sizes[some].max()) * top)
                hits = made >= answers.least[some][:, None]
                for row in np.flatnonzero(hits.any(axis=1)).tolist():
                    at = np.flatnonzero(hits[row])
                    answers.add(int(some[row]), made[row, at], b.ids[at])
    return answers


def _by_size(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number of components to the rows that have so many, and those rows as a matrix."""
    if not len(column):
        return {}
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = rows, lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)
    return out


def _meet(k: int):
    """One block and some of the queries that it may hold answers of."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("query_id", "h", "g", "vec_id", "score")}
        entries = _by_size(left["x"])
        for d, (rows, queries) in _by_size(right["x"]).items():
            if d not in entries:
                continue
            own = {c: right[c].to_numpy()[rows] for c in ("query_id", "h", "g", "length", "least")}
            at, x = entries[d]
            done = best_of_block(
                x, left["vec_id"].to_numpy()[at], left["length"].to_numpy()[at], queries, own["query_id"], own["length"], own["least"], k
            )
            times = np.array([len(s) for s in done.scores])
            for c in ("query_id", "h", "g"):
                out[c].append(np.repeat(own[c], times))
            out["vec_id"] += done.ids
            out["score"] += done.scores
        return pa.table({c: np.concatenate([np.empty(0, np.int64), *parts]) for c, parts in out.items()})

    return run


def top_products(
    vectors: DataFrame, is_query: Column, *, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE,
    block: int = BLOCK, queries: int = QUERIES, first: int = FIRST, growth: int = GROWTH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest products of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(embedding).alias("x")
    ).mapInArrow(quantised(scale), "vec_id bigint, asked boolean, length double, x array<double>")
    rows = cut_lineage(rows)
    total = rows.count()
    # small tables still give every core a block; this and the number of rounds change the cost, not the result
    blocks = max(1, -(-total // block), min(spark.sparkContext.defaultParallelism, total // 1024))
    # equal lengths spread by a seeded draw, which a task that runs again repeats on the same rows of the table
    ranged = rows.repartitionByRange(blocks, F.col("length").desc(), F.rand(13)).withColumn("block", F.spark_partition_id())
    entries = cut_lineage(ranged)
    # two numbers per block
    held = sorted((r.block, r.top, r.n) for r in entries.groupBy("block").agg(F.max("length").alias("top"), F.count("*").alias("n")).collect())
    asked = entries.where("asked").select(F.col("vec_id").alias("query_id"), "length", "x").distinct()
    # a query is known by its id and 128 bits of its vector
    asked = cut_lineage(asked.withColumns({"h": F.xxhash64("x"), "g": F.xxhash64(F.lit(13), "x")}))
    lots = max(1, -(-asked.count() // queries))
    key = ["query_id", "h", "g"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))
    best = spark.createDataFrame([], "query_id bigint, h bigint, g bigint, vec_id bigint, score bigint, rank int")
    start = done = 0
    while start < len(held):
        stop, size = start, 0
        while stop < len(held) and size < max(first, done * growth):
            size += held[stop][2]
            stop += 1
        done += size
        numbers, tops = (np.array(c) for c in zip(*[(b, top) for b, top, _ in held[start:stop]], strict=True))

        def visits(batches: Iterator[pa.RecordBatch], numbers: np.ndarray = numbers, tops: np.ndarray = tops) -> Iterator[pa.RecordBatch]:
            """Each query once per block that may hold an answer; blocks come with falling lengths."""
            for b in batches:
                at, to = [], []
                for i, (size, least) in enumerate(zip(b["length"].to_numpy(), b["least"].to_numpy(), strict=True)):
                    near = np.flatnonzero(size * tops * (1 + SLACK) >= least)
                    at.append(np.full(len(near), i))
                    to.append(numbers[near])
                where = pa.array(np.concatenate([np.empty(0, np.int64), *at]).astype(np.int64))
                block = pa.array(np.concatenate([np.empty(0, np.int32), *to]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[c.take(where) for c in b.columns], block], names=[*b.schema.names, "in_block"])

        least = best.where(F.col("rank") == k).select(*key, F.col("score").cast("double").alias("least"))
        known = asked.join(least, key, "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        sent = known.mapInArrow(visits, "query_id bigint, h bigint, g bigint, length double, x array<double>, least double, in_block int")
        sent = sent.withColumn("lot", F.pmod(F.col("g"), F.lit(lots)).cast("int"))
        part = entries.where(F.col("block").between(held[start][0], held[stop - 1][0])).select(
            "block", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("of_lot"), "vec_id", "length", "x"
        )
        found = part.groupBy("block", "of_lot").cogroup(sent.groupBy("in_block", "lot")).applyInArrow(
            _meet(k), "query_id bigint, h bigint, g bigint, vec_id bigint, score bigint"
        )
        merged = best.drop("rank").unionByName(found).withColumn("rank", place).where(F.col("rank") <= k)
        best = cut_lineage(merged)
        start = stop
    return best.select("query_id", "rank", "vec_id", "score")
