"""Exact Jaccard join of word shingles in metric space, and the groups its links form.

Texts are sets of shingles; 1 - Jaccard is a metric, and two texts link at distance ``EPS`` or less. Unrelated texts
all lie at distance 1 from every other text, so pivots that are texts cannot part them. The first pivots are
therefore the smallest sets there are: one shingle each. A text is closer than 1 to exactly the pivots it contains; its
Voronoi cell is that of the first of them in a common order, and the window that replicates it across the boundary
holds its first n - ceil(0.8 n) + 1 shingles: a text within EPS lacks too few of them to have none in common.

The common order puts shingles that many texts share last, as far as a list of fixed size can say; then comes the hash.
Any order gives the same links, this one smaller regions.

Regions are then joined exactly:

* A region of at most ``SMALL`` texts offers all its pairs whose sizes allow a link. A pair is compared if the regions in which it
  meets, and what both have beyond the last of them in the common order, can make up the overlap of a link.
* Texts of larger regions (passages or copies shared by many) are partitioned anew among themselves: first with the pivots of
  those regions last in the order, then, what is still in a large region, with the rarest shingles first, counted exactly. A
  passage then makes no region.
* What is still large holds many similar texts. Its pivot is the text that lies in most regions (the least changed copy), and
  regions of one pivot become one; all distances to it are measured; texts within EPS of it are linked through it. Of the others (outer), distance d from the pivot, only inner texts at d - EPS or more
  from it can be near (triangle inequality): the next region holds the outer texts and those boundary texts. A region
  whose texts have all become one group is done; one still open after ``ROUNDS`` further rounds of pivots meets in blocks of
  bounded size, which count what their texts share. ``ROUNDS`` is 0: the queries use one pivot for each region and do not recurse.

Equal sets are one class from the start, so copies cost one text. Results need the groups, not all pairs; no link between
different texts is lost. Shingles and sets are known by 64-bit hashes (a set also by its size); distances are counted
on whole sets that are computed again from whole texts.

Defined results: texts without words, and nulls, have no shingles and link with nothing; with fewer words than a
shingle the whole sequence is one; equal rows, and rows that share an id, are documents of their own with equal results; a null id
takes part but is no smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.llm.common import column_of, fenced, with_place
from stmtflow.session import cut_lineage, scratch

WORDS, PERCENT = 5, 80
#: Texts in a region that compares all pairs; further rounds of pivot texts; members that meet a pivot in one task.
SMALL, ROUNDS, MEMBERS = 128, 0, 4096
#: Shingles that come last in the order, at most; texts of one batch that must share a shingle to propose it.
LAST, SHARED = 1 << 18, 4
#: Texts that a task holds the shingles of at once.
HELD = 4096
#: Hashes below this are counted when shingles of hot texts are put in order; the others come last.
COUNTED = np.uint64(7 << 61)
#: Texts, and shingles, of a block of a region that no pivot could part.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
PAIR = ["key", "n", "pkey", "pn"]

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16, 2 * len(_POWERS[0]))
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word, of the lower-cased (A-Z) bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)
    inside = np.concatenate([[False], ~_GAP[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    weighted = _BYTES.take(raw)
    weighted *= power[:-1]
    np.cumsum(weighted, out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = word_hashes(text or "")
    size = min(words, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    s = h[:n] + _U(size)
    for i in range(1, size):
        s *= _BASE
        s ^= s >> _U(29)
        s += h[i : i + n]
    s = np.sort(_mix(s))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """How many first shingles of a set of ``n`` a linked set cannot all lack."""
    return n - (percent * n + 99) // 100 + 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``HELD``."""
    for batch in batches:
        for start in range(0, batch.num_rows, HELD):
            yield batch.slice(start, HELD)


def least_overlap(percent: int) -> Column:
    """Shingles that a linked pair of sizes n and pn has in common at least."""
    return F.ceil(percent * (F.col("n") + F.col("pn")) / (100 + percent))


def beyond(size: str, percent: int) -> Column:
    """Shingles of a set after its window."""
    return F.floor((percent * F.col(size) + 99) / 100) - 1


def possible(percent: int) -> Column:
    """Whether a pair can be a link that meets in ``regions`` shingles, the last at places ``at`` and ``pat`` of their orders.

    Whatever else it shares comes after both places, and after the end of the window that ends first.
    """
    after = F.least(F.col("n") - 1 - F.col("at"), F.col("pn") - 1 - F.col("pat"))
    return F.col("regions") + F.least(after, F.greatest(beyond("n", percent), beyond("pn", percent))) >= least_overlap(percent)


def _last(docs: DataFrame, words: int) -> np.ndarray:
    """The most widely shared shingles, sorted; all texts are read, and at most ``LAST`` shingles are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(0).unique()  # copies say nothing about passages
            flat = np.sort(np.concatenate([np.empty(0, np.uint64), *(shingles(value.as_py(), words) for value in texts)]))
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, int)
            n = np.diff(np.append(first, len(flat)))
            many = n >= SHARED
            yield pa.RecordBatch.from_arrays([pa.array(flat[first[many]].view(np.int64)), pa.array(n[many])], ["cell", "n"])

    proposed = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = proposed.orderBy(F.desc("n"), "cell").limit(LAST).select("cell").toArrow().column("cell").to_numpy()
    return np.sort(found.view(np.uint64))


def _window(s: np.ndarray, last: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, in the common order, that a linked set cannot all lack."""
    length = prefix_length(len(s), percent)
    if not len(last):
        return s[:length]
    at = np.searchsorted(last, s)
    at[at == len(last)] = 0
    late = last[at] == s
    early = s[~late]
    return early[:length] if len(early) >= length else np.concatenate([early, s[late]])[:length]


def _sets(docs: DataFrame, last: np.ndarray, words: int, percent: int, small: int) -> DataFrame:
    """(doc_id, place, key, n, hot, cells): the set's identity and the pivots whose windows it lies in, with their place in its order.

    A pivot that more than ``small`` sets of a batch share is large for sure: its sets are marked hot, and only so many
    of them name it as the others need to see that it is large.
    """
    late = docs.sparkSession.sparkContext.broadcast(last)  # at most 2 * ``LAST`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, sizes, cells = [], [], []
            known: set[tuple[int, int]] = set()
            for value in batch.column(2):
                s = shingles(value.as_py(), words)
                key = (int(_mix(np.array([_mix(s).sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)[0]), len(s))
                # a copy of a set of this batch says nothing new
                cells.append(_window(s, late.value, percent) if len(s) and key not in known else s[:0])
                known.add(key)
                keys.append(key[0])
                sizes.append(key[1])
            of = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
            flat = np.concatenate(cells) if cells else np.empty(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]])) if len(flat) else np.empty(0, int)
            run_sizes = np.diff(np.append(first, len(flat)))
            nth = np.arange(len(flat)) - np.repeat(first, run_sizes)
            named, large = np.ones(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
            named[order] = nth <= small
            large[order] = np.repeat(run_sizes > small, run_sizes)
            hot = np.zeros(len(cells), dtype=bool)
            hot[of[large]] = True
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of[named], minlength=len(cells)))]).astype(np.int32)
            begins = np.cumsum([0, *(len(c) for c in cells)])[:-1]
            at = np.arange(len(flat)) - begins[of]
            points = pa.StructArray.from_arrays([pa.array(flat[named].view(np.int64)), pa.array(at[named].astype(np.int32))], names=["cell", "at"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(keys, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(hot),
                    pa.ListArray.from_arrays(pa.array(offsets), points),
                ],
                ["doc_id", "place", "key", "n", "hot", "cells"],
            )

    return docs.select("doc_id", "place", "text").mapInArrow(run, "doc_id long, place string, key long, n long, hot boolean, cells array<struct<cell: long, at: int>>")


def _met(sets: DataFrame, percent: int, small: int) -> DataFrame:
    """Of the regions of ``sets``: pairs (key, n, pkey, pn, regions, at, pat) that meet in small ones, (key, n, null ...) per set of a
    large one, and (cell, -1, null, null, sets ...) per large one.

    ``regions`` counts the small ones in which a pair meets, ``at`` and ``pat`` are the last places at which it does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        large: int | None = None  # the cell at hand, if it is known to be large

        def emit(key, n, pkey, pn, at, pat) -> pa.RecordBatch:
            order = np.lexsort((pn, pkey, n, key))
            rows = np.stack([key, n, pkey, pn, at, pat])[:, order]
            first = np.flatnonzero(np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)])) if rows.size else np.empty(0, int)
            times = np.diff(np.append(first, rows.shape[1]))
            last = [np.maximum.reduceat(rows[i], first) if len(first) else rows[i] for i in (4, 5)]
            rows = rows[:, first]
            columns = [pa.array(rows[0]), pa.array(rows[1]), *(pa.array(rows[i], mask=rows[3] == 0) for i in (2, 3)), pa.array(times)]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, last)], names=["key", "n", "pkey", "pn", "regions", "at", "pat"])

        def marked(cell, key, n, _) -> pa.RecordBatch:
            key, n = np.concatenate([key, cell]), np.concatenate([n, np.full_like(n, -1)])
            return emit(key, n, *[np.zeros_like(key)] * 4)

        def regions(cell, key, n, at) -> Iterator[pa.RecordBatch]:
            new = np.ones(len(cell), dtype=bool)
            new[1:] = (cell[1:] != cell[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
            cell, key, n, at = (c[new] for c in (cell, key, n, at))
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.append(first, len(cell)))
            size = np.repeat(sizes, sizes)
            big = size > small
            if big.any():
                yield marked(cell[big], key[big], n[big], None)
            keep = (size > 1) & ~big
            cell, key, n, at = (c[keep] for c in (cell, key, n, at))
            found = []
            for k in range(1, min(small, len(cell))):
                near = cell[:-k] == cell[k:]
                if not near.any():
                    break
                i = np.flatnonzero(near & (100 * n[:-k] >= percent * n[k:]))
                found.append(np.stack([key[i], n[i], key[i + k], n[i + k], at[i], at[i + k]]))
            if found:
                yield emit(*np.concatenate(found, axis=1))

        for batch in batches:
            columns = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if large is not None:
                same = int(np.searchsorted(columns[0], large, side="right"))
                if same:
                    yield marked(*[c[:same] for c in columns])
                    columns = [c[same:] for c in columns]
            if not len(columns[0]):
                held = columns
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            if last:
                yield from regions(*[c[:last] for c in columns])
            held, large = [c[last:] for c in columns], None
            if len(np.unique(held[1])) > small:
                yield marked(*held)
                held, large = [np.empty(0, np.int64)] * 4, int(columns[0][-1])
        if len(held[0]):
            yield from regions(*held)

    cells = sets.select("key", "n", F.explode("cells").alias("c")).select("c.cell", "key", "n", F.col("c.at").cast("bigint").alias("at"))
    ordered = cells.repartition("cell").sortWithinPartitions("cell", "n", "key")
    met = ordered.mapInArrow(run, "key long, n long, pkey long, pn long, regions long, at long, pat long")
    return met.groupBy("key", "n", "pkey", "pn").agg(F.sum("regions").alias("regions"), F.max("at").alias("at"), F.max("pat").alias("pat"))


def _counted(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, n, cell, late, named): the shingles that may lie in the windows of an order by counts.

    That order has the hashes below ``COUNTED`` first, by count, and then the others by hash; so the others need not be
    counted, and a text names only as many of them as its window has room for. ``named`` is the number it names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(value.as_py(), words) for value in batch.column(2)]
            lower = [int(np.searchsorted(s, COUNTED)) for s in sets]
            sizes = [max(k, min(len(s), prefix_length(len(s), percent))) for k, s in zip(lower, sets, strict=True)]
            of = np.repeat(np.arange(len(sets)), sizes)
            flat = np.concatenate([np.empty(0, np.uint64), *(s[:k] for s, k in zip(sets, sizes, strict=True))])
            late = flat >= COUNTED
            at, named = pa.array(of), np.array(sizes, dtype=np.int64)[of]
            whole = pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(flat.view(np.int64)), pa.array(late), pa.array(named)],
                ["key", "n", "cell", "late", "named"],
            )
            for start in range(0, whole.num_rows, 1 << 18):
                yield whole.slice(start, 1 << 18)

    return texts.select("key", "n", "text").mapInArrow(run, "key long, n long, cell long, late boolean, named long")


def _rarest_first(counted: DataFrame, percent: int) -> DataFrame:
    """(cell, key, n, at, places): the windows of texts among themselves in the order of :func:`_counted`.

    Shingles of a single text come before others of their part and have no region. ``at`` is a place in that order that a
    shingle has at least, ``places`` counts a text's regions.
    """
    shared = counted.groupBy("cell").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    known = counted.join(shared, "cell")
    own = Window.partitionBy("key", "n")
    upper_by_hash = F.when(F.col("late"), F.lit(0)).otherwise(F.col("texts"))
    first = F.row_number().over(own.orderBy("late", upper_by_hash, "cell"))
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    left = length - (F.col("named") - F.count(F.lit(1)).over(own))
    held = known.withColumns({"_first": first, "_left": left, "_all": F.count(F.lit(1)).over(own)}).where("_first <= _left")
    return held.select("cell", "key", "n", (F.col("_first") - 1).cast("bigint").alias("at"), F.least("_left", "_all").alias("places"))


def _measured(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(key, n, pkey, pn, common): shingles in common of each pair, counted on both whole sets.

    The text of ``pkey`` is read first and met by its members in turn, so nothing is collected; a pivot with more than
    ``MEMBERS`` members is copied to several tasks.
    """
    pivots = pairs.groupBy("pkey", "pn").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    parts = pairs.join(pivots, ["pkey", "pn"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    heads = pivots.select(
        "pkey", "pn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"),
        F.col("pkey").alias("key"), F.col("pn").alias("n"),
    )
    asked = parts.select("pkey", "pn", "part", F.lit(1).alias("role"), "key", "n").unionByName(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, np.uint64)
        for batch in batches:
            roles = batch.column(3).to_numpy()
            common = np.zeros(len(roles), dtype=np.int64)
            for i, value in enumerate(batch.column(6)):
                own = shingles(value.as_py(), words)
                if roles[i] == 0:
                    pivot = own
                else:
                    at = np.searchsorted(pivot, own)
                    at[at == len(pivot)] = 0
                    common[i] = int((pivot[at] == own).sum()) if len(pivot) else 0
            member = pa.array(roles == 1)
            done = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (4, 5, 0, 1)), pa.array(common)], ["key", "n", "pkey", "pn", "common"]
            )
            yield done.filter(member)

    met = asked.join(texts, ["key", "n"]).select("pkey", "pn", "part", "role", "key", "n", "text")
    met = met.repartition("pkey", "pn", "part").sortWithinPartitions("pkey", "pn", "part", "role")
    return met.mapInArrow(run, "key long, n long, pkey long, pn long, common long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of ``left`` the number of shingles it shares with each set of ``right``, by lists of who has which."""
    owners = np.repeat(np.arange(len(right)), [len(s) for s in right])
    flat = np.concatenate([np.empty(0, np.uint64), *right])
    order = np.argsort(flat, kind="stable")
    flat, owners = flat[order], owners[order]
    for own in left:
        first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        sizes = last - first
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        yield np.bincount(owners[at], minlength=len(right))


def _links_in_blocks(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, n, pkey, pn): links between texts of a region (rkey, rn) that are of different groups.

    A region is dealt into blocks of bounded size, and two blocks meet in one task. So a text travels once per block of its region
    and not once per partner, its shingles are computed once in a task, and no pair is a row of its own.
    """
    parts = rest.groupBy("rkey", "rn").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    dealt = rest.join(parts, ["rkey", "rn"]).withColumn("own", F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "rkey", "rn", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n",
        F.col("group.key").alias("gkey"), F.col("group.n").alias("gn"),
    )

    def run(block: pa.Table) -> pa.Table:
        own, key, n, gkey, gn = (block[c].to_numpy() for c in ("own", "key", "n", "gkey", "gn"))
        sets = [shingles(value.as_py(), words) for value in block["text"]]
        i, j = block["i"][0].as_py(), block["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = []
        for a, common in zip(left.tolist(), common_counts([sets[x] for x in left], [sets[x] for x in right]), strict=True):
            linked = 100 * common >= percent * (n[a] + n[right] - common)
            linked &= (gkey[right] != gkey[a]) | (gn[right] != gn[a])
            for b in right[linked].tolist():
                found.append((key[a], n[a], key[b], n[b]))
        rows = np.array(found, dtype=np.int64).reshape(-1, 4)
        return pa.table({c: rows[:, k] for k, c in enumerate(PAIR)})

    met = dealt.join(texts, ["key", "n"]).select("rkey", "rn", "i", "j", "own", "key", "n", "gkey", "gn", "text")
    return met.groupBy("rkey", "rn", "i", "j").applyInArrow(run, "key long, n long, pkey long, pn long")


def components(links: DataFrame) -> DataFrame:
    """(key, n, group): the smallest set reachable from each set that has a link; ``links`` has key, n, pkey, pn.

    Each step takes the smallest group among neighbours and then the group of that group, so a chain of links halves with
    every step; steps go on until nothing changes.
    """
    one = F.struct(F.col("key"), F.col("n")).alias("a")
    two = F.struct(F.col("pkey").alias("key"), F.col("pn").alias("n")).alias("b")
    there = links.select(one, two)
    edges = cut_lineage(there.union(there.select("b", "a")).distinct())
    groups = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("g")))
    while True:
        near = edges.join(groups.select(F.col("a").alias("b"), F.col("g")), "b").groupBy("a").agg(F.min("g").alias("m"))
        step = groups.join(near, "a").select("a", "g", F.least("g", "m").alias("m"))
        over = groups.select(F.col("a").alias("m"), F.col("g").alias("gg"))
        moved = cut_lineage(step.join(over, "m", "left").select("a", "g", F.least("m", F.coalesce("gg", "m")).alias("m")))
        groups = moved.select("a", F.col("m").alias("g"))
        if moved.where("g <> m").isEmpty():
            return groups.select("a.key", "a.n", F.col("g").alias("group"))


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(100 * F.col("common") >= percent * (F.col("n") + F.col("pn") - F.col("common"))).drop("common")


def _pairs_inside(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of the regions that may be links."""
    other = cells.select("cell", F.col("key").alias("pkey"), F.col("n").alias("pn"), F.col("at").alias("pat"))
    smaller = (F.col("n") < F.col("pn")) | ((F.col("n") == F.col("pn")) & (F.col("key") < F.col("pkey")))
    sizes = 100 * F.col("n") >= percent * F.col("pn")
    met = cells.join(other, "cell").where(smaller & sizes).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("regions"), F.max("at").alias("at"), F.max("pat").alias("pat")
    )
    return met.where(possible(percent)).select(*PAIR, "regions")


def _merged(rows: DataFrame, region: list[str]) -> DataFrame:
    """(pkey, pn, key, n, places): regions known by their pivot text; regions with the same pivot become one.

    The pivot is the text of most places; equals are told apart by hash, the same way everywhere.
    """
    drawn = rows.groupBy(*region).agg(F.max(F.struct("places", F.xxhash64("key", F.lit(1)), "key", "n")).alias("p"))
    pivots = drawn.select(*[F.col(c).alias(f"_{c}") for c in region], F.col("p.key").alias("_p"), F.col("p.n").alias("_pn"))
    same = [F.col(c) == F.col(f"_{c}") for c in region]
    return rows.join(pivots, same).select(F.col("_p").alias("pkey"), F.col("_pn").alias("pn"), "key", "n", "places").distinct()


def _not_pivot() -> Column:
    """Whether a member is not the pivot itself."""
    return ~((F.col("key") == F.col("pkey")) & (F.col("n") == F.col("pn")))


def _fits(percent: int) -> Column:
    """Whether the sizes of two different sets allow a link."""
    small, large = F.least("n", "pn"), F.greatest("n", "pn")
    return (100 * small >= percent * large) & _not_pivot()


def _still_open(regions: DataFrame, measured: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """What is left of each region once all distances to its pivot are known: outer texts and the boundary, with ``group``.

    Regions whose texts are all of one group are gone.
    """
    # every distance is measured, also where sizes rule a link out: a bound would not do for the triangle inequality
    distance = 1 - F.col("common") / (F.col("n") + F.col("pn") - F.col("common"))
    known = regions.where(_not_pivot()).join(measured, PAIR).withColumn("d", distance)
    far = 100 * F.col("d") > 100 - percent + 1e-7
    nearest = known.where(far).groupBy("pkey", "pn").agg(F.min("d").alias("outer"))
    edge = F.col("outer") - (100 - percent) / 100 - 1e-9
    rest = known.join(nearest, ["pkey", "pn"]).where(far | (F.col("d") >= edge))
    own = F.struct(F.col("key"), F.col("n"))
    grouped = rest.join(components(links), ["key", "n"], "left").withColumn("group", F.coalesce("group", own))
    mixed = grouped.groupBy("pkey", "pn").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    return grouped.join(mixed.select("pkey", "pn"), ["pkey", "pn"], "left_semi").select(*PAIR, "places", "group", "d")


def _often_enough(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of :func:`_met` that meet in enough small regions to be a link.

    Others are no link, or both texts are hot, and all pairs of hot texts are looked at again.
    """
    return met.where("pn is not null").where(possible(percent)).select(*PAIR, "regions")


def _hot(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, n) of the sets that lie in a large region."""
    return met.where("pn is null and n >= 0").select("key", "n").union(sets.where("hot").select("key", "n")).distinct()


def links_between_sets(
    sets: DataFrame, docs: DataFrame, last: np.ndarray, words: int = WORDS, percent: int = PERCENT, small: int = SMALL,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(key, n, pkey, pn): links whose groups are those of all links. ``sets`` is the table of :func:`_sets`."""
    met = cut_lineage(_met(sets, percent, small))
    pairs, hot = _often_enough(met, percent), _hot(met, sets)
    ends = pairs.select("key", "n").union(pairs.select("pkey", "pn"))
    wanted = hot.withColumn("hot", F.lit(True)).unionByName(ends.withColumn("hot", F.lit(False)))
    wanted = wanted.groupBy("key", "n").agg(F.max("hot").alias("hot"))
    # one text for each set that has to be measured
    places = sets.where("n > 0").groupBy("key", "n").agg(F.min("place").alias("place"))
    texts = cut_lineage(
        docs.select("place", "text").join(places.join(wanted, ["key", "n"]), "place").select("key", "n", "hot", "text")
    )

    # hot texts among themselves, with the pivots of the large regions last
    large = met.where("n < 0").groupBy(F.col("key").alias("cell")).agg(F.sum("regions").alias("size"))
    large = large.orderBy(F.desc("size"), "cell").limit(LAST).select("cell").toArrow().column("cell").to_numpy()
    nowhere = [F.lit(None).cast("bigint").alias("doc_id"), F.lit("").alias("place")]
    again = cut_lineage(
        _sets(texts.where("hot").select(*nowhere, "text"), np.union1d(last, large.view(np.uint64)), words, percent, small)
    )
    met_again = cut_lineage(_met(again, percent, small))
    still_hot = _hot(met_again, again)

    # what is still hot, with the rarest shingles first
    left = cut_lineage(_rarest_first(_counted(texts.join(still_hot, ["key", "n"], "left_semi"), words, percent), percent))
    sized = left.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    few = left.join(sized.where((F.col("size") > 1) & (F.col("size") <= small)), "cell", "left_semi")
    many = left.join(sized.where(F.col("size") > small), "cell", "left_semi")
    regions = cut_lineage(_merged(many, ["cell"]))

    texts = texts.drop("hot")
    star = regions.where(_not_pivot()).select(*PAIR, F.lit(0).cast("bigint").alias("regions"))
    offered = pairs.unionByName(_often_enough(met_again, percent)).unionByName(_pairs_inside(few, percent))
    offered = cut_lineage(offered.groupBy(*PAIR).agg(F.max("regions").alias("regions")))
    # first each text with the partners that it meets most often, and the members of large regions with their pivot; then only
    # pairs that these links have not brought into one group
    up = offered.groupBy("key", "n").agg(F.max(F.struct("regions", "pkey", "pn")).alias("b")).select("key", "n", "b.pkey", "b.pn")
    down = offered.groupBy("pkey", "pn").agg(F.max(F.struct("regions", "key", "n")).alias("b")).select("b.key", "b.n", "pkey", "pn")
    measured = cut_lineage(_measured(up.union(down).union(star.select(*PAIR)).distinct(), texts, words))
    groups = cut_lineage(components(_linked(measured, percent)))
    mine = groups.withColumnRenamed("group", "_g")
    theirs = groups.select(F.col("key").alias("pkey"), F.col("n").alias("pn"), F.col("group").alias("_h"))
    apart = ~(F.col("_g").isNotNull() & F.col("_h").isNotNull() & (F.col("_g") == F.col("_h")))
    others = offered.select(*PAIR).join(mine, ["key", "n"], "left").join(theirs, ["pkey", "pn"], "left").where(apart).select(*PAIR)
    others = others.join(measured.select(*PAIR), PAIR, "left_anti")
    measured = cut_lineage(measured.unionByName(_measured(others, texts, words)))
    links = _linked(measured, percent)
    for _ in range(rounds):
        if regions.isEmpty():
            return links
        rest = _still_open(regions, measured, links, percent).drop("group", "d").withColumnsRenamed({"pkey": "rkey", "pn": "rn"})
        regions = cut_lineage(_merged(rest, ["rkey", "rn"]))
        fresh = regions.where(_not_pivot()).select(*PAIR).join(measured.select(*PAIR), PAIR, "left_anti")
        measured = cut_lineage(measured.unionByName(_measured(fresh, texts, words)))
        links = _linked(measured, percent)
    if regions.isEmpty():
        return links
    # what no pivot could part: texts of different groups meet in blocks
    rest = _still_open(regions, measured, links, percent).withColumnsRenamed({"pkey": "rkey", "pn": "rn"})
    return links.union(_links_in_blocks(cut_lineage(rest.select("rkey", "rn", "key", "n", "group")), texts, words, percent))


def _grouped(placed: DataFrame, words: int, percent: int, small: int, rounds: int) -> DataFrame:
    """(doc_id, place, n, group, component_id) of (doc_id, place, text); ``group`` is null without shingles.

    Worked out at once: what lies between is as large as the texts, and goes when this small table is written.
    """
    with scratch(placed.sparkSession):
        last = _last(placed, words)
        sets = cut_lineage(_sets(placed, last, words, percent, small))
        links = cut_lineage(links_between_sets(sets, placed, last, words, percent, small, rounds))
        own = F.struct(F.col("key"), F.col("n"))
        classes = sets.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("least"))
        grouped = classes.join(components(links), ["key", "n"], "left").withColumn("group", F.coalesce("group", own))
        groups = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
        known = grouped.drop("least").join(groups, "group")
        rows = sets.join(known, ["key", "n"], "left")
        return cut_lineage(rows.select("doc_id", "place", "n", "group", F.coalesce("component_id", "doc_id").alias("component_id")), keep=True)


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    small: int = SMALL, rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; ``component_id`` is the smallest id reachable by links."""
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = _grouped(with_place(named, "place"), words, percent, small, rounds)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
    small: int = SMALL, rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; rows without shingles all stay."""
    inner, back = fenced(docs)
    rows = with_place(inner, "place")
    placed = rows.select(F.col(column_of(docs, doc_id)).cast("bigint").alias("doc_id"), "place", F.col(column_of(docs, text)).alias("text"))
    found = _grouped(placed, words, percent, small, rounds)
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "place")).alias("m"))
    stay = first.select("m.place").union(found.where("group is null").select("place"))
    return back(rows.join(stay, "place", "left_semi"), {})
