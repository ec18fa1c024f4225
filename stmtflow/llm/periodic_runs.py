"""Periodic runs of words, found with longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least ``max(LEAST, 3 * q)`` words long, that no neighbouring word
extends. Words q apart match over ``length - q`` places, at least ``reach(q) = max(LEAST - q, 2 * q)`` of them, so the
harmonic grid of places ``0, reach(q), 2 * reach(q) ...`` meets every run of period q; over all periods that is
O(n log n) places. From a grid place i the run is as far as the words from i and from i + q agree, forwards and backwards.

These extensions come from :class:`Extensions`: only suffixes that start in a difference cover modulo 21 are sorted (5 of
21), with the common prefixes of neighbours in a sparse table. Any two places reach two covered ones within 20
words, so a query compares at most 20 words and then asks for one minimum. Most grid places fail in the compared words,
so the sorted suffixes of a text are only made if a place gets beyond them.

Spark deals the documents; a task holds one text at a time, and 50 bytes or so a word of it. Nothing is shuffled.

Defined results: a null text, an empty one or one of white space has no words and no runs; equal rows are computed each for
itself; of equal exponents the smallest start counts, then the smallest period; an empty table gives no rows; columns of
the input keep their names unless they are those of the result, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import WORD_GAP, column_of, fenced

#: Fewest words of a run.
LEAST = 24
#: A difference cover: every number modulo 21 is the difference of two of these (fixed values).
MODULUS, COVER = 21, np.array([0, 1, 4, 14, 16])
#: Grid places that are looked at together; texts up to so many words share one stored grid.
CHUNK, STORED = 1 << 18, 1 << 15
#: Words of a run that is remembered while longer periods are looked at.
LONG = 1024

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _shifts() -> np.ndarray:
    """[i % 21, j % 21] to the fewest words after which both places are in the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    out = np.empty((MODULUS, MODULUS), dtype=np.int64)
    for i in range(MODULUS):
        for j in range(MODULUS):
            out[i, j] = next(d for d in range(MODULUS) if inside[i + d] and inside[j + d])
    return out


SHIFT = _shifts()
_SLOT = np.full(MODULUS, -1)
_SLOT[COVER] = np.arange(len(COVER))


def agreeing(ids: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j > i on, counted up to ``limit`` and to the end of the text."""
    limit = np.minimum(limit, len(ids) - j)
    out = np.zeros(len(i), dtype=np.int64)
    at = np.flatnonzero(limit > 0)
    step = 0
    while len(at):
        at = at[ids[i[at] + step] == ids[j[at] + step]]
        step += 1
        out[at] = step
        at = at[limit[at] > step]
    return out


class Extensions:
    """Longest common extensions of places of one text; ``ids`` are its words as numbers from 0."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        blocks = -(-self.n // MODULUS)
        at = (np.arange(blocks)[:, None] * MODULUS + COVER).ravel()
        padded = np.zeros(blocks * MODULUS + 2 * MODULUS, dtype=np.int64)
        padded[: self.n] = ids + 1
        levels = [self._first_ranks(padded, at)]
        real, step = at < self.n, 1
        # ranks by twice as many words each time; a covered place plus a multiple of 21 is covered too
        while step < blocks and len(np.unique(levels[-1][real])) < real.sum():
            rank = levels[-1]
            after = np.zeros_like(rank)
            after[: len(rank) - step * len(COVER)] = rank[step * len(COVER) :] + 1
            levels.append(np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1])
            step *= 2
        # places past the end are a suffix without words, and come before all others
        order = np.lexsort((at, levels[-1]))
        order = order[real[order]]
        self.place = np.empty(len(at), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.table = [self._neighbours(levels, at, order)]
        width = 1
        while 2 * width < len(order):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _first_ranks(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the places by their first 21 words, several words to a sort key."""
        base = int(padded.max()) + 1
        each = 1
        while base ** (each + 1) < 2**62:
            each += 1
        keys = []
        for start in range(0, MODULUS, each):
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(start, min(start + each, MODULUS)):
                key = key * base + padded[at + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), dtype=bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(at), dtype=np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _neighbours(self, levels: list[np.ndarray], at: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Common prefix of each sorted suffix and the next one: by halving steps, then the last words one by one."""
        i, j = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            # equal ranks mean equal words inside the text: a suffix that ends within them has no equal
            width = len(COVER) << k
            on = np.flatnonzero((i < len(at)) & (j < len(at)))
            on = on[levels[k][i[on]] == levels[k][j[on]]]
            out[on] += MODULUS << k
            i[on] += width
            j[on] += width
        first, second = at[order[:-1]] + out, at[order[1:]] + out
        return out + agreeing(self.ids, np.minimum(first, second), np.maximum(first, second), np.full(len(out), MODULUS))

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for i < j."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = agreeing(self.ids, i, j, shift)
        on = np.flatnonzero((out == shift) & (j + shift < self.n))
        if len(on):
            a, b = i[on] + shift[on], j[on] + shift[on]
            one, two = (self.place[p // MODULUS * len(COVER) + _SLOT[p % MODULUS]] for p in (a, b))
            low, high = np.minimum(one, two), np.maximum(one, two)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            best = np.empty(len(on), dtype=np.int64)
            for k in np.unique(level):
                m = level == k
                best[m] = np.minimum(self.table[k][low[m]], self.table[k][high[m] - (1 << k)])
            out[on] += best
        return out


def reach(period: np.ndarray) -> np.ndarray:
    """Fewest places at which words ``period`` apart match in a run."""
    return np.maximum(LEAST - period, 2 * period)


def _places(low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places and periods, for the periods low to high of a text of n words."""
    q = np.arange(low, high + 1)
    times = (n - 1 - q) // reach(q) + 1
    period = np.repeat(q, times)
    number = np.arange(len(period)) - np.repeat(np.cumsum(times) - times, times)
    return number * reach(period), period


@lru_cache(maxsize=16)
def _stored(words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of all texts of up to ``words`` words: places, periods and the words that a text needs to have each."""
    place, period = _places(1, words // 3, words)
    need = np.maximum(place + period + 1, np.maximum(LEAST, 3 * period))
    order = np.argsort(need, kind="stable")
    return place[order], period[order], need[order]


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places and periods of a text of n words, in parts of bounded size."""
    if n < LEAST:
        return
    if n <= STORED:
        place, period, need = _stored(max(64, 1 << (n - 1).bit_length()))
        held = np.searchsorted(need, n, side="right")
        yield place[:held], period[:held]
        return
    low = 1
    while low <= n // 3:
        high = low  # periods near 1 alone may have n / 23 places
        total = n // int(reach(np.array(low))) + 1
        while high < n // 3 and total < CHUNK:
            high += 1
            total += n // (2 * high) + 1 if high >= 8 else n // (LEAST - high) + 1
        yield _places(low, high, n)
        low = high + 1


def runs_of(ids: np.ndarray) -> np.ndarray:
    """All runs of a text as rows (start, length, period), by start and period."""
    n = len(ids)
    forward = backward = None
    found = []
    # for each word the end and period of a long run around it: multiples of that period show nothing new inside
    end, inner = np.zeros((2, n if n > STORED else 0), dtype=np.int64)
    for i, q in grid(n):
        match = ids[i] == ids[i + q]
        i, q = i[match].astype(np.int64), q[match].astype(np.int64)
        if n > STORED:
            new = (i + q >= end[i]) | (q % np.maximum(inner[i], 1) != 0)
            i, q = i[new], q[new]
        if not len(i):
            continue
        mirrored = ids[::-1]
        few = np.full(len(i), MODULUS)
        ahead, behind = agreeing(ids, i, i + q, few), agreeing(mirrored, n - i - q, n - i, few)
        far = np.flatnonzero(np.where(ahead == MODULUS, n, ahead) + np.where(behind == MODULUS, n, behind) >= reach(q))
        i, q, ahead, behind = i[far], q[far], ahead[far], behind[far]
        on, back = np.flatnonzero(ahead == MODULUS), np.flatnonzero(behind == MODULUS)
        if len(on):
            forward = forward or Extensions(ids)
            ahead[on] = forward.between(i[on], i[on] + q[on])
        if len(back):
            backward = backward or Extensions(mirrored)
            behind[back] = backward.between(n - i[back] - q[back], n - i[back])
        whole = np.flatnonzero(ahead + behind >= reach(q))
        found.append(np.unique(np.stack([i[whole] - behind[whole], (ahead + behind + q)[whole], q[whole]], axis=1), axis=0))
        if n > STORED:
            for start, length, period in found[-1][found[-1][:, 1] >= LONG].tolist():
                if start + length > end[start]:
                    end[start : start + length], inner[start : start + length] = start + length, period
    if not found:
        return np.empty((0, 3), dtype=np.int64)
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    # a multiple of the smallest period gives the same stretch again
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def strongest(runs: np.ndarray) -> list[int] | None:
    """The run of greatest length / period; ties to the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = [start, length, period]
    return best


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and the same word's same number for each of them."""
    words = text.split()  # bytes split at space and the controls 9 to 13, nothing else
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    return words, ids


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (by start, then period), best (the strongest run, null without one) and
    collapsed (the words joined by a space, without those that a run contains after its first period)."""
    inner, back = fenced(docs)
    found = ["_n", "_runs", "_best", "_collapsed"]
    kept = [c for c in inner.columns if c != column_of(docs, text)] if text in ("n_words", "runs", "best", "collapsed") else inner.columns
    inner = inner.withColumn("_text", F.col(column_of(docs, text)).cast("binary")).select("_text", *kept)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, all_runs, best, collapsed = [], [], [], []
            for value in b.column(0):
                words, ids = numbered(value.as_py() or b"")
                runs = runs_of(ids)
                counts.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
                top = strongest(runs)
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                if len(runs):
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(words).decode())
            made = [pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(run)), pa.array(best, run), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*b.schema.names[1:], *found])

    types = {f.name: f.dataType.simpleString() for f in inner.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", _n bigint, _runs array<{RUN}>, _best {RUN}, _collapsed string"
    done = inner.mapInArrow(search, schema.lstrip(", "))
    return back(done, dict(zip(("n_words", "runs", "best", "collapsed"), found, strict=True)))


def with_planted_tail(text: Column, hashed: Column) -> Column:
    """The text whose last words repeat with a period, where ``hashed`` is a multiple of 10; elsewhere the text itself.

    With g = hashed / 10 and n words, word i from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")

    def tail(w: Column) -> Column:
        n, g = F.size(w), F.floor(hashed / 10)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(n > 0, F.array_join(places, " ")).otherwise("")

    planted = F.transform(F.array(words), tail)[0]
    return F.when(hashed % 10 == 0, planted).otherwise(text)
