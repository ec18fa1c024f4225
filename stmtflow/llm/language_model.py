"""Scoring texts with a hashed maximum-entropy model with class-factored softmax.

Tokens are words (A-Z lower-cased) and one end per text. The ``FREQUENT`` commonest tokens are outcomes of their own, dealt
to classes of equal mass; all others share one outcome. The model gives

    P(token | history) = P(class | previous, token before) * P(token | class, previous)

Both factors are softmaxes over hashed features: the previous token (bigram), the one before it (skip), and both together
(trigram). A token outside the outcomes then has its share of the rest, (c + 1) / (N' + V' + 1) over the counts of
the rest, so probabilities of all seen tokens and one unseen one add up to 1.

Outcomes and hashed histories are of a fixed size, so they only say where the model starts. On them lies a feature for every
pair of words that training has seen, however many words and pairs there are, with the start as ``SAMPLE`` tokens seen before:

    P'(token | history) = (c(previous, token) + SAMPLE * P(token | history)) / (c(previous) + SAMPLE)

which is the optimum of those features, and a distribution again, as the counts of a history's pairs add up to its own.

Features only depend on hashed histories, so the corpus is first summed to counts of (history, outcome): that is all a
gradient needs, and it is a sum per partition before anything is shuffled. Class weights follow distributed gradient
updates, each a job over the counts that adds up observed minus expected counts per feature; the token weights of
one hashed history are independent of others and are trained where its counts lie. Scoring looks both factors up
for whole batches of tokens.

Counts of every token and pair of the training fold are kept exactly. All tasks know the ``DICTIONARY`` commonest words and the pairs of the
``HEAD`` commonest. All other tokens travel in blocks of columns to the part that their word or pair falls into by hash; so no part
can be crowded, and no table of words or pairs has to fit anywhere. There is a part for ``PART`` bytes of text, which
counts what it has got and sends back what the tokens of each text add to its sums.

Defined results: null text counts as empty and has one token, the end; a null id counts as the empty string for the
fold; tokens that training never saw have count 0; repeated rows count as often as they occur and are scored alike;
without training rows every token is unseen; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.session import cut_lineage

FREQUENT, DICTIONARY = 2048, 1 << 17
CLASSES, BIGRAM, SKIP, TRIGRAM = 32, 256, 16, 1024
UPDATES, RATE, PRIOR = 12, 0.5, 20.0
#: Distinct words a task counts before it hands them on.
HELD = 1 << 19
#: Commonest words whose pairs all tasks know; weight of the hashed model beside the counts of pairs.
HEAD, SAMPLE = 1024, 60.0
#: Bytes of text (and texts, of which 15 bits tell the number) that a task scores at once, and bytes of text to a part.
CHUNK, CHUNK_TEXTS, PART = 1 << 21, 1 << 15, 1 << 24
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words and the end; bytes split at exactly space and 9 to 13."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows; summed per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for value in batch.column(0):
                seen.update(tokens(value.as_py()))
                if len(seen) >= HELD:
                    yield handed(seen)
                    seen = Counter()
        yield handed(seen)

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _spread(ids: np.ndarray, slots: int) -> np.ndarray:
    """Hash of token numbers into ``slots`` (a power of two); neighbouring numbers, so frequent tokens, part."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - slots.bit_length() + 1)


@dataclass
class Vocabulary:
    """The commonest words with their counts, and totals; the first ``frequent`` are outcomes."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    frequent: int = field(init=False)
    head: int = field(init=False)

    def __post_init__(self) -> None:
        self.frequent = min(FREQUENT, len(self.words))
        self.number = {w: i for i, w in enumerate(self.words)}
        mass = self.counts[: self.frequent].astype(np.float64)
        reach = np.cumsum(mass) - mass / 2
        # classes of about equal mass; the rest has the last class
        self.classes = np.append((reach / max(1.0, mass.sum()) * CLASSES).astype(np.int64), CLASSES)
        self.base = np.log10((self.counts + 1) / (self.total + self.distinct + 1))
        self.base_unseen = float(np.log10(1 / (self.total + self.distinct + 1)))
        self.head = min(HEAD, self.frequent)
        rest = self.total - int(mass.sum())
        self.rest_size = rest + (self.distinct - self.frequent) + 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if the dictionary lacks it."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def histories(self, outcomes: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashed previous token and token before it, of a text or of several that begin at ``starts``."""
        start = self.frequent + 1
        one = np.concatenate([[start], outcomes[:-1]])
        if starts is not None:
            one[starts] = start
        two = np.concatenate([[start], one[:-1]])
        if starts is not None:
            two[starts] = start
        return _spread(one, BIGRAM).astype(np.int64), _spread(two, SKIP).astype(np.int64)

    def pairs(self, numbers: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the previous token (-2: none), which pairs are of the head, and their places in a table of (head + 1) x head."""
        previous = np.concatenate([[-2], numbers[:-1]])
        if starts is not None:
            previous[starts] = -2
        known = (numbers >= 0) & (numbers < self.head) & (previous != -1) & (previous < self.head)
        row = np.where(previous[known] == -2, self.head, previous[known])
        return previous, known, row * self.head + numbers[known]

    def outcomes(self, numbers: np.ndarray) -> np.ndarray:
        return np.where((numbers >= 0) & (numbers < self.frequent), numbers, self.frequent)


def history_counts(docs: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(kind, slot, n): counts of (histories, class) for kind 0, of (previous, outcome) for kind 1 and of pairs of the head for kind 2."""
    wide = vocabulary.frequent + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class = np.zeros(BIGRAM * SKIP * (CLASSES + 1), dtype=np.int64)
        by_word = np.zeros(BIGRAM * wide, dtype=np.int64)
        by_pair = np.zeros((vocabulary.head + 1) * vocabulary.head, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                number = vocabulary.numbers(tokens(value.as_py()))
                outcome = vocabulary.outcomes(number)
                one, two = vocabulary.histories(outcome)
                slots = (one * SKIP + two) * (CLASSES + 1) + vocabulary.classes[outcome]
                for table, at in ((by_class, slots), (by_word, one * wide + outcome), (by_pair, vocabulary.pairs(number)[2])):
                    if len(at) * 64 < len(table):
                        np.add.at(table, at, 1)
                    else:
                        table += np.bincount(at, minlength=len(table))
        for kind, table in ((0, by_class), (1, by_word), (2, by_pair)):
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at), pa.array(table[at])], ["kind", "slot", "n"]
            )

    counted = docs.select(text).mapInArrow(count, "kind int, slot long, n long")
    return counted.groupBy("kind", "slot").agg(F.sum("n").alias("n"))


def _trigram(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return _spread(one * SKIP + two + 1, TRIGRAM).astype(np.int64)


#: Rows of the class weights: one bias, then the hashed features.
_ROWS = 1 + BIGRAM + SKIP + TRIGRAM


def _active(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Weight rows that are on in each history."""
    return np.stack([np.zeros_like(one), 1 + one, 1 + BIGRAM + two, 1 + BIGRAM + SKIP + _trigram(one, two)], axis=1)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def train_classes(counts: DataFrame) -> np.ndarray:
    """Log P(class | histories) for every pair of hashed histories."""
    c = CLASSES + 1
    # one row per pair of histories: at most BIGRAM * SKIP, each with at most a count per class
    rows = cut_lineage(
        counts.where("kind = 0").groupBy(F.floor(F.col("slot") / c).alias("pair"))
        .agg(F.collect_list(F.struct((F.col("slot") % c).cast("int").alias("c"), "n")).alias("seen"))
    )
    weights = np.zeros((_ROWS, c))
    for update in range(UPDATES):

        def gradient(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            observed, expected = np.zeros((_ROWS, c)), np.zeros((_ROWS, c))
            for batch in batches:
                pair = batch.column(0).to_numpy()
                n = np.zeros((len(pair), c))
                seen = batch.column(1)
                at = np.repeat(np.arange(len(pair)), np.diff(seen.offsets.to_numpy()))
                flat = seen.flatten()
                n[at, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                on = _active(pair // SKIP, pair % SKIP)
                p = np.exp(_log_softmax(weights[on].sum(axis=1))) * n.sum(axis=1, keepdims=True)
                for j in range(on.shape[1]):
                    np.add.at(observed, on[:, j], n)
                    np.add.at(expected, on[:, j], p)
            at = np.flatnonzero((observed + expected).ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(observed.ravel()[at]), pa.array(expected.ravel()[at])], ["i", "observed", "expected"]
            )

        # what comes back has the size of the weights, whatever the corpus
        sums = rows.mapInArrow(gradient, "i long, observed double, expected double").groupBy("i").agg(
            F.sum("observed").alias("observed"), F.sum("expected").alias("expected")
        ).toArrow()
        at = sums.column("i").to_numpy()
        observed, expected = sums.column("observed").to_numpy(), sums.column("expected").to_numpy()
        # the first update moves the bias alone, so that features only say what differs from it
        step = RATE * (observed - expected) / (np.maximum(observed, expected) + PRIOR)
        flat = weights.ravel().copy()
        if update == 0:
            bias = at < c
            flat[at[bias]] = np.log(observed[bias] + 0.5)
        else:
            flat[at] += step
        weights = flat.reshape(_ROWS, c)
    one, two = np.divmod(np.arange(BIGRAM * SKIP), SKIP)
    return _log_softmax(weights[_active(one, two)].sum(axis=1)).astype(np.float32)


def train_words(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Log P(outcome | its class, previous) for every hashed previous token."""
    wide, classes = vocabulary.frequent + 1, vocabulary.classes
    mass = np.append(vocabulary.counts[: vocabulary.frequent], 1).astype(np.float64) + 0.5
    share = mass / np.bincount(classes, mass, CLASSES + 1)[classes]

    def train(table: pa.Table) -> pa.Table:
        slots, n = table.column("slot").to_numpy(), table.column("n").to_numpy()
        observed = PRIOR * share
        observed[slots % wide] += n
        held = np.bincount(classes, observed, CLASSES + 1)[classes]
        weight = np.zeros(wide)  # of the feature (previous, outcome), beside the bias log(share)
        for _ in range(3 * UPDATES):
            raw = share * np.exp(weight)
            expected = held * raw / np.bincount(classes, raw, CLASSES + 1)[classes]
            weight += (observed - expected) / np.maximum(observed, expected)
        raw = share * np.exp(weight)
        p = np.log(raw / np.bincount(classes, raw, CLASSES + 1)[classes])
        return pa.table({"previous": pa.array([int(slots[0] // wide)], type=pa.int64()), "p": pa.array([p.tolist()], type=pa.list_(pa.float64()))})

    rows = counts.where("kind = 1").withColumn("previous", F.floor(F.col("slot") / wide))
    out = np.tile(np.log(share), (BIGRAM, 1))
    for r in rows.groupBy("previous").applyInArrow(train, "previous long, p array<double>").collect():  # at most BIGRAM rows
        out[r.previous] = r.p
    return out.astype(np.float32)


def _digest(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), dtype=np.uint64)


def _pair_key(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = (previous ^ (previous >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _by_part(key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that some keys fall into, with their places in order."""
    part = (key >> np.uint64(16)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    present, begin = np.unique(part[order], return_index=True)
    return zip(present.tolist(), np.split(order, begin[1:]) if len(begin) else [], strict=True)


def _counts_of(group: np.ndarray, groups: int, train: np.ndarray) -> np.ndarray:
    return np.bincount(group, train, groups)[group]


#: What travels: texts with what their task could tell, tokens by pair (text and fold, key, start), and tokens by word.
_SENT = {
    "part": pa.int32(), "first": pa.int64(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int64()),
    "n_known": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "score": pa.list_(pa.float64()),
    "of": pa.binary(), "key": pa.binary(), "start": pa.binary(), "word_of": pa.binary(), "words": pa.binary(), "previous": pa.binary(), "word_start": pa.binary(),
}
_SENT_DDL = (
    "part int, first long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, "
    "score array<double>, of binary, key binary, start binary, word_of binary, words binary, previous binary, word_start binary"
)
#: What goes back: for the texts of a chunk, which are told by their place in it, what is to be added up.
_SUMS = {
    "first": pa.int64(), "text": pa.list_(pa.int32()), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()),
    "n_tokens": pa.list_(pa.int64()), "n_known": pa.list_(pa.int64()), "base": pa.list_(pa.float64()), "score": pa.list_(pa.float64()),
}
_SUMS_DDL = (
    "first long, text array<int>, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, "
    "score array<double>"
)


def _settle(total: int, distinct: int, rest_size: int, sample: float):
    """What the tokens of one part add to the sums of their texts."""

    def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        blocks = [np.frombuffer(b, dtype=kind) for b in column.to_pylist()]
        return np.concatenate(blocks) if blocks else np.zeros(0, kind), np.array([len(b) for b in blocks], dtype=np.int64)

    def settle(table: pa.Table) -> pa.Table:
        out = []

        def add(of: np.ndarray, sizes: np.ndarray, first: np.ndarray, **values: np.ndarray) -> None:
            """The sums of each text, a row for a chunk."""
            chunks, at = np.unique(first, return_inverse=True)
            texts, group = np.unique((np.repeat(at, sizes) << 16) + (of >> 1), return_inverse=True)
            offsets = pa.array(np.searchsorted(texts, np.append(np.arange(len(chunks)), len(chunks)) << 16), type=pa.int32())
            columns = {"first": pa.array(chunks), "text": pa.ListArray.from_arrays(offsets, pa.array((texts & 0xFFFF).astype(np.int32)))}
            for name, value in values.items():
                summed = np.bincount(group, value, len(texts))
                columns[name] = pa.ListArray.from_arrays(offsets, pa.array(summed, type=_SUMS[name].value_type, safe=False))
            out.append(pa.table({c: columns.get(c, pa.nulls(len(chunks), t)) for c, t in _SUMS.items()}))

        heads = table.filter(table.column("doc_id").is_valid())
        if heads.num_rows:
            texts = pa.array([range(len(x)) for x in heads.column("n_tokens")], type=_SUMS["text"])
            out.append(pa.table({c: texts if c == "text" else heads.column(c) for c in _SUMS}, schema=pa.schema(_SUMS)))
        pairs = table.filter(table.column("key").is_valid())
        if pairs.num_rows:
            of, sizes = joined(pairs.column("of"), np.uint16)
            key, start = joined(pairs.column("key"), np.uint64)[0], joined(pairs.column("start"), np.float32)[0].astype(np.float64)
            seen, group = np.unique(key, return_inverse=True)
            log = np.log10(_counts_of(group, len(seen), of & 1) + start)
            add(of, sizes, pairs.column("first").to_numpy(), score=log)
        rare = table.filter(table.column("words").is_valid())
        if rare.num_rows:
            of, sizes = joined(rare.column("word_of"), np.uint16)
            words = [w for block in rare.column("words").to_pylist() for w in block.split(b" ")]
            number: dict[bytes, int] = {}
            group = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
            count = _counts_of(group, len(number), of & 1)
            pair, which = np.unique(np.stack([group, joined(rare.column("previous"), np.uint32)[0].astype(np.int64)]), axis=1, return_inverse=True)
            start = joined(rare.column("word_start"), np.float32)[0] * ((count + 1) / rest_size)
            log = np.log10(_counts_of(which.ravel(), pair.shape[1], of & 1) + start)
            # each is the history of what follows, but for the end
            log -= np.where(group == number.get(_SHOWN_END, -1), 0.0, np.log10(count + sample))
            base = np.log10((count + 1) / (total + distinct + 1))
            add(of, sizes, rare.column("first").to_numpy(), n_known=count > 0, base=base, score=log)
        return pa.concat_tables(out)

    return settle


def _added_up(table: pa.Table) -> pa.Table:
    """The texts of one chunk, of which one row knows all and the others give what their part adds."""
    head = table.filter(table.column("doc_id").is_valid())
    columns = {c: head.column(c).combine_chunks().flatten() for c in ("doc_id", "held_out", "n_tokens")}
    for name in ("n_known", "base", "score"):
        some = table.filter(table.column(name).is_valid())
        text = some.column("text").combine_chunks().flatten().to_numpy()
        summed = np.bincount(text, some.column(name).combine_chunks().flatten().to_numpy(), len(columns["doc_id"]))
        columns[name] = pa.array(summed, type=_SUMS[name].value_type, safe=False)
    return pa.table(columns)


#: The end among words that are put together with blanks between them; no word has this byte.
_SHOWN_END = b"\n"


def score(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a condition on the column ``doc_id``; the model and the counts come from the other rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "held_out", F.coalesce(held_out, F.lit(False))
    )
    fold = rows.where("not held_out")
    counts = cut_lineage(word_counts(fold, "text"))
    total, distinct, texts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))
    ).first()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = math.ceil((size + 1) / PART)
    common = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).toArrow()
    vocabulary = Vocabulary(common.column("word").to_pylist(), common.column("n").to_numpy(), total, distinct)
    known = spark.sparkContext.broadcast(vocabulary)  # at most DICTIONARY words
    histories = cut_lineage(history_counts(fold, "text", vocabulary))
    in_head = np.zeros((vocabulary.head + 1) * vocabulary.head, dtype=np.int64)
    seen = histories.where("kind = 2").select("slot", "n").toArrow()  # at most a row per pair of the head
    in_head[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    tables = spark.sparkContext.broadcast((train_classes(histories), train_words(histories, vocabulary), in_head, _digest(vocabulary.words)))
    sample, chunk, chunk_texts = SAMPLE, CHUNK, CHUNK_TEXTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (by_class, by_word, in_head, digests) = known.value, tables.value
        log10 = float(np.log10(np.e))
        rest = np.log10((v.counts + 1) / v.rest_size)
        as_history = np.append(np.log10(v.counts + sample), [math.log10(texts + sample), 0.0])  # then the start at -2, others at -1
        digest_of_start = _digest([b" "])[0]
        first = TaskContext.get().partitionId() << 33

        def scored(held: list[tuple[int | None, bool, str | None]]) -> pa.RecordBatch:
            words: list[bytes] = []
            sizes = np.empty(len(held), dtype=np.int64)
            for i, (_, _, value) in enumerate(held):
                of_text = tokens(value)
                words += of_text
                sizes[i] = len(of_text)
            starts = np.cumsum(sizes) - sizes
            number = v.numbers(words)
            outcome = v.outcomes(number)
            one, two = v.histories(outcome, starts)
            p = log10 * (by_class[one * SKIP + two, v.classes[outcome]].astype(np.float64) + by_word[one, outcome])
            inside = number >= v.frequent
            p[inside] += rest[number[inside]]
            start = sample * 10**p  # for words that the dictionary lacks, what all of the rest share
            previous, known_pair, at = v.pairs(number, starts)
            value = -as_history[previous]
            value[known_pair] += np.log10(in_head[at] + start[known_pair])
            found = number >= 0
            base = np.where(found, v.base[number], 0.0) if len(v.base) else np.zeros(len(number))
            # of the text, and whether it is counted
            of = (np.repeat(np.arange(len(held)), sizes) << 1 | np.repeat([not h for _, h, _ in held], sizes)).astype(np.uint16)
            sent: dict[int, dict] = {}

            def send(part: int, **columns) -> None:
                sent.setdefault(part, {}).update(columns)

            lacking = np.flatnonzero(~found)
            lacks = [words[i] or _SHOWN_END for i in lacking.tolist()]
            digest = np.empty(len(number), dtype=np.uint64)
            digest[found] = digests[number[found]]
            digest[lacking] = _digest(lacks)
            before = np.concatenate([[digest_of_start], digest[:-1]])
            before[starts] = digest_of_start
            others = np.flatnonzero(found & ~known_pair)
            key = _pair_key(before[others], digest[others])
            for part, i in _by_part(key, parts):
                j = others[i]
                send(part, of=of[j].tobytes(), key=key[i].tobytes(), start=start[j].astype(np.float32).tobytes())
            for part, i in _by_part(digest[lacking], parts):
                j = lacking[i]
                send(
                    part, word_of=of[j].tobytes(), words=b" ".join([lacks[k] for k in i.tolist()]), previous=before[j].astype(np.uint32).tobytes(),
                    word_start=start[j].astype(np.float32).tobytes(),
                )
            send(
                first % parts, doc_id=[d for d, _, _ in held], held_out=[h for _, h, _ in held], n_tokens=sizes,
                n_known=np.add.reduceat(found.astype(np.int64), starts), base=np.add.reduceat(base, starts), score=np.add.reduceat(value, starts),
            )
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sent), type=kind) if name == "part" else pa.array([first] * len(sent), type=kind) if name == "first"
                    else pa.array([x.get(name) for x in sent.values()], type=kind)
                    for name, kind in _SENT.items()
                ],
                list(_SENT),
            )

        held, held_size = [], 0
        for batch in batches:
            for d, value, h in zip(*(batch.column(i) for i in range(3)), strict=True):
                value = value.as_py()
                held.append((d.as_py(), h.as_py(), value))
                held_size += len(value or "")
                if held_size >= chunk or len(held) == chunk_texts:
                    yield scored(held)
                    first += len(held)
                    held, held_size = [], 0
        if held:
            yield scored(held)

    sent = rows.select("doc_id", "text", "held_out").mapInArrow(run, _SENT_DDL)
    settle = _settle(total, distinct, vocabulary.rest_size, sample)
    sums = sent.groupBy("part").applyInArrow(settle, _SUMS_DDL).groupBy("first").applyInArrow(
        _added_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
