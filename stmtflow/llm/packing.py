"""Packing documents into token sequences by order-preserving dynamic programming.

The documents of a stretch are laid end to end in their order (each as its token ids and a closing id) and cut into
windows of at most ``window`` tokens. Cuts may fall after a document (free), after a sentence (a small penalty) or,
where neither is near enough, anywhere (a larger one): the truncation penalties. A window shorter than ``window`` is
padded up to it, unless its length is a power of two, which needs none. The dynamic program finds the cuts with the
least padding plus penalties:

    best(j) = penalty(j) + min( min over i in [j - window, j) of best(i) - pos(i), + window + pos(j)... )

that is, as padding is ``window - (j - i)``, the smallest ``best(i) + i`` in a sliding window, which a queue of
increasing values keeps at its head; windows of a power of two are the few further transitions of cost 0.

A stretch is what one task has read until it holds ``stretch`` tokens, so memory is bounded, no row is shuffled and
a lost task repeats the same work on the same rows. At the end of a stretch the last window is closed; the
program weighs its padding against splitting it into powers of two like any other.

Defined results: null and empty texts are a document of just the closing id; a document longer than a window is
cut into pieces; equal rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
#: Costs of a cut, in tokens of padding.
AFTER_SENTENCE, ANYWHERE = 4, 24
#: Tokens after which a stretch is cut and handed on.
STRETCH = 1 << 20
CLOSING = 0

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"
)


#: The added token of ``byte_bpe_50k.json``, which the ranks lack.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Byte-level BPE with the ids of ``byte_bpe_50k.json``, read from the same vocabulary kept as ranks.

    tiktoken gives the ids that the tokenizers library gives (tests compare them) in a quarter of its time.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizers library with the vocabulary beside the ranks: slower, but it takes any text."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


@lru_cache(maxsize=2)
def _sentence_ends(path: str) -> np.ndarray:
    """For each id, whether a sentence may end with it."""
    encoder = _encoder(path)
    ends = np.zeros(encoder.n_vocab + 1, dtype=bool)
    for i in range(encoder.n_vocab):
        ends[i] = encoder.decode_single_token_bytes(i).rstrip(b" ").endswith((b".", b"!", b"?", b"\n"))
    return ends


def ids_of(text: str | None, path: str) -> np.ndarray:
    """Ids of a text and the closing id."""
    try:
        ids = _encoder(path).encode_to_numpy(text or "", allowed_special="all")
    except ValueError:  # its pattern gives up on white space of a million characters
        ids = np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids)
    return np.append(ids.astype(np.uint32), np.uint32(CLOSING))


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a cut may fall (0 and the end included) and the penalty of each."""
    total = len(ids)
    cost = np.full(total + 1, -1, dtype=np.int32)
    cost[1:][ends[ids]] = AFTER_SENTENCE
    cost[doc_ends] = 0
    cost[0] = cost[total] = 0
    at = np.flatnonzero(cost >= 0)
    # stretches without a boundary: a cut every few tokens, so that some window can always end close to its limit
    wide = np.flatnonzero(np.diff(at) > window // 8)
    if len(wide):
        extra = np.concatenate([np.arange(at[i] + 32, at[i + 1], 32) for i in wide])
        cost[extra] = ANYWHERE
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into ``at`` of the cuts with the least padding plus penalties; first 0, last the end."""
    n = len(at)
    free = {}
    length = 1
    while length <= window:  # windows of a power of two have no padding
        found = np.searchsorted(at, at - length)
        hit = np.flatnonzero((found < n) & (at[np.minimum(found, n - 1)] == at - length) & (at >= length))
        for j, i in zip(hit.tolist(), found[hit].tolist(), strict=True):
            free.setdefault(j, []).append(i)
        length *= 2
    places, costs = at.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque()  # candidates i with increasing best(i) + at(i)
    key = [0] * n
    nothing: list[int] = []
    for j in range(1, n):
        value, i = key_of = best[j - 1] + places[j - 1], j - 1
        key[j - 1] = key_of[0]
        while queue and key[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
        here = places[j]
        while places[queue[0]] < here - window:
            queue.popleft()
        chosen = queue[0]
        least = key[chosen] + window - here
        for i in free.get(j, nothing):
            if best[i] < least:
                least, chosen = best[i], i
        best[j], back[j] = least + costs[j], chosen
    cuts, j = [n - 1], n - 1
    while j > 0:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def pack_stretch(docs: list[np.ndarray], ends: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Pieces of one stretch: document number, start in it, length, crc, sequence number and offset in it."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    stops = np.cumsum(sizes)
    begins = stops - sizes
    ids = np.concatenate(docs)
    at, penalty = candidates(ids, stops, ends, window)
    cuts = at[best_cuts(at, penalty, window)]
    # a piece begins where a document or a sequence begins
    starts = np.unique(np.concatenate([begins, cuts[:-1]]))
    lengths = np.diff(np.append(starts, len(ids)))
    doc = np.searchsorted(begins, starts, side="right") - 1
    sequence = np.searchsorted(cuts, starts, side="right") - 1
    raw = ids.astype("<u4").tobytes()
    view = memoryview(raw)
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]
    return {
        "doc": doc, "start": starts - begins[doc], "length": lengths, "ids_crc32": np.array(crc, dtype=np.int64),
        "doc_tokens": sizes[doc], "sequence": sequence, "offset": starts - cuts[sequence],
        "begin": starts, "ids": ids,
    }


def pack(
    docs: DataFrame, vocabulary: str | None = None, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW,
    stretch: int = STRETCH, with_ids: bool = False,
) -> DataFrame:
    """One row per piece, in the order of ``docs``' partitions; ``with_ids`` adds the piece's ids (array of int).

    ``sequence_id`` is unique over all tasks. ``row`` numbers the documents of a task, so pieces of rows that share
    a doc_id can be told apart together with ``sequence_id >> 33``. ``docs`` should be a plain read of files: its
    partitions are then the same whenever a task is repeated.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _sentence_ends(vocabulary)
        first = TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        tokens = sequences = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, keys, tokens, sequences, rows
            p = pack_stretch(held, ends, window)
            names = pa.array(keys, type=pa.int64())
            columns = [
                names.take(pa.array(p["doc"])), pa.array(p["start"]), pa.array(p["length"]), pa.array(p["ids_crc32"]),
                pa.array(p["doc_tokens"]), pa.array(first + sequences + p["sequence"]), pa.array(p["offset"]),
                pa.array(rows + p["doc"]),
            ]
            labels = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                offsets = np.append(p["begin"], len(p["ids"])).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(p["ids"].astype(np.int32))))
                labels.append("ids")
            sequences += int(p["sequence"][-1]) + 1
            rows += len(held)
            held, keys, tokens = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=labels)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append(ids_of(value.as_py(), vocabulary))
                keys.append(key)
                tokens += len(held[-1])
                if tokens >= stretch:
                    yield flush()
        if held:
            yield flush()

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, schema)
