"""Alignment of two tokenizers' tokens over the same bytes, with counts of linked ids over the whole corpus.

A (byte-level BPE, on a space and the text) and B (SentencePiece, which adds that space) cut the same bytes in two ways.
The first pass is a pipeline over Arrow arrays, a chunk of documents at a time:

* the lists of ids are flattened, with the parent index of each token; token sizes are taken from the vocabularies, and a
  cumulative sum that starts again with each document gives the byte at which each token ends;
* a full outer hash join (Acero) of both sides on (document, end) puts ends that both share into one row; sorted, with each gap
  filled from the next row, every row is one link: two tokens that overlap. Shared ends close the groups;
* ``Table.group_by`` counts the links of each document and of the chunk by id pair.

The chunk's counts are merged by Spark into counts of the corpus and the highest count of each B id. These go back to
the chunks that hold the pair, and each chunk's documents add them up. What is shuffled is one row per chunk and distinct pair, never one
per link, so the commonest pair has as many rows as there are chunks; a chunk has about ``CHUNK`` bytes of text. Tokens and links
are held for a part of a chunk only, about ``PART`` characters or one longer document. The first pass is a written table: a lost executor repeats nothing that was tokenized.

Defined results: texts null or empty, and texts whose tokens' joined bytes differ from space and text (as where a text has
U+2581 itself), have no tokens: zeros and an empty string; equal rows are documents of their own and all count; a null id
is kept; other columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.session import cut_lineage

#: Bytes of text after which a chunk is closed.
CHUNK = 4 << 20
#: Characters of text whose tokens and links a task holds at a time; of the parts of a chunk only the counts by document and pair stay.
PART = 1 << 19
#: What a pair's number is multiplied by: more than any id of B.
WIDTH = 1 << 31

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel:
    """Byte-level BPE from a file of ranks; special tokens are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path = path
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.binary())

    @property
    def slow(self):
        """The tokenizers library with the same vocabulary; it takes texts on which the quick one's pattern gives up."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path.removesuffix(".tiktoken") + ".json")
        made.encode_special_tokens = True
        return made

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except ValueError:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int32)


class Pieces:
    """SentencePiece pieces as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = pa.array([self._bytes(i) for i in range(self.model.get_piece_size())], pa.binary())

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.int32)


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *parts]), pa.int32()))


def _sums(values: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive ``counts`` values."""
    total = np.concatenate([[0], pc.cumulative_sum(values.cast(pa.int64())).to_numpy()])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def whole(texts: list[str | None], lists: pa.ListArray, tokens: pa.Array) -> np.ndarray:
    """For each text whether it has any and its tokens' bytes, joined, are a space and the text."""
    taken = pc.take(tokens, lists.flatten())
    joined = memoryview(taken.buffers()[2]).cast("B") if len(taken) else memoryview(b"")
    ends = np.cumsum(_sums(pc.binary_length(taken), np.diff(lists.offsets.to_numpy()))).tolist()
    starts = [0, *ends[:-1]]
    return np.array([bool(t) and joined[i:j] == b" " + t.encode() for t, i, j in zip(texts, starts, ends, strict=True)], dtype=bool)


def aligned_lists(texts: list[str | None], a: ByteLevel, b: Pieces) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids of both sides, without those of texts that one of them does not give back."""
    parts = [[side.encode(lead + t) if t else np.empty(0, np.int32) for t in texts] for side, lead in ((a, " "), (b, ""))]
    lists = [_lists(p) for p in parts]
    good = whole(texts, lists[0], a.tokens) & whole(texts, lists[1], b.tokens)
    if not good.all():
        lists = [_lists([ids if g else ids[:0] for ids, g in zip(p, good, strict=True)]) for p in parts]
    return lists[0], lists[1]


def _ends(lists: pa.ListArray, sizes: pa.Array, name: str) -> pa.Table:
    """(doc, end, id) of all tokens: a cumulative sum of their sizes, less what it was before the document."""
    ids, doc = lists.flatten(), pc.list_parent_indices(lists)
    end = pc.cumulative_sum(pc.take(sizes, ids))
    before = np.concatenate([[0], end.to_numpy()])[lists.offsets.to_numpy()[:-1]]
    return pa.table({"doc": doc, "end": pc.subtract(end, pc.take(pa.array(before, pa.int64()), doc)), name: ids})


def links(a: pa.ListArray, b: pa.ListArray, size_a: pa.Array, size_b: pa.Array) -> pa.Table:
    """One row per link in the order of the text: doc, end, a, b, and whether a token of A, and one of B, ends with it."""
    left, right = _ends(a, size_a, "a"), _ends(b, size_b, "b")
    met = left.join(right, ["doc", "end"], join_type="full outer", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")])
    one, two = met["a"].combine_chunks(), met["b"].combine_chunks()
    # where a side has no end, its next token covers these bytes; both end with the document, so nothing is filled from another
    return pa.table({
        "doc": met["doc"], "end": met["end"], "a": pc.fill_null_backward(one), "b": pc.fill_null_backward(two),
        "a_ends": pc.is_valid(one), "b_ends": pc.is_valid(two),
    })


@lru_cache(maxsize=2)
def _numbers(width: int) -> pa.Array:
    return pa.array([str(i) for i in range(width)], pa.string())


def group_texts(met: pa.Table, docs: int, width: int) -> list[str]:
    """Per document its groups as ``a1,a2|b1;a3|b2,b3``: they close where both sides end."""
    names = _numbers(width)
    closing = pc.and_(met["a_ends"], met["b_ends"]).to_numpy()

    def joined(side: str) -> pa.Array:
        ends = met[f"{side}_ends"].to_numpy()
        ids = pc.take(names, met[side].filter(pa.array(ends)).combine_chunks())
        upto = np.concatenate([[0], np.cumsum(ends)[closing]])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), ids), ",")

    groups = pc.binary_join_element_wise(joined("a"), joined("b"), "|")
    per = np.bincount(met["doc"].to_numpy()[closing], minlength=docs)
    offsets = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, groups), ";").to_pylist()


def _parts(texts: list[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Consecutive documents of about ``size`` characters: from and upto."""
    start, held = 0, 0
    for i, t in enumerate(texts, 1):
        held += len(t or "")
        if held >= size or i == len(texts):
            yield start, i
            start, held = i, 0


class FirstPass:
    """The map over batches: a row per document, and a row per chunk with its distinct pairs and their counts."""

    def __init__(self, path_a: str, path_b: str, id_type: str, groups: str, chunk: int, part: int):
        self.paths, self.groups, self.chunk, self.part = (path_a, path_b), groups, chunk, part
        self.schema = (
            f"chunk bigint, doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, `groups` string, "
            "pairs array<int>, times array<int>, known array<bigint>, known_n array<bigint>"
        )

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column(0).type
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size >= self.chunk:
                    yield self.rows(number, pa.array(ids, kind), texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if texts:
            yield self.rows(number, pa.array(ids, kind), texts)

    def counted(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For some documents: the four counts, the groups, how many distinct pairs each has, and these pairs with their counts."""
        a, b = sides(*self.paths)
        n = len(texts)
        in_a, in_b = aligned_lists(texts, a, b)
        met = links(in_a, in_b, *(pc.binary_length(s.tokens).cast(pa.int64()) for s in (a, b)))
        doc = met["doc"].to_numpy()
        closing = pc.and_(met["a_ends"], met["b_ends"]).to_numpy()
        counts = [np.diff(in_a.offsets), np.diff(in_b.offsets), np.bincount(doc[closing], minlength=n), np.bincount(doc, minlength=n)]
        texts_of = group_texts(met, n, max(len(a.tokens), len(b.tokens)))
        if self.groups == "sha256":
            texts_of = [t and hashlib.sha256(t.encode()).hexdigest() for t in texts_of]
        pair = pc.add(pc.multiply(met["a"].cast(pa.int64()), WIDTH), met["b"].cast(pa.int64()))
        each = pa.table({"doc": met["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        each = each.sort_by("doc")
        return counts, texts_of, np.bincount(each["doc"].to_numpy(), minlength=n), each["pair"].to_numpy(), each["count_all"].to_numpy()

    def rows(self, number: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        n = len(texts)
        parts = [self.counted(texts[i:j]) for i, j in _parts(texts, self.part)]
        pa.default_memory_pool().release_unused()
        counts = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
        texts_of = [t for p in parts for t in p[1]]
        sizes, pairs, times = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        pair = pc.dictionary_encode(pa.array(pairs, pa.int64()))
        known = np.bincount(pair.indices.to_numpy(), weights=times, minlength=len(pair.dictionary)).astype(np.int64)

        def column(values: object, kind: pa.DataType) -> pa.Array:
            """The documents' values and a null for the chunk's own row."""
            made = values if isinstance(values, pa.Array) else pa.array(values, kind)
            return pa.concat_arrays([made.cast(kind), pa.nulls(1, kind)])

        def own(values: pa.Array) -> pa.Array:
            """Nulls for the documents, and all values as one list for the chunk's own row."""
            kind = pa.list_(pa.int64())
            return pa.concat_arrays([pa.nulls(n, kind), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)])

        long, ints = pa.int64(), pa.list_(pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (pair.indices.to_numpy(), times)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, number), long), column(ids, ids.type), *[column(c.astype(np.int64), long) for c in counts],
                column(texts_of, pa.string()), *[column(v, ints) for v in lists], own(pair.dictionary), own(pa.array(known, long)),
            ],
            names=["chunk", "doc_id", *COUNTS, "groups", "pairs", "times", "known", "known_n"],
        )


def _add_up(id_type: str):
    """The counts of the corpus added up over each document's links; one chunk at a time."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        look = np.zeros((2, 1 + max(counts["place"].to_pylist(), default=0)), dtype=np.int64)
        look[:, counts["place"].to_numpy()] = [counts["count"].to_numpy(), counts["best"].to_numpy().astype(np.int64)]
        pairs, times = (docs[c].combine_chunks() for c in ("pairs", "times"))
        each, place, often = np.diff(pairs.offsets), pairs.flatten().to_numpy(), times.flatten().to_numpy()
        total, best = (_sums(pa.array(look[k][place] * often), each) for k in (0, 1))
        return docs.select(["doc_id", *COUNTS, "groups"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return run, f"doc_id {id_type}, {counts}, `groups` string, n_best bigint, count_sum bigint"


def align(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, *, doc_id: str = "doc_id", text: str = "text",
    groups: str = "text", chunk: int = CHUNK, part: int = PART,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum), a row per row of ``docs``.

    ``path_a`` is a byte-level BPE vocabulary as ranks (its ``.json`` lies beside it), ``path_b`` a SentencePiece model.
    ``groups`` is ``text`` for the aligned groups themselves, or ``sha256`` for their digest.
    """
    import public_tokenizers

    path_a = path_a or public_tokenizers.path("byte_bpe_50k.tiktoken")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[doc_id].dataType.simpleString()
    first = FirstPass(path_a, path_b, kind, groups, chunk, part)
    done = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(first, first.schema))
    rows = done.where("known is null").drop("known", "known_n")
    known = done.where("known is not null").select("chunk", F.posexplode(F.arrays_zip("known", "known_n")).alias("place", "k"))
    known = known.select("chunk", "place", F.col("k.known").alias("pair"), F.col("k.known_n").alias("n"))
    counts = known.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b: Column = F.col("pair") % WIDTH
    top = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("highest"))
    # one row per id of B at most
    flagged = counts.withColumn("b", of_b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = known.drop("n").join(flagged, "pair").select(F.col("chunk").alias("of"), "place", "count", "best")
    add, schema = _add_up(kind)
    return rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(add, schema)
