import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stmtflow.llm import packing
from tests.llm.helpers import DOC, odd_rows, stored

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: As the contract calls it: special tokens in a text are tokens.
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_tokenizers_library(tokenizer, text):
    text = text.encode("utf-8", "replace").decode()
    assert packing.ids_of(text, PATH).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_ids_of_all_documents(spark, tokenizer):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert packing.ids_of(r.text, PATH)[:-1].tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "é.", "<|", "endoftext|>", "12", "'s"]), max_size=12))
def test_ids_of_special_tokens(parts):
    assert packing.ids_of("".join(parts), PATH)[:-1].tolist() == PLAIN.encode("".join(parts), add_special_tokens=False).ids


def test_special_tokens_in_a_table(spark, tmp_path):
    docs = stored(spark, tmp_path, [(1, "a <|endoftext|> b", "en", "a", 17)])
    assert [p.ids for p in packing.pack(docs, PATH, with_ids=True).collect()] == [[64, 220, 50256, 275, 0]]


@pytest.mark.parametrize("text", [" " * 1_200_000, "a." + "\n" * 1_200_000 + "<|endoftext|>b", "x" + " \t\n" * 400_000])
def test_long_white_space(spark, tmp_path, text):
    ids = [*PLAIN.encode(text, add_special_tokens=False).ids, 0]
    docs = stored(spark, tmp_path, [(1, text, "en", "a", len(text)), (2, "b", "en", "a", 1)])
    pieces = packing.pack(docs, PATH, with_ids=True).where("doc_id = 1").orderBy("start").collect()
    assert [i for p in pieces for i in p.ids] == ids


def plain_best(at, penalty, window):
    """Least cost by trying every transition."""
    best = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            length = at[j] - at[i]
            if length <= window:
                pad = 0 if length & (length - 1) == 0 else window - length
                best[j] = min(best[j], best[i] + pad + penalty[j])
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([0, 4, 24])), min_size=1, max_size=60))
def test_queue_finds_the_optimum(steps):
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalty = np.array([0] + [p for _, p in steps])
    cuts = packing.best_cuts(at, penalty, 32)
    cost = 0
    for i, j in zip(cuts, cuts[1:]):
        length = int(at[j] - at[i])
        assert 0 < length <= 32
        cost += (0 if length & (length - 1) == 0 else 32 - length) + int(penalty[j])
    assert cost == plain_best(at.tolist(), penalty.tolist(), 32)


@pytest.mark.parametrize("stretch", [50, 1 << 20])
def test_round_trip(spark, tmp_path, tokenizer, stretch):
    rows = odd_rows()
    docs = stored(spark, tmp_path, [(*r, "x") for r in rows], DOC + ", sequence_id string")
    pieces = packing.pack(docs, PATH, stretch=stretch, with_ids=True).collect()
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p.sequence_id >> 33, p.row].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length == len(p.ids) > 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes())
    texts = []
    for own in by_row.values():
        own.sort(key=lambda p: p.start)
        ids = [i for p in own for i in p.ids]
        at = 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
        assert ids[-1] == 0
        texts.append((own[0].doc_id, tokenizer.decode(ids[:-1], skip_special_tokens=False)))
    key = lambda x: json.dumps(x)
    assert sorted(texts, key=key) == sorted(((r[0], r[1] or "") for r in rows), key=key)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_little_padding(spark):
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH)
    sizes = [r.n for r in pieces.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding < 0.015 * sum(sizes)
