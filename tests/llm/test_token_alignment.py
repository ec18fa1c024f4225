import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stmtflow.llm import token_alignment as ta
from tests.llm.helpers import DOC, odd_rows, stored

OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def _byte_level():
    """Byte of each character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    """All pairs of token occurrences, from the libraries as they are documented."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = _byte_level()
    out, count = [], Counter()
    for doc_id, text in rows:
        ids, spans = ([], []), ([], [])
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(chars[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ids = (ia, ib)
                for parts, into in zip((ba, bb), spans, strict=True):
                    at = 0
                    for p in parts:
                        into.append((at, at + len(p)))
                        at += len(p)
        linked = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        count.update((ids[0][i], ids[1][j]) for i, j in linked)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [
            "|".join(",".join(str(x) for x, (_, e) in zip(ids[k], spans[k], strict=True) if low < e <= high) for k in (0, 1))
            for low, high in zip([0, *cuts], cuts)
        ]
        out.append((doc_id, ids, linked, ";".join(groups), len(groups)))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (str(d), len(i[0]), len(i[1]), n, len(p), sum(count[i[0][x], i[1][y]] == best[i[1][y]] for x, y in p),
         sum(count[i[0][x], i[1][y]] for x, y in p), g)
        for d, i, p, g, n in out
    )


def got(df):
    return sorted((str(r.doc_id), *r[1:]) for r in df.select(*OUT).collect())


@pytest.mark.parametrize("chunk", [1, 700, 1 << 22])
def test_equals_all_pairs_of_occurrences(spark, tmp_path, chunk):
    rng = random.Random(12)
    some = ["naïve café", "日本語テキスト", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "a▁b", "👩‍👩‍👧", "x  y   z", "\t\t\n\n ", "ﬁﬂ", "ẞß", "1234567", "don't", "\u0000a"]
    extra = [(100 + i, " ".join(rng.choice(some) for _ in range(rng.randrange(1, 9))), "en", "a", 1) for i in range(40)]
    rows = [r for r in odd_rows(extra) if r[0] != 6] + [(60, "the words of a long text, " * 60, "en", "a", 1)]
    rows += [(700 + i, "one copy of many", "en", "a", 1) for i in range(30)]
    df = stored(spark, tmp_path, rows)
    assert got(ta.align(df, chunk=chunk)) == brute([(r[0], r[1]) for r in rows])


def test_digest_and_clashing_columns(spark, tmp_path):
    rows = [(1, "Some text here.", 5), (2, None, 6), (3, "", 7)]
    df = stored(spark, tmp_path, rows, "chunk long, pair string, known int").withColumnRenamed("pair", "groups")
    plain = ta.align(df, doc_id="chunk", text="groups").collect()
    digest = {r.doc_id: r.groups for r in ta.align(df, doc_id="chunk", text="groups", groups="sha256").collect()}
    assert len(plain) == 3 and {r.doc_id: r.groups and hashlib.sha256(r.groups.encode()).hexdigest() for r in plain} == digest
    assert digest[2] == digest[3] == ""


def test_empty_table(spark, tmp_path):
    assert ta.align(stored(spark, tmp_path, odd_rows()).where("false")).collect() == []
    assert got(ta.align(stored(spark, tmp_path, [(1, None, None, None, None)], DOC))) == [("1", 0, 0, 0, 0, 0, 0, "")]


def test_very_long_texts(spark, tmp_path):
    """A million spaces, on which the quick tokenizer gives up, and one word without an end."""
    rows = [(1, "a" + " " * 1_200_000 + "b", "en", "a", 1), (2, "x" * 50_000, "en", "a", 1)]
    out = {r.doc_id: r for r in ta.align(stored(spark, tmp_path, rows)).collect()}
    for i, text in ((1, rows[0][1]), (2, rows[1][1])):
        a, b = ta.sides(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
        ids = [int(x) for g in out[i].groups.split(";") for x in g.split("|")[0].split(",")]
        assert out[i].n_a == len(ids) == len(a.encode(" " + text)) and out[i].n_b == len(b.encode(text))
        assert out[i].n_links == out[i].n_a + out[i].n_b - out[i].n_groups


def test_links_are_held_for_a_part_of_a_chunk(spark, tmp_path, monkeypatch):
    """A chunk's links are made a few documents at a time, and its counts are those of the whole chunk."""
    texts = [None, "", "one copy of many", "x" * 300, "Some text here.", *["the words of a text " * (i % 5) for i in range(40)]]
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
    held, links = [], ta.links
    monkeypatch.setattr(ta, "links", lambda *of: held.append(links(*of)) or held[-1])
    batches = [
        ta.FirstPass(*paths, "bigint", "text", 1 << 22, part).rows(0, ta.pa.array(range(len(texts))), texts) for part in (1 << 20, 400)
    ]
    whole, parted = ({**b.to_pydict(), "known": dict(zip(b["known"][-1].as_py(), b["known_n"][-1].as_py(), strict=True))} for b in batches)
    assert all(whole[c] == parted[c] for c in (*ta.COUNTS, "doc_id", "groups", "known")) and len(held) > 5
    assert max(len(h) for h in held[1:]) < len(held[0]) / 2
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    assert got(ta.align(stored(spark, tmp_path, rows), part=400)) == brute([r[:2] for r in rows])
