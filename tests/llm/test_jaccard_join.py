import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stmtflow.llm import jaccard_join as jj
from tests.llm.helpers import DOC, odd_rows, stored


def plain_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    k = min(size, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def plain_groups(rows, size=5):
    """Group number of each row, by comparing every pair."""
    sets = [plain_set(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


def expected(rows):
    groups, sets = plain_groups(rows)
    least = {}
    for g, r in zip(groups, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return Counter((r[0], len(s), least.get(g)) for g, r, s in zip(groups, rows, sets))


def family(rng, start, size, length, edits):
    """Copies of copies: each changes some words of an earlier one."""
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(length)]]
    while len(texts) < size:
        new = list(rng.choice(texts))
        for _ in range(rng.randrange(edits + 1)):
            new[rng.randrange(length)] = f"w{rng.randrange(10**6)}"
        texts.append(new)
    return [(start + i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]


def test_files_of_one_name_in_several_folders(spark, tmp_path):
    """A partitioned table has the same file name in each folder; its rows are told apart all the same."""
    rng = random.Random(8)
    rows = []
    for i in range(90):
        text = rows[-1][1] if i % 3 == 1 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        rows.append((i, text, f"l{rng.randrange(4)}", "a", 0))
    path = str(tmp_path / "parted")
    spark.createDataFrame(rows, DOC).coalesce(1).write.partitionBy("lang").parquet(path)
    docs = spark.read.parquet(path)
    assert Counter(tuple(r) for r in jj.near_duplicates(docs).collect()) == expected(rows)
    assert jj.one_of_each_group(docs).count() == 60


@pytest.mark.parametrize(("small", "rounds"), [(32, 6), (2, 6), (2, 1), (4, 2)])
def test_groups_equal_all_pairs(spark, tmp_path, small, rounds):
    rng = random.Random(small * 10 + rounds)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = odd_rows()
    rows += family(rng, 100, 60, 60, 3) + family(rng, 200, 25, 150, 6) + family(rng, 300, 12, 9, 1)
    rows += [(400 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice((5, 12, 16, 40)))), "de", "b", 0) for i in range(40)]
    rows += [(500 + i, "Same Words here as ever and ever", "de", "b", 0) for i in range(30)]
    rng.shuffle(rows)
    docs = stored(spark, tmp_path, rows)
    got = jj.near_duplicates(docs, small=small, rounds=rounds).collect()
    assert Counter(map(tuple, got)) == expected(rows)


def test_links_of_texts_whose_sizes_do_not_fit_the_pivot(spark, tmp_path):
    """Pairs that meet only in the passages of two families, one of them too short for a link to either family."""
    names = iter(range(10**6))
    own = lambda n: [f"w{next(names)}" for _ in range(n)]
    texts = []
    for length in (96, 100, 103):
        first, second, usual, other = own(80), own(14), own(49), own(115)
        for _ in range(8):
            texts += [first + usual + own(1), second + other + own(1), usual + own(10), other + own(25)]
        texts += [first + second + own(length - 94), first + second + own(12)]
    rows = [(i, " ".join(t), "en", "a", 0) for i, t in enumerate(texts)]
    groups, sets = plain_groups(rows, 1)
    least = {g: groups.index(g) for g in groups}
    docs = stored(spark, tmp_path, rows)
    got = jj.near_duplicates(docs, words=1, small=4).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, groups))


def test_open_regions_meet_in_blocks(spark, tmp_path, monkeypatch):
    """A family of near copies and changed copies around it, in blocks of a few texts and without further pivots."""
    monkeypatch.setattr(jj, "BLOCK", 5)
    rng = random.Random(9)
    rows = family(rng, 0, 40, 60, 3)
    for i in range(25):  # changed too much for the family, and some near each other
        text = rng.choice(rows)[1].split()
        for _ in range(5):
            text[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(text), "en", "a", 0))
    docs = stored(spark, tmp_path, rows)
    assert Counter(tuple(r) for r in jj.near_duplicates(docs, small=2, rounds=0).collect()) == expected(rows)


def test_counts_of_common_shingles():
    rng = random.Random(10)
    sets = [jj.np.unique(jj.np.array([rng.randrange(60) for _ in range(rng.randrange(40))], dtype=jj.np.uint64)) for _ in range(30)]
    got = [c.tolist() for c in jj.common_counts(sets[:12], sets[12:])]
    assert got == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[12:]] for a in sets[:12]]
    assert [c.tolist() for c in jj.common_counts(sets[:1], [])] == [[]] and list(jj.common_counts([], sets)) == []


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(7)
    rows = odd_rows(family(rng, 100, 20, 60, 2) + [(90, "a b c d e f g", "en", "a", 1)] * 9)
    docs = stored(spark, tmp_path, [(*r, i) for i, r in enumerate(rows)], DOC + ", place int")
    kept = jj.one_of_each_group(docs, small=4)
    assert kept.columns == docs.columns
    groups, sets = plain_groups(rows)
    stay = [r.place for r in kept.collect()]
    assert len(stay) == len(set(stay))
    assert {i for i, s in enumerate(sets) if not s} <= set(stay)
    assert sorted(groups[i] for i in stay if sets[i]) == sorted({g for g, s in zip(groups, sets) if s})
    assert jj.one_of_each_group(docs.where("false")).count() == 0
    assert jj.near_duplicates(docs.where("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbB \t\n\x0b\x1c\x85é\u2003İ", max_size=60), st.integers(1, 6))
def test_shingles_count_like_words(text, size):
    assert len(jj.shingles(text, size)) == len(plain_set(text, size))


def test_set_identity_ignores_order_and_case():
    assert (jj.shingles("A b  C\td e f") == jj.shingles(" a B c d E F\n")).all()
    long = " ".join(str(i) for i in range(200_000))
    assert len(jj.shingles(long)) == 199_996


@pytest.mark.parametrize("length", [1, 5, 40])
def test_components_of_chains(spark, length):
    links = [(i, 1, i + 1, 1) for i in range(length)] + [(500, 2, 501, 2)]
    got = jj.components(spark.createDataFrame(links, "key long, n long, pkey long, pn long")).collect()
    assert {(r.key, r.group.key) for r in got} == {(i, 0) for i in range(length + 1)} | {(500, 500), (501, 500)}
