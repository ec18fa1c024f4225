import math
from collections import Counter, defaultdict

import pytest

from stmtflow.llm import mixing, sharding
from tests.llm.helpers import DOC, odd_rows, stored


def plain(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("bucket", [200, 1 << 20])
def test_shards_are_even_and_whole(spark, tmp_path, bucket):
    rows = odd_rows([(9, "the same", "en", "a", 8)] * 200)
    docs = stored(spark, tmp_path, [(*r, 1) for r in rows], DOC + ", slot int")
    out = sharding.shuffle_shards(docs, 8, bucket_bytes=bucket)
    got = out.collect()
    assert plain(r[: len(DOC.split(", "))] for r in [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in got]) == plain(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in got} == {"rows"}
    again = sharding.shuffle_shards(docs, 8, bucket_bytes=bucket).collect()
    assert plain(got) == plain(again)
    assert sharding.shuffle_shards(docs, 8, seed=21, bucket_bytes=bucket).collect() != got


def test_shuffle_is_uniform(spark, tmp_path):
    """Each record falls into each shard equally often over seeds."""
    docs = stored(spark, tmp_path, [(i, "x" * 50, "en", "a", 50) for i in range(64)])
    seen = Counter()
    for seed in range(12):
        for r in sharding.shuffle_shards(docs, 4, seed=seed, bucket_bytes=1500).select("doc_id", "shard").collect():
            seen[r.doc_id < 32, r.shard] += 1
    assert all(60 <= n <= 132 for n in seen.values()), seen


def test_shards_are_written(spark, tmp_path):
    docs = stored(spark, tmp_path, odd_rows())
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert plain(tuple(r[c] for c in docs.columns) for r in back.collect()) == plain(odd_rows())
    assert {r.shard for r in back.collect()} == {0, 1, 2}
    assert sharding.shuffle_shards(docs.where("false")).count() == 0


def earliest_deadline_first(blocks):
    """Slots of one round by a plain simulation."""
    total, had, out = sum(blocks), [0] * len(blocks), []
    for t in range(total):
        ready = [(math.ceil((had[i] + 1) * total / b), i) for i, b in enumerate(blocks) if had[i] < b and had[i] * total // b <= t]
        due, i = min(ready)
        assert t < due
        out.append((i, had[i], t, had[i] * total // blocks[i], due))
        had[i] += 1
        for j, b in enumerate(blocks):
            assert b == 0 or abs(had[j] - b * (t + 1) / total) < 1  # less than one block off
    return out


def test_schedule_is_pfair(spark):
    blocks, shares = [47, 9, 0, 3, 130], [10, 4, 5, 1, 7]
    got = defaultdict(list)
    for r in mixing._schedule(spark, blocks, shares).collect():
        got[r.kind].append((r.stream, r.j, r.turn, r.release, r.due))
    rounds = max(-(-n // a) for n, a in zip(blocks, shares))
    for p in range(rounds):
        kind = max(k for k in got if k <= p)
        left = [max(0, min(a, n - p * a)) for n, a in zip(blocks, shares)]
        assert sorted(got[kind], key=lambda x: x[2]) == earliest_deadline_first(left)


def simulated(slots_by_stream, shares):
    """Stream of each slot of the whole mix."""
    out, p = [], 0
    while True:
        left = [max(0, min(a, n - p * a)) for n, a in zip(slots_by_stream, shares)]
        if not sum(left):
            return out
        out += [i for i, *_ in earliest_deadline_first(left)]
        p += 1


@pytest.mark.parametrize("recipe", [None, {"a": 3, "b": 1}, {"a": 2, "zzz": 9, "*": 4}])
def test_mix_follows_the_schedule(spark, tmp_path, recipe):
    many = [(100 + i, "y" * (i % 90), "en", "hot" if i % 3 else "b", i) for i in range(600)]
    rows = odd_rows(many)
    docs = stored(spark, tmp_path, rows)
    got = mixing.mix(docs, recipe, block_bytes=500, period=20).collect()
    assert plain(tuple(r[c] for c in docs.columns) for r in got) == plain(rows)
    sizes = Counter()
    for r in got:
        sizes[r.stream] += len((r.text or "").encode()) + 1
    keys = sorted(sizes, key=lambda s: s if s in ("*", "!") else "=" + s)
    blocks = [-(-sizes[k] // 500) for k in keys]
    # blocks of a stream lie in their order; every row begins inside its block and after those before it
    for k in keys:
        own = sorted((r.block, r.offset, len((r.text or "").encode()) + 1) for r in got if r.stream == k)
        at = 0
        for block, offset, size in own:
            assert block * 500 + offset == at
            at += size
    if recipe is None:
        n = Counter(r.source if r.source is not None else "!" for r in got)
        whole = sum(v**0.5 for v in n.values())
        assert set(keys) <= {*n, "*"} and sum(v**0.5 / whole * 20 >= 0.5 for v in n.values()) in (len(keys), len(keys) - 1)
        shares = [max(1, round(20 * n[k] ** 0.5 / whole)) if k in n else 1 for k in keys]
    else:
        shares = [recipe.get(k, recipe.get("*", 1)) for k in keys]
    if "*" not in keys or recipe is not None:
        order = simulated(blocks, shares)
        nth, place = Counter(), {}
        for slot, i in enumerate(order):
            place[keys[i], nth[i]] = slot
            nth[i] += 1
        assert all(r.slot == place[r.stream, r.block] and r.release <= r.slot < r.deadline for r in got)


def test_mix_of_nothing_and_order(spark, tmp_path):
    docs = stored(spark, tmp_path, odd_rows(), DOC)
    assert mixing.mix(docs.where("false")).count() == 0
    renamed = docs.withColumnRenamed("lang", "slot")
    rows = mixing.mix(renamed, block_bytes=64, ordered=True).collect()
    assert [(r.slot, r.offset) for r in rows] == sorted((r.slot, r.offset) for r in rows) and len(rows) == len(odd_rows())
