from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from stmtflow.llm import mixing, personal_data, quality_rules
from stmtflow.llm.common import table
from tests.llm.helpers import stored
from tests.llm.test_jaccard_join import plain_groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, FOLDER, "documents"), []
    out.append(docs)
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
        out.append(docs)
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_pass_on_the_columns(steps):
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "jaccard_join", "personal_data", "mix_sources", "pack"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_each_stage_takes_effect(spark, steps):
    start, good, distinct, clean, mixed, pieces = steps
    verdict = {r.doc_id: r.kept for r in quality_rules.report(start, table(spark, FOLDER, "labels")).collect()}
    assert rows(good) == Counter(r for r in rows(start).elements() if verdict[r[0]])
    before = [tuple(r) for r in good.collect()]
    groups, _ = plain_groups(before)
    least = {}
    for g, r in zip(groups, before):
        least[g] = min(least.get(g, r), r)
    assert rows(distinct) == Counter(least.values())
    texts = {r.doc_id: r.text for r in distinct.collect()}
    for r in clean.collect():
        base = personal_data.base_spans(texts[r.doc_id])
        assert (r.text == texts[r.doc_id]) == (not base) and personal_data.base_spans(r.text) == [] and r.n_chars == len(r.text)
    assert rows(mixed) == rows(clean)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in mixed.collect()}
    per_doc = defaultdict(list)
    for p in pieces.collect():
        per_doc[p.doc_id].append((p.start, p.length, p.doc_tokens))
    for own in per_doc.values():
        at = 0
        for start_at, length, tokens in sorted(own):
            assert start_at == at
            at += length
        assert at == tokens


def test_packing_keeps_the_order_of_the_mix(spark, tmp_path):
    rows_ = [(i, "word " * (1 + i * i % 97), "en", "ab"[i % 3 == 0], 0) for i in range(120)]
    made = mixing.mix(stored(spark, tmp_path, rows_), block_bytes=300, ordered=True)
    made.write.option("maxRecordsPerFile", 9).parquet(str(tmp_path / "mixed"))
    docs = spark.read.parquet(str(tmp_path / "mixed"))
    assert len(docs.inputFiles()) >= 12
    place = {r.doc_id: (r.slot, r.offset) for r in docs.collect()}
    pieces = cp.packed(spark, docs, FOLDER).orderBy("sequence_id", "offset").collect()
    order = [place[p.doc_id] for p in pieces if p.start == 0]
    assert len(order) == 120 and order == sorted(order)


def test_run_equals_the_stages(spark, steps):
    # the order of the mix follows the place of rows in files, so cuts may differ from run to run, the documents not
    tokens = [rows(df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"})) for df in (cp.run(spark, FOLDER), steps[-1])]
    assert tokens[0] == tokens[1]


def test_stages_on_an_empty_table_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, place string, kept string"
    rows_ = [(1, "word " * 60 + "end", "en", None, None, "p", "k"), (2, None, None, None, None, None, None)]
    for data in (rows_, []):
        docs = stored(spark, tmp_path, data, schema, f"docs{len(data)}")
        for i, (_, stage) in enumerate(cp.STAGES):
            done = stage(spark, docs, FOLDER)
            if i < 4:
                assert done.columns == docs.columns
            assert done.count() <= max(1, len(data)) * 3 if data else done.count() == 0
