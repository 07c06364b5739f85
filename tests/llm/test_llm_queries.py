"""Registered queries against their SQL, and the pipeline stage by stage against plain versions."""

import brute
import compare
import pytest
from llm_fixtures import none, odd  # noqa: F401

import corpus_pipeline
from tablescope.llm import bpe_codec, quality_rules
from tablescope.llm.queries import QUERIES, SQL
from tablescope.llm.shared import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, SF), compare.connect(SF), SQL[name]) is None


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, table):
    docs = table("documents")
    labels = table("labels")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    judged = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(judged)
    assert kept.columns == docs.columns

    before = [(r.doc_id, r.text) for r in kept.collect()]
    single = stages["ngram_jaccard"](spark, kept, SF)
    groups = brute.jaccard_groups(before, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    assert sorted(r.doc_id for r in single.collect()) == sorted(k for k, (_, c, _) in groups.items() if k == c)

    masked = {r.doc_id: r for r in stages["personal_data"](spark, docs, SF).collect()}
    for r in docs.collect():
        out, at = [], 0
        for start, kind, end in brute.base_spans(r.text):
            if start >= at:
                out += [r.text[at:start], f"<{brute.PATTERNS[kind][0]}>"]
            at = max(at, end)
        expected = "".join([*out, r.text[at:]])
        assert masked[r.doc_id].text == expected and masked[r.doc_id].n_chars == len(expected)

    mixed = stages["source_mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    size = {r.doc_id: len(brute.words(r.text)) for r in docs.collect()}
    total = sum(size[r.doc_id] for r in mixed.collect())
    assert abs(total - sum(size.values())) < 0.2 * sum(size.values())

    coder = bpe_codec.coder(bpe_codec.vocabulary(bpe_codec.VOCABULARY))
    encoded = {r.doc_id: r for r in stages["bpe"](spark, docs, SF).collect()}
    for r in docs.limit(40).collect():
        ids = coder.tokenizer.encode(r.text, add_special_tokens=False).ids
        assert encoded[r.doc_id].ids == ids and encoded[r.doc_id].n_tokens == len(ids)


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    folder = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (odd, none):
        rows = materialize(docs, "stage")
        for _, stage in corpus_pipeline.STAGES:
            rows = materialize(stage(spark, rows, folder), "stage")
        assert rows.count() <= 4 * odd.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.where("n_tokens <> size(ids)").count() == 0
