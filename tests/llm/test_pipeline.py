"""Registered queries against their SQL; the pipeline stage by stage against its operators' brute-force versions."""

import public_tokenizers
import pytest

import corpus_pipeline
from answerloom.llm.packing import word_ids
from answerloom.llm.queries import ORACLE, QUERIES
from compare import difference, duck
from test_dedup import brute_lines, brute_passages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert difference(spark, duck(SF), SF, QUERIES[name], ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 200


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.dtypes, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after_df = stage(spark, spark.createDataFrame(list(before.values()), docs.schema), SF)
        assert after_df.dtypes == columns
        after = {r.doc_id: r for r in after_df.collect()}
        kept[name] = len(after)
        pairs = [(i, r.text) for i, r in before.items()]
        if name == "line dedup":
            assert {i: r.text for i, r in after.items()} == {i: t for i, _, _, t in brute_lines(pairs, 10)}
        elif name == "substring dedup":
            assert {i: " ".join(r.text.split()) for i, r in after.items()} == {i: t for i, _, _, t in brute_passages(pairs)}
        else:
            assert set(after) < set(before) and all(after[i] == before[i] for i in after)
        assert all(r.n_chars == len(r.text) for r in after.values())
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(list(before.values()), docs.schema), SF)
    tokens = {r.doc_id: r.doc_tokens for r in last.collect()}
    assert set(tokens) == set(before)
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, SF).collect()} == tokens


def test_last_stage_returns_tokens(spark):
    docs = spark.createDataFrame([(1, "one text " * 3000), (2, "another text"), (3, None)], "doc_id long, text string")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    coder = word_ids(public_tokenizers.path("word_bpe_49k.json"), 2)
    for r in docs.collect():
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == r.doc_id)
        assert b"".join(x for _, x in own) == coder.whole(r.text or "") + (2).to_bytes(4, "little")


def test_stages_on_odd_rows(spark, documents, nothing):
    """Nulls, empty and long texts, repeated rows, rows without an id, empty tables and columns of clashing names go through every stage."""
    docs, columns = documents, documents.dtypes
    for frame in (documents, nothing):
        before = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, SF)
            assert [c for c in after.dtypes if c[0] != "n_chars"] == columns
            if frame is nothing:
                assert after.count() == 0
            elif name in ("line dedup", "substring dedup"):  # no row goes
                assert sorted(map(str, (r.doc_id for r in after.collect()))) == sorted(map(str, (r.doc_id for r in before.collect())))
            elif name == "MinHash near-dedup":
                assert after.filter("doc_id is null").count() == before.filter("doc_id is null").count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
        assert pieces.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()
    assert docs.count() > 100
