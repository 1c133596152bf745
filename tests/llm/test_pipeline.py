"""The stages of the pipeline, each judged on its own input."""

import pytest

import corpus_pipeline
from corpus_engine.llm import frames
from corpus_engine.llm.frames import stored
from tests.conftest import SMALL
from tests.llm.test_edges import ROWS
from tests.llm.test_queries import components_by_brute_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_turn(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL))
        assert out.columns == documents.columns, name
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "near copies":
            assert set(after) == {i for i, (_, root) in components_by_brute_force(before).items() if i == root}
        elif name == "test items":
            items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert not any(item in t for t in after.values() for item in items)
        elif name == "lines":
            assert len(after) == len(before) and sum(map(len, after.values())) < sum(map(len, before.values()))
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert mixed.count() == docs.count()


def test_odd_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS + ROWS[:2]], SCHEMA)
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.count() <= docs.count()
    kept = corpus_pipeline.keep_one_of_near_copies(spark, rows, SMALL).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6, 8, 9, 10]


@pytest.mark.parametrize("name", ["language", "lines", "test items"])
def test_texts_reach_python_in_small_batches(spark, documents, monkeypatch, name):
    """Every step that hands texts to Python is written inside the stage, while batches are small."""
    key, write, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", frames.cut_lineage, []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(df):
        if "MapInArrow" in plan(df):
            seen.append(int(spark.conf.get(key)))
        return write(df)

    monkeypatch.setattr(frames, "cut_lineage", watched)
    before = spark.conf.get(key)
    out = dict(corpus_pipeline.STAGES)[name](spark, documents, SMALL)
    assert seen and max(seen) <= 500 < int(before) == int(spark.conf.get(key))
    assert "MapInArrow" not in plan(out)
