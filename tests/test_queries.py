"""Every registered query against its SQL, and what its plan must not hold."""

import pytest

import __spark_entry__ as driver
from corpus_engine.plans import registry
from tests.conftest import SMALL
from tests.harness import differences

# Those of the training-data operators have tests of their own.
QUERIES, ORACLES = dict(registry.QUERIES), dict(registry.ORACLES)
# Queries that write files or run a stream before they return.
EAGER = {n for n in QUERIES if n.split("_")[0] in ("s1", "s2", "s5", "s6", "s7", "s8", "r1", "r2")}
# These end in the steps of p15_question_search, whose plan is looked at.
EAGER |= {"t6_question_preview", "u5_question_modes"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    found = differences(QUERIES[name](spark, SMALL), con, ORACLES[name])
    assert not found, found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_has_no_pairwise_join(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan, node


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["qid", "context", "n_docs"]
    assert out.count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["p7_report_list"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderpriority,2-HIGH)" in plan
    assert "o_totalprice" not in plan


@pytest.mark.parametrize("name", ["a10_context_block", "a12_evidence_list", "x39_report_messages", "x40_metadata_prompts"])
def test_search_reads_a_stored_chunk_table(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # which cuts texts


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = QUERIES["w2_top_k_per_question"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
