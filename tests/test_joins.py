"""The join that splits frequent keys, against the plain one."""

import pytest
from pyspark.sql import functions as F

from corpus_engine.operators import joins as J
from corpus_engine.operators import retrieval as R
from corpus_engine.tables import order_docs
from tests.conftest import SMALL

LEFT = "k long, a long"
RIGHT = "k long, b long"


@pytest.mark.parametrize("part_rows", [1, 7, 40, 10_000])
def test_pairs_are_those_of_the_plain_join(spark, part_rows):
    left = spark.createDataFrame([(0, i) for i in range(60)] + [(i % 5, 100 + i) for i in range(20)] + [(None, 1), (77, 1)], LEFT)
    right = spark.createDataFrame([(0, i) for i in range(25)] + [(1, 5), (1, 5), (None, 2), (88, 1)], RIGHT)
    got = sorted(map(tuple, J.spread_join(left, right, ["k"], part_rows).select("k", "a", "b").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))


def test_beyond_the_keys_that_are_sent(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST_SENT", 0)
    left = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(30).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    joined = J.spread_join(left, right, ["k"], 5)
    assert "Broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == left.join(right, "k").count()


def test_empty_sides(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([(1, 1)], RIGHT)
    assert J.spread_join(left, right, ["k"], 1).count() == J.spread_join(right, left.withColumnRenamed("a", "c"), ["k"], 1).count() == 0


def test_one_file_in_all_scopes_is_spread(spark):
    """No task joins much more than the mean, though one file is in every scope and holds most chunks."""
    questions = spark.range(4_000).select(F.col("id").alias("qid"), F.array(F.lit(0.0).cast("float")).alias("qvec"))
    scope = questions.select("qid", F.explode(F.array(F.lit(0), F.col("qid") + 1)).alias("file_id"))
    own = spark.range(1, 4_001).select(F.col("id").alias("file_id"), F.lit(0).alias("chunk_index"))
    hot = spark.range(500).select(F.lit(0).cast("long").alias("file_id"), F.col("id").cast("int").alias("chunk_index"))
    store = own.unionByName(hot).select("*", F.lit("es").alias("language"), F.array(F.rand(1).cast("float")).alias("embedding"))
    asked = scope.join(questions, "qid")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = J.spread_join(asked, store, ["file_id"], 100)
        sizes = [r["n"] for r in split.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        plain = [r["n"] for r in asked.join(store, "file_id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == sum(plain) == 4_000 * 500 + 4_000
    assert max(plain) > 0.9 * sum(plain)
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def test_scoped_search_is_the_same_when_split(spark, monkeypatch):
    from corpus_engine import tables as T
    from tests.conftest import SMALL

    questions, store = T.context_questions(spark, SMALL), T.stored_chunks(spark, SMALL)
    scope = T.context_files(spark, SMALL).withColumnRenamed("context_id", "qid")
    want = R.search(questions, scope, store, k=5).select("qid", "file_id", "chunk_index", "rank").collect()
    plain = J.spread_join
    monkeypatch.setattr(R, "spread_join", lambda left, right, on: plain(left, right, on, 3))
    got = R.search(questions, scope, store, k=5).select("qid", "file_id", "chunk_index", "rank").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def joins_over(plan, column):
    """Joins that the rows of the table holding ``column`` pass in a logical plan; None if no such table is below."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    if not below:
        return 0 if column in plan.output().mkString(",") else None
    found = [n for n in (joins_over(c, column) for c in below) if n is not None]
    return max(found) + (plan.nodeName() == "Join") if found else None


def test_order_lines_pass_two_joins(spark):
    docs = order_docs(spark, SMALL)
    assert joins_over(docs._jdf.queryExecution().analyzed(), "l_suppkey") == 2
