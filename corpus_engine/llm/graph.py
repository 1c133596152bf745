"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every node of ``edges`` (``a, b``); nodes have one root if and only if they are connected.

    In each round every node hooks onto the first of its neighbours and itself in an order drawn anew, hooks are
    followed one step further, and the graph is contracted; a star of any size falls together in a round or two, a
    path by a constant share. Neighbours are reduced within tasks before they meet, so a node with very many edges
    is no hot group. The rounds' hooks are followed in turn at the end. Null ends are left out.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, rounds = edges.filter("a <> b"), []
    while not left.isEmpty():
        place = lambda c, t=len(rounds): F.struct(F.xxhash64(F.lit(t), c).alias("at"), F.col(c).alias("to"))
        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy("a").agg(F.min(place("b")).alias("first"))
        hooks = stored(hooks.select(F.col("a").alias("node"), F.least("first", place("a"))["to"].alias("onto")))
        again = hooks.select(F.col("node").alias("_next"), F.col("onto").alias("_onto"))
        hooks = hooks.join(again, F.col("onto") == F.col("_next")).select("node", F.col("_onto").alias("onto"))
        for end in ("a", "b"):
            left = left.join(hooks, F.col(end) == F.col("node")).withColumn(end, F.col("onto")).drop("node", "onto")
        left = stored(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        rounds.append(hooks)
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id"))
    for hooks in rounds:
        labels = labels.join(hooks, F.col("root") == F.col("node"), "left").select("id", F.coalesce("onto", "root").alias("root"))
    return stored(labels)
