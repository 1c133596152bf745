"""Places of rows in a global order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.frames import stored


def ranked(rows: DataFrame, group: Column, order: list[Column]) -> DataFrame:
    """``rows`` with ``_group``, ``_rank`` (from 0, in ``order`` inside the group) and ``_last``, the group's last rank.

    ``_group`` is a number that rises with the value of ``group``; null comes first and is a group too. The rows are
    sorted over all tasks and written, each with its task and its place there; counts per task and group then give
    where a task's part of a group begins. So a group of any size is spread over many tasks, and so are rows that
    are equal in everything, which stand in the order they were read in.
    """
    spread = rows.withColumn("_key", group).withColumn("_row", F.monotonically_increasing_id())
    placed = spread.orderBy(F.col("_key").asc_nulls_first(), *order, "_row").drop("_row").withColumn("_place", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_task", F.shiftright("_place", 33)))
    # One row per task and group that meet: their number follows the tasks and the groups, not the rows.
    parts = placed.groupBy("_task", "_key").agg(F.min("_place").alias("_low"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_key")
    earlier = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_task").alias("_t"),
        F.col("_key").alias("_k"),
        F.min("_low").over(whole).alias("_group"),
        (F.sum("_n").over(whole) - 1).alias("_last"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_low")).alias("_shift"),
    )
    found = placed.join(stored(parts), (F.col("_task") == F.col("_t")) & F.col("_key").eqNullSafe(F.col("_k")))
    return found.withColumn("_rank", F.col("_place") + F.col("_shift")).drop("_task", "_place", "_key", "_t", "_k", "_shift")
