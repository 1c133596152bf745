"""Conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECENT = 10
TITLE_CHARS = 255


def without_system(turns: DataFrame) -> DataFrame:
    return turns.filter(F.col("role") != "system")


def recent_history(turns: DataFrame, recent: int = RECENT) -> DataFrame:
    """Text block of the last turns of every conversation, oldest of them first.

    Each partition keeps at most ``recent`` turns of a conversation before the shuffle.
    """
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    last = turns.withColumn("age", newest).filter(F.col("age") <= recent)
    speaker = F.when(F.col("role") == "user", "USUARIO: ").otherwise("ASISTENTE: ")
    lines = last.withColumn("line", F.concat(speaker, "text"))
    return lines.groupBy("conv_id").agg(
        F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY turn)").alias("history"),
        F.count(F.lit(1)).alias("n_turns"),
    )


def history_listing(
    histories: DataFrame, bridge: DataFrame, contexts: DataFrame, workspaces: DataFrame
) -> DataFrame:
    """Histories with their contexts and workspaces, newest first, one row per context."""
    placed = contexts.select("context_id", F.col("title").alias("context_title"), "workspace_id").join(
        workspaces.select("workspace_id", F.col("title").alias("workspace_title")), "workspace_id", "left"
    )
    joined = histories.join(bridge, "conv_id", "left").join(placed, "context_id", "left")
    context = F.struct(
        F.col("context_id").alias("id"),
        F.col("context_title").alias("title"),
        F.struct(F.col("workspace_id").alias("id"), F.col("workspace_title").alias("title")).alias("workspace"),
    )
    return joined.select("conv_id", "title", "created", context.alias("context")).orderBy(
        F.col("created").desc(), "conv_id", "context_id"
    )
