"""The last turns of every conversation, kept as state while turns arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "conv_id long, turn long, role string, text string"
RECENT = 10


def last_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last turns of each conversation in an Arrow batch, so that little of a busy one is shuffled."""
    for pdf in batches:
        yield pdf.sort_values(["conv_id", "turn"]).groupby("conv_id").tail(RECENT)


def keep_recent(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turns, roles, texts = state.get if state.exists else ([], [], [])
    kept = pd.DataFrame({"turn": list(turns), "role": list(roles), "text": list(texts)})
    for pdf in batches:
        joined = pd.concat([kept, pdf[["turn", "role", "text"]]]) if len(kept) else pdf[["turn", "role", "text"]]
        kept = joined.drop_duplicates("turn").sort_values("turn").tail(RECENT)
    state.update((kept["turn"].tolist(), kept["role"].tolist(), kept["text"].tolist()))
    speaker = kept["role"].map(lambda r: "USUARIO: " if r == "user" else "ASISTENTE: ")
    yield pd.DataFrame(
        {"conv_id": [key[0]], "n_turns": [len(kept)], "history": ["\n".join(speaker + kept["text"])]}
    )


def recent_turns(turns: DataFrame) -> DataFrame:
    """Current history of each conversation that got new turns; system turns do not count."""
    heard = turns.filter(F.col("role") != "system").select("conv_id", "turn", "role", "text")
    return (
        heard.mapInPandas(last_of_batch, TURN)
        .groupBy("conv_id")
        .applyInPandasWithState(
            keep_recent,
            "conv_id long, n_turns long, history string",
            "turns array<long>, roles array<string>, texts array<string>",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )


def keep_latest(histories: DataFrame, table: str, checkpoint: str):
    """Starts a query that writes every batch of histories to its own folder of ``table``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        histories.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(stored: DataFrame) -> DataFrame:
    """Newest stored history of each conversation."""
    newest = F.max_by(F.struct("n_turns", "history"), "batch_id")
    return stored.groupBy("conv_id").agg(newest.alias("h")).select("conv_id", "h.n_turns", "h.history")
