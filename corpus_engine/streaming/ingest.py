"""Incremental ingest: new files become chunks, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.operators.chunks import chunk_files
from corpus_engine.operators.ingest import chunk_table


LEDGER = "file_id long, batch_id long"


def ledger_of(table: str) -> str:
    """Folder with one row per stored file, beside the chunk table."""
    return f"{table.rstrip('/')}_files"


def rejected_of(table: str) -> str:
    """Folder with the routed files that can't be read, as they came, beside the chunk table."""
    return f"{table.rstrip('/')}_rejected"


def stored_files(spark: SparkSession, table: str, before: int) -> DataFrame:
    """Ids of files that earlier batches stored; a batch that runs again does not see itself."""
    rows = spark.read.schema(LEDGER).parquet(ledger_of(table))
    return rows.filter(F.col("batch_id") < before).select("file_id").distinct()


def cut_files(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Chunk rows of a batch, and files that can't be read: routed files by their route, plain (``file_id``, ``text``)
    rows as texts, all of which can be read."""
    return chunk_table(files) if "route" in files.columns else (chunk_files(files), None)


def ingest(texts: DataFrame, table: str, checkpoint: str):
    """Starts a query that chunks the streamed files into ``table``, as a batch would.

    Rows are (``file_id``, ``text``), or routed files with ``filename, document_type, route`` as well.

    A batch writes its own folder and replaces it when it is run again after a failure; files that an
    earlier batch stored are left out, by a ledger with one row per file. So every file is stored exactly
    once; of several texts with one id the smallest counts, in any run. Routed files that can't be read
    are rows of the table ``rejected_of(table)`` and count as stored.
    """
    spark = texts.sparkSession
    # The ledger begins with an empty batch, so that it can be read before anything is stored.
    spark.createDataFrame([], "file_id long").write.mode("ignore").parquet(f"{ledger_of(table)}/batch_id=-1")

    def store(batch: DataFrame, batch_id: int) -> None:
        done = stored_files(batch.sparkSession, table, batch_id)
        rest = [c for c in batch.columns if c not in ("file_id", "text")]
        least = F.min(F.struct("text", *rest)).alias("least")
        fresh = batch.groupBy("file_id").agg(least).select("file_id", "least.*").join(done, "file_id", "left_anti")
        chunks, rejected = cut_files(fresh)
        chunks.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        if rejected is not None:
            rejected.write.mode("overwrite").parquet(f"{rejected_of(table)}/batch_id={batch_id}")
        fresh.select("file_id").write.mode("overwrite").parquet(f"{ledger_of(table)}/batch_id={batch_id}")

    return (
        texts.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
