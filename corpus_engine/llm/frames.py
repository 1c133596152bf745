"""Small helpers on frames that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpus_engine.session import cut_lineage

#: The white space that separates words and is stripped from lines.
WHITE = "\\x20\\x09-\\x0D"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later uses and lost executors don't compute it again."""
    return cut_lineage(df)


@contextmanager
def text_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Queries that run inside hand texts to Python in batches of so many rows, which bounds what a task holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def in_bucket(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; rows without a key don't."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == remainder, F.lit(False))


def extended(df: DataFrame, **fields: str) -> StructType:
    """The schema of ``df`` with more fields, by name and type."""
    out = StructType(list(df.schema.fields))
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out
