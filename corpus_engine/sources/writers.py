"""Sinks: the chunk table, GeoJSON, report texts and tabular reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.session import cut_lineage


def chunk_rows(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunk rows with the metadata record of their file."""
    named = chunks.join(files.select("file_id", "filename", "document_type"), "file_id")
    metadata = F.struct(
        F.col("filename").alias("source"),
        F.col("document_type").alias("content_type"),
        F.length("text").alias("chunk_size"),
    )
    return named.withColumn("metadata", metadata).drop("filename", "document_type")


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk table in one folder per language; each task sorts its rows by language and file."""
    ordered = chunks.sortWithinPartitions("language", "file_id", "chunk_index")
    ordered.write.mode(mode).partitionBy("language").parquet(path)


def write_json_lists(entries: DataFrame, path: str, entry: str = "entry") -> None:
    """JSON texts as lists, one file and list per partition; partitions without rows give an empty list."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        mark = " "
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": [mark + pdf.iloc[0, 0], *("," + x for x in pdf.iloc[1:, 0])]})
                mark = ","
        yield pd.DataFrame({"value": ["]"]})

    entries.select(entry).mapInPandas(lines, "value string").write.text(path)


def write_geojson(features: DataFrame, path: str, order: list[str], feature: str = "feature") -> None:
    """FeatureCollection in parts that are one document when joined in name order.

    Header, features and footer are rows sorted by range, so no task holds the whole collection.
    """
    # The place in the order is stored, so that exactly one feature is the first, also among equal or null keys.
    rows = features.orderBy(*order, feature).select(F.monotonically_increasing_id().alias("_place"), F.col(feature).alias("value"))
    rows = cut_lineage(rows)
    first = rows.agg(F.min("_place")).first()[0]
    line = F.when(F.col("_place") == first, F.col("value")).otherwise(F.concat(F.lit(","), "value"))
    body = rows.select(F.lit(1).alias("_part"), "_place", line.alias("value"))
    ends = features.sparkSession.createDataFrame(
        [(0, 0, '{"type":"FeatureCollection","features":['), (2, 0, "]}")], "_part int, _place long, value string"
    )
    body.unionByName(ends).orderBy("_part", "_place").select("value").write.text(path)


def write_texts(texts: DataFrame, path: str, text: str = "text") -> None:
    """Report texts, one row each, separated by a form feed so that they keep their line ends.

    A form feed inside a text is written as ``\\f`` and a backslash as two; ``read_texts`` takes that back.
    """
    safe = F.replace(F.replace(F.col(text), F.lit("\\"), F.lit("\\\\")), F.lit("\f"), F.lit("\\f"))
    texts.select(safe.alias(text)).write.option("lineSep", "\f").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``text`` rows that ``write_texts`` has written."""
    written = spark.read.option("lineSep", "\f").text(path)
    mark = "\x00"  # stands for a backslash while the form feeds are put back
    plain = F.replace(F.replace(F.col("value"), F.lit("\\\\"), F.lit(mark)), F.lit("\\f"), F.lit("\f"))
    return written.select(F.replace(plain, F.lit(mark), F.lit("\\")).alias("text"))


def write_tabular(lines: DataFrame, path: str, line: str = "line") -> None:
    """CSV lines as they are."""
    lines.select(line).write.text(path)
