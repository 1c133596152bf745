"""The chunk table: building it, its statistics and its ordered batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.chunking import window_array
from corpus_engine.functions.language import guess_language
from corpus_engine.functions.text import cap

BATCH = 5


def chunk_files(texts: DataFrame, size: int = 1000, overlap: int = 200, sample_chunks: int | None = None) -> DataFrame:
    """Chunk rows of (``file_id``, ``text``), each with the language of its file.

    The language is guessed from the whole text, or from the first ``sample_chunks``, while the file is one row,
    so no chunk is grouped or joined for it.
    """
    cut = texts.withColumn("pieces", window_array(F.col("text"), size, overlap))
    sample = F.col("text") if sample_chunks is None else F.array_join(F.slice("pieces", 1, sample_chunks), " ")
    voted = cut.withColumn("language", guess_language(sample)).drop("text")
    rest = [c for c in voted.columns if c != "pieces"]
    return voted.select(*rest, F.posexplode("pieces").alias("chunk_index", "text"))


def chunk_stats(texts: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Characters, chunks and mean chunk size of every file."""
    cut = texts.withColumn("sizes", F.transform(window_array(F.col("text"), size, overlap), F.length))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + n)
    return cut.filter(F.size("sizes") > 0).select(
        "file_id",
        F.length("text").alias("total_chars"),
        F.size("sizes").alias("num_chunks"),
        (total / F.size("sizes")).alias("avg_chunk_size"),
    )


def chunk_counts(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n_chunks"))


def batch_id(chunk_index: Column, size: int = BATCH) -> Column:
    """Chunk ordinals have no gaps, so the batch follows from the ordinal and needs no window."""
    return F.floor(chunk_index / size).cast("int")


def ordered_batches(chunks: DataFrame, size: int = BATCH, most: int | None = None) -> DataFrame:
    """Texts of ``size`` neighbouring chunks of a stored chunk table, in order, joined by a blank line.

    Batches are whole; ``most`` cuts them for a reader that takes no more characters.

    A group holds at most ``size`` chunks. Where the files themselves are at hand ``file_batches``
    gives the same without a shuffle.
    """
    joined = F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY chunk_index)")
    grouped = chunks.groupBy("file_id", batch_id(F.col("chunk_index"), size).alias("batch"))
    return grouped.agg(F.count(F.lit(1)).alias("n_chunks"), (joined if most is None else cap(joined, most)).alias("text"))


def file_batches(
    texts: DataFrame, size: int = BATCH, most: int | None = None, window: int = 1000, overlap: int = 200
) -> DataFrame:
    """The same batches cut from (``file_id``, ``text``) rows; nothing leaves the row of its file."""
    cut = texts.withColumn("pieces", window_array(F.col("text"), window, overlap)).filter(F.size("pieces") > 0)
    last = F.floor((F.size("pieces") - 1) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("pieces", i * size + 1, F.lit(size)))
    rows = cut.select("file_id", F.posexplode(parts).alias("batch", "part"))
    joined = F.array_join("part", "\n\n")
    return rows.select(
        "file_id",
        "batch",
        F.size("part").cast("long").alias("n_chunks"),
        (joined if most is None else cap(joined, most)).alias("text"),
    )


def text_census(chunks: DataFrame, vector: str = "embedding", width: int = 8) -> DataFrame:
    """Texts, distinct texts and bytes their vectors take."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.countDistinct(F.md5("text")).alias("n_distinct"),
        F.sum(F.size(vector).cast("long") * width).alias("vector_bytes"),
    )


def focus_sample(context_files: DataFrame, chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """First chunks of the first file with text, per context."""
    with_text = chunks.filter(F.col("chunk_index") == 0).select("file_id")
    first = context_files.join(with_text, "file_id", "left_semi").groupBy("context_id").agg(
        F.min("file_id").alias("file_id")
    )
    head = chunks.filter(F.col("chunk_index") < size)
    head = head.join(first.select("file_id").distinct(), "file_id", "left_semi")
    joined = F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY chunk_index)")
    samples = head.groupBy("file_id").agg(joined.alias("sample"))
    return first.join(samples, "file_id")


def focus_of(answer: Column, default: str = "México") -> Column:
    """First line of the answer, the default when there is none."""
    return F.coalesce(F.element_at(F.split(F.trim(answer), "\n"), 1), F.lit(default))
