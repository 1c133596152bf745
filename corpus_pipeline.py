"""Pipeline that makes a training mix of ``documents``: language, lines, near copies, test items, sources.

Each stage works on what the one before kept, written as Parquet and read again. Stages whose last step hands texts to
Python write it themselves, in small batches: Python's workers stay, and so does the room that large batches took.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm import decontam, jaccard_join, language_id, line_dedup, mixing
from corpus_engine.llm.frames import stored, text_batches
from corpus_engine.tables import load

#: A text whose best language scores less is no text in any known language.
LEAST_LANGUAGE_SCORE = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones; a missing label is filled in.

    Null texts and texts without a letter go. Without any labelled document nothing is known, and all go.
    """
    with text_batches(spark):
        found = language_id.identify(docs, language_id.train(docs, "doc_id", "text", "lang"))
        known = found.filter((F.col("_lang") != language_id.UNDETERMINED) & (F.col("_score") >= LEAST_LANGUAGE_SCORE))
        return stored(known.withColumn("lang", F.coalesce("lang", "_lang")).select(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; ``n_chars`` follows the text."""
    with text_batches(spark):
        found = line_dedup.dedup_lines(docs)
        n_chars = F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return stored(found.withColumn("n_chars", n_chars).select(docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component, and all that are linked with nothing.

    Rows without an id are known by a hash of their text that is larger than ids. Of rows with one id the first by
    text, language and source stays.
    """
    by_text = F.abs(F.xxhash64("text") % (1 << 61)) + (1 << 62)
    known = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), by_text))
    links = jaccard_join.link_documents(known, doc_id="_id")
    first = links.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).filter("doc_id = component_id")
    kept = known.join(first.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    order = Window.partitionBy("_id").orderBy("text", "lang", "source")
    return kept.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select(docs.columns)


def drop_copies_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    found = decontam.copies(docs, load(spark, sf_dir, "benchmark")).select(F.col("row_key").alias("_key")).distinct()
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id"), F.col("text")))
    return keyed.join(stored(found), F.col("_row") == F.col("_key"), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of copies: one row per document with how often, and so with how many words, it is taken (0 too).

    No row is repeated or left out here; ``mixing.materialise`` does it.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_language),
    ("lines", drop_repeated_lines),
    ("near copies", keep_one_of_near_copies),
    ("test items", drop_copies_of_tests),
    ("mix", mix_sources),
]

#: Classifier, alignment and random rounding have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows are the mix's plan of copies, not the copies."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs = docs if stage in (keep_known_language, drop_repeated_lines) else stored(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
