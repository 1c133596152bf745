"""File sources: JSON entries, CSV rows, text files, and routing by format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpus_engine.functions.records import elements, parse_whole, row_text
from corpus_engine.functions.text import NO_VALUE, strip

# Texts a CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Formats that are read, and how.
ROUTES = {"json": "records", "csv": "rows", "pdf": "text", "docx": "text", "txt": "text"}


def json_entries(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """One row per entry of a JSON list (or one for a single object) as ``entry``, and broken texts."""
    parsed = texts.withColumn("_v", parse_whole(F.col(text)))
    listed = F.coalesce(elements(F.col("_v")), F.array("_v"))
    good = parsed.filter(F.col("_v").isNotNull())
    entries = good.select("*", F.posexplode(listed).alias("entry_index", "entry")).drop("_v", text)
    return entries, parsed.filter(F.col("_v").isNull()).drop("_v")


def read_json_entries(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries of JSON files.

    A file that holds one list cannot be split: it is read by one task and must fit there. With
    ``lines`` each line is a value of its own and large files are split.
    """
    texts = spark.read.text(path, wholetext=not lines).select(
        F.col("value"), F.col("_metadata.file_path").alias("path")
    )
    return json_entries(texts.filter(strip(F.col("value")) != ""), "value")


def read_csv_rows(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """CSV with a header, every column a string, missing values as ``(sin valor)``; and ragged rows (``line``, ``cells``).

    Quoted fields may hold line ends; ``multiline=False`` splits large files that have none. Rows with more or
    fewer cells than the header are handed on as they were written.
    """
    options = dict(header=True, escape='"', multiLine=multiline)
    names = spark.read.csv(path, **options).columns
    ragged = "_ragged_row"
    schema = StructType([StructField(n, StringType()) for n in [*names, ragged]])
    rows = spark.read.csv(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=ragged, enforceSchema=False, **options)
    broken = rows.filter(F.col(ragged).isNotNull()).select(F.col(ragged).alias("line"), F.array(*names).alias("cells"))
    return fill_missing(rows.filter(F.col(ragged).isNull()).drop(ragged)), broken


def fill_missing(rows: DataFrame) -> DataFrame:
    def filled(c: str) -> Column:
        return F.when(F.col(c).isNull() | F.col(c).isin(NA_TOKENS), NO_VALUE).otherwise(F.col(c))

    return rows.withColumns({c: filled(c) for c in rows.columns})


def csv_texts(rows: DataFrame) -> DataFrame:
    """Rows with their ``Label: value`` text."""
    return rows.withColumn("text", row_text(rows.columns))


def decoded(content: Column) -> Column:
    """Trimmed UTF-8 text of a file; null when it is empty or no UTF-8."""
    text = strip(content.cast("string"))
    return F.when(F.is_valid_utf8(content.cast("string")) & (text != ""), text)


def extension(filename: Column) -> Column:
    return F.lower(F.element_at(F.split(filename, r"\."), -1))


# How files begin whose text has to be taken out by another program first.
BINARY_STARTS = [b"%PDF-", b"PK\x03\x04", b"\xd0\xcf\x11\xe0"]


def is_binary(content: Column) -> Column:
    """Whether the bytes are a PDF, a zipped office file or an old one."""
    return reduce(lambda a, b: a | b, [F.substring(content, 1, len(s)) == F.lit(s) for s in BINARY_STARTS])


def route_files(files: DataFrame, filename: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Files with ``route`` and ``text``, and rejected files with the ``reason``."""
    pairs = [F.lit(x) for pair in ROUTES.items() for x in pair]
    routed = files.withColumns(
        {
            "route": F.element_at(F.create_map(*pairs), extension(F.col(filename))),
            "text": decoded(F.col(content)),
        }
    )
    reason = (
        F.when(F.col("route").isNull(), "unsupported format")
        .when(is_binary(F.col(content)), "text not extracted")
        .when(~F.is_valid_utf8(F.col(content).cast("string")), "not UTF-8")
        .when(F.col("text").isNull(), "empty")
    )
    marked = routed.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def read_text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole files under ``path``, routed by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return route_files(files.select("path", name.alias("filename"), "content"), "filename", "content")
