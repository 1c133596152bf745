"""One chunk table from files of all routes: entries of JSON, rows of CSV, windows of text."""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.language import guess_language
from corpus_engine.functions.records import leaves_text, text_leaves
from corpus_engine.functions.text import NO_VALUE, clean_value, label
from corpus_engine.operators.chunks import chunk_files
from corpus_engine.operators.inference import embed
from corpus_engine.sources.readers import NA_TOKENS

RAGGED = "_cells"


def json_parts(text: str) -> list[str] | None:
    """The entries of a JSON list as they are written, or the one value; None for what is no JSON."""
    try:
        if not isinstance(json.loads(text), list):
            return [text.strip()]
    except (ValueError, RecursionError):
        return None
    decoder, out, at = json.JSONDecoder(), [], text.index("[") + 1
    while True:
        while text[at] in " \t\r\n,":
            at += 1
        if text[at] == "]":
            return out
        end = decoder.raw_decode(text, at)[1]
        out.append(text[at:end])
        at = end


def numbered(header: list[str]) -> list[str]:
    """Column names, a repeated one with the first number that makes it another: ``a``, ``a.1``."""
    out: dict[str, None] = {}
    for name in header:
        n, new = 0, name
        while new in out:
            n, new = n + 1, f"{name}.{n + 1}"
        out[new] = None
    return list(out)


def csv_parts(text: str) -> list[str] | None:
    """Rows below the header as JSON objects of texts, missing values as ``(sin valor)``.

    A repeated name in the header is numbered; a row with more or fewer cells has them as a list, as they are written.
    """
    csv.field_size_limit(sys.maxsize)  # cells of any length; it holds for the process
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    except csv.Error:
        return None
    header, *rest = rows or [[]]
    names = numbered(header)
    known = lambda cells: [NO_VALUE if c in NA_TOKENS else c for c in cells]
    held = (dict(zip(names, known(r))) if len(r) == len(names) else {RAGGED: r} for r in rest)
    return [json.dumps(r, ensure_ascii=False) for r in held]


def entries(route: Column, text: Column) -> Column:
    """JSON texts of the entries of a file; null where it can't be read."""

    @F.pandas_udf("array<string>")
    def run(routes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([(csv_parts if r == "rows" else json_parts)(t or "") for r, t in zip(routes, texts)], dtype=object)

    return run(route, text)


def every_cell(leaf: Column) -> Column:
    """``Label: value`` lines of all leaves; ``(sin valor)`` for those that mean nothing."""
    return F.array_join(F.transform(leaf, lambda e: F.concat(label(e["path"]), F.lit(": "), clean_value(e["value"]))), "\n")


def chunk_table(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk rows of routed files (``file_id, filename, document_type, route, text``), and files that can't be read.

    ``file_id, chunk_index, text, text_json, language, metadata_json``: texts are cut into windows and have the
    language of their file; an entry of JSON or a row of CSV is one chunk with its JSON and a language of its own.
    """
    named = ["file_id", "filename", "document_type"]
    plain = chunk_files(files.filter("route = 'text'").select(*named, "text")).withColumn("text_json", F.lit(None).cast("string"))
    parts = F.array(F.struct(entries(F.col("route"), F.col("text")).alias("parts")))
    read = files.filter("route IN ('records', 'rows')").select(*named, "route", "text", F.inline(parts))
    rejected = read.filter("parts IS NULL").select(*named, "route", "text")
    cut = read.filter("parts IS NOT NULL").select(*named, "route", F.posexplode("parts").alias("chunk_index", "text_json"))
    cut = cut.withColumn("leaf", text_leaves(F.col("text_json")))
    text = F.when(F.col("route") == "rows", every_cell(F.col("leaf"))).otherwise(leaves_text(F.col("leaf")))
    cut = cut.withColumn("text", text).withColumn("language", guess_language(F.col("text")))
    columns = [*named, "chunk_index", "text", "text_json", "language"]
    rows = plain.select(columns).unionByName(cut.select(columns))
    metadata = F.struct(F.col("filename").alias("source"), F.col("document_type").alias("content_type"), F.length("text").alias("chunk_size"))
    return rows.withColumn("metadata_json", F.to_json(metadata)).drop("filename", "document_type"), rejected


def with_vectors(chunks: DataFrame, fn: Callable[[list[str]], np.ndarray], size: int) -> DataFrame:
    """The chunk table with the ``embedding`` of each text, each distinct text embedded once."""
    return embed(chunks, "text", fn, size=size)
