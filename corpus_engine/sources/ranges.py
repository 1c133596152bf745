"""JSON lists and quoted CSV in one large file, read in byte ranges by many tasks.

Spark's text source cuts a file into ranges that begin after a separator: a comma in JSON, a line end in CSV. What a
range does to the state of a reader (inside a string or not, how deep) is known without the state it begins with, for
both cases of being inside a string. One pass measures that for every range; folding the ranges of a file gives each
its state and the number of entries before it; a second pass cuts the entries. What crosses ranges comes as fragments
and is put together by entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions.records import parse_whole
from corpus_engine.session import cut_lineage
from corpus_engine.sources.readers import fill_missing

#: States of ranges are sent to all tasks up to this number; beyond, pieces are dealt to them by range.
MOST_SENT = 200_000
QUOTE, ESCAPE, SPACE = ord('"'), ord("\\"), ord(" ")
OPEN, CLOSE, BLANK, COMMA = (np.frombuffer(x, np.uint8) for x in (b"[{", b"]}", b" \t\r\n", b","))
MEASURE = "path string, start long, size long, bytes long, flips int, depth0 long, depth1 long, ends0 array<long>, ends1 array<long>, first string"
START = "path string, start long, inside int, depth long, entry long, cut long, fresh boolean, last long, sound boolean"


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(path, start, size, value): what stands between separators, in order, with the range it was read in."""
    rows = spark.read.option("lineSep", separator).text(path)
    held = F.col("_metadata")
    return rows.select(held["file_path"].alias("path"), held["file_block_start"].alias("start"), held["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))


def quotes(data: np.ndarray, escapes: bool) -> np.ndarray:
    """Whether each byte is behind an odd number of quotes; a quote behind an odd run of escapes doesn't count."""
    flips = data == QUOTE
    if escapes and flips.any():
        places = np.arange(1, len(data) + 1)
        other = np.maximum.accumulate(np.where(data == ESCAPE, 0, places))
        before = np.concatenate([[0], other[:-1]])
        flips &= (places - 1 - before) % 2 == 0
    return np.cumsum(flips) % 2 == 1


def depths(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """How much deeper it is after each byte than at the beginning; brackets inside strings don't count."""
    step = np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE)
    return np.cumsum(np.where(inside, 0, step))


def runs(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(path, start and further columns; bytes; ends of the pieces) for rows of one range that came together.

    Every piece is followed by the separator, the last one of a file too.
    """
    for batch in batches:
        named = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
        values, low = batch.column(batch.num_columns - 1).to_pylist(), 0
        while low < len(named):
            high = low + 1
            while high < len(named) and named[high][:2] == named[low][:2]:
                high += 1
            part = values[low:high]
            ends = np.cumsum([len(x) + 1 for x in part]) - 1
            yield named[low], np.frombuffer(separator.join(part) + separator, dtype=np.uint8), ends
            low = high


def measured(found: DataFrame, separator: bytes, nested: bool) -> DataFrame:
    """What each range does to a reader: quotes, depth, and at which depth its separators stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = None, None

        def out() -> pa.RecordBatch:
            # Depths and counts by turns.
            ends = [[int(x) for pair in e.items() for x in pair] for e in row["ends"]]
            held = [*at, row["bytes"], row["flips"], *row["depth"], *ends, row["first"]]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, held, strict=True))], schema=schema)

        for name, data, ends in runs(batches, separator):
            if name != at:
                if at is not None:
                    yield out()
                at, row = name, {"bytes": 0, "flips": 0, "depth": [0, 0], "ends": [{}, {}], "first": ""}
            if not row["first"]:
                row["first"] = chr(data[np.argmax(~np.isin(data, BLANK))])
                row["first"] = "" if row["first"] in " \t\r\n" else row["first"]
            odd = quotes(data, nested)
            for case in (0, 1):
                inside = odd ^ bool(case ^ row["flips"])
                depth = row["depth"][case] + (depths(data, inside) if nested else np.zeros(len(data), np.int64))
                for d, n in zip(*np.unique(depth[ends][~inside[ends]], return_counts=True), strict=True):
                    row["ends"][case][d] = row["ends"][case].get(d, 0) + n
                row["depth"][case] = int(depth[-1])
            row["flips"] ^= int(odd[-1])
            row["bytes"] += len(data)
        if at is not None:
            yield out()

    longs, number = pa.list_(pa.int64()), pa.int64()
    kinds = [pa.string(), number, number, number, pa.int32(), number, number, longs, longs, pa.string()]
    schema = pa.schema(list(zip([x.split()[0] for x in MEASURE.split(", ")], kinds, strict=True)))
    return found.mapInArrow(run, MEASURE)


def folded(ranges: DataFrame, nested: bool) -> DataFrame:
    """The state each range begins with. A file has one row per range here, whatever its size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        first = next((x for x in rows["first"] if x), "")
        cut = (1 if first == "[" else -1) if nested else 0
        inside, depth, entry, top, fresh, out = 0, 0, 0, 0, True, []
        for r in rows.itertuples():
            out.append([r.path, r.start, inside, depth, entry, cut, fresh])
            ends = (r.ends0, r.ends1)[inside]
            at = dict(zip(ends[::2], ends[1::2], strict=True))
            entry += at.get(cut - depth, 0)
            top += at.get(-depth, 0)
            depth += (r.depth0, r.depth1)[inside]
            inside ^= r.flips
            fresh = inside == 0 and depth == cut
        # Outside all brackets there is only the separator that was counted behind the last piece, and it is not in
        # the file: the bytes counted are one more than it has.
        sound = not nested or (inside == 0 and depth == 0 and top == 1 and rows["bytes"].sum() == rows["size"].iloc[0] + 1)
        return pd.DataFrame([[*x, entry, sound] for x in out], columns=["path", "start", "inside", "depth", "entry", "cut", "fresh", "last", "sound"])

    return ranges.groupBy("path").applyInPandas(run, START)


def without_outside(data: np.ndarray, inside: np.ndarray, depth: int, deep: np.ndarray, first: bool) -> tuple[np.ndarray, bool]:
    """The bytes of a range of a list with blanks for its own brackets and what is outside them, and whether that is blank."""
    before = np.concatenate([[depth], deep[:-1]])
    opening, closing = ~inside & (deep == 1) & (before == 0), ~inside & (deep == 0) & (before == 1)
    beyond = (deep == 0) & ~closing
    strange = ~np.isin(data[beyond], BLANK) & ~np.isin(data[beyond], COMMA)  # commas are counted by the fold
    blanked = np.where(opening | closing | beyond, SPACE, data).astype(np.uint8)
    return blanked, not strange.any() and opening.sum() <= int(first)


def cut_entries(found: DataFrame, starts: DataFrame, separator: bytes, nested: bool) -> DataFrame:
    """(path, entry, part, whole, value): entries that lie in one range, and fragments of the others.

    ``entry`` is -1 for what stands outside a list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest = None, b""
        inside = depth = entry = cut = fresh = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

        for name, data, ends in runs(batches, separator):
            out, begins = [], name[:2] != at
            if begins:
                if rest:
                    out.append((at[0], entry, at[1], False, rest))
                at, rest = name[:2], b""
                inside, depth, entry, cut, fresh = (int(x) for x in name[2:7])
            odd = quotes(data, nested) ^ bool(inside)
            deep = depth + (depths(data, odd) if nested else np.zeros(len(data), np.int64))
            stops = ends[~odd[ends] & (deep[ends] == cut)]
            if cut == 1:
                data, blank = without_outside(data, odd, depth, deep, begins and at[1] == 0)
                if not blank:
                    out.append((at[0], -1, at[1], False, b""))
            text, low = data.tobytes(), 0
            for stop in stops:
                out.append((at[0], entry, at[1], bool(fresh), rest + text[low:stop]))
                entry, low, rest, fresh = entry + 1, stop + 1, b"", 1
            rest += text[low:]
            inside, depth = int(odd[-1]), int(deep[-1])
            if out:
                yield batch(out)
        if rest:
            yield batch([(at[0], entry, at[1], False, rest)])

    schema = pa.schema([("path", pa.string()), ("entry", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("value", pa.binary())])
    state = ["path", "start", "inside", "depth", "entry", "cut", "fresh"]
    kept = starts.select(*state)
    if kept.count() <= MOST_SENT:
        joined = found.select("path", "start", "value").join(F.broadcast(kept), ["path", "start"])
    else:
        placed = found.select("path", "start", "value", F.monotonically_increasing_id().alias("place"))
        joined = placed.join(kept, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "place")
    return joined.select(*state, "value").mapInArrow(run, "path string, entry long, part long, whole boolean, value binary")


def entries_in_ranges(spark: SparkSession, path: str, separator: str, nested: bool) -> tuple[DataFrame, DataFrame]:
    """(path, entry, value) of all files, and the folded states of their ranges; both stored."""
    found, byte = pieces(spark, path, separator), separator.encode()
    starts = cut_lineage(folded(measured(found, byte, nested), nested))
    cut = cut_lineage(cut_entries(found, starts, byte, nested))
    parts = F.array_sort(F.collect_list(F.struct("part", "value")))
    fragments = cut.filter(~F.col("whole")).groupBy("path", "entry").agg(F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["value"])).alias("value"))
    return cut.filter("whole").select("path", "entry", "value").unionByName(fragments), starts


def read_json_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, entry_index, entry) of JSON files, each a list or one value, and the paths of those that are no JSON.

    A list of any size is read by as many tasks as it has ranges; a task holds an entry, not the file. Blank files and empty
    lists have no entries; a file with anything that is no JSON is broken as a whole. A file that is one object is one
    entry.
    """
    rows, starts = entries_in_ranges(spark, path, ",", nested=True)
    files = starts.groupBy("path").agg(F.max("last").alias("last"), F.max("cut").alias("cut"), F.bool_and("sound").alias("sound"))
    # Where the file is one value, the separator that only was counted still stands at its end.
    value = F.when(F.col("cut") == 1, F.col("value")).otherwise(F.substring("value", F.lit(1), F.length("value") - 1))
    text = value.cast("string")
    rows = rows.join(files, "path").withColumn("text", text).filter((F.col("last") > 0) | (F.regexp_replace("text", r"[ \t\r\n]+", "") != "") | (F.col("entry") < 0))
    rows = cut_lineage(rows.select("path", F.col("entry").alias("entry_index"), "sound", parse_whole(F.col("text")).alias("entry")))
    bad = rows.groupBy("path").agg(F.bool_and(F.col("sound") & F.col("entry").isNotNull() & (F.col("entry_index") >= 0)).alias("fine")).filter(~F.col("fine"))
    return rows.join(bad, "path", "left_anti").drop("sound"), bad.select("path")


def read_csv_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same as ``read_csv_rows`` for files of any size with line ends in quotes; and ragged rows (``line``, ``cells``).

    Each file begins with the header of the first; a file with another one is handed on as ragged rows. Quotes stand around
    whole cells and are doubled inside them: a single quote inside a bare cell would change the parity, so files with such
    cells are for ``read_csv_rows``.
    """
    names = spark.read.csv(path, header=True, escape='"', multiLine=True).columns
    rows, _ = entries_in_ranges(spark, path, "\n", nested=False)
    rows = rows.withColumn("line", F.regexp_replace(F.col("value").cast("string"), "\r$", "")).filter("line <> ''")
    header = rows.groupBy("path").agg(F.min("entry").alias("header"))
    ragged = "_ragged_row"
    cells = ", ".join(f"`{n}` string" for n in [*names, ragged])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": ragged}
    parsed = rows.withColumn("cells", F.from_csv("line", cells, options))
    first = parsed.join(header, "path").filter("entry = header")
    is_header = F.lit(True)
    for n in names:
        is_header = is_header & F.col("cells")[n].eqNullSafe(F.lit(n))
    other = first.filter(~is_header).select("path", F.lit(True).alias("other"))
    known = parsed.join(header, "path").join(other, "path", "left").filter(F.col("other") | (F.col("entry") > F.col("header")))
    good = known.filter(F.col("other").isNull() & F.col("cells")[ragged].isNull()).select("cells.*").drop(ragged)
    bad = known.filter(F.col("other") | F.col("cells")[ragged].isNotNull())
    return fill_missing(good), bad.select("line", F.array(*[F.col("cells")[n] for n in names]).alias("cells"))


__all__ = ["read_csv_ranges", "read_json_ranges"]
