"""Lines that repeat across documents, kept only in the first document that holds them.

Two Bloom filters, sized by the number of lines up to a bound, are gathered from all documents: one of line hashes
seen in one document, one of those seen again in another. Tasks send the places of the bits that they set, and blocks
of the filters are merged level by level. Only lines that the second filter suspects are shuffled, to be confirmed exactly and
to choose the first document; the others provably occur in one document. A filter that is small for its data
suspects more lines, never fewer: it costs shuffle, not results. At the bound (64 MB a filter) that begins at some
hundred million different lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.frames import extended, stored

LEAST_POINTS = 10
#: Bits of a filter for each line, and at least and at most in all.
LINE_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29
BLOCK_BITS = 1 << 19
#: Places that a task holds before it sends them.
PLACES = 1 << 22
#: Rows of a block that one merge takes, and levels of merging (for up to two million tasks).
FAN_IN, LEVELS = 128, 3
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit hash of the stripped line with A-Z in lower case; None if it has fewer than ``least`` code points."""
    key = line.strip(WHITE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(text: str | None, least: int) -> list[bytes | None]:
    return [line_key(x, least) for x in (text or "").encode().split(b"\n")]


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """The two bits of each key."""
    halves = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
    return (halves % np.uint64(bits)).astype(np.int64)


def filter_bits_for(lines: DataFrame) -> int:
    """Bits of the filters for all lines of ``text``: a power of two."""
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n = lines.agg(F.sum(breaks + 1)).first()[0] or 1
    return min(max(1 << (LINE_BITS * n - 1).bit_length(), LEAST_BITS), MOST_BITS)


def build_filter(lines: DataFrame, least: int, bits: int) -> np.ndarray:
    """Packed filter of the hashes that two documents hold; lines: doc_id, text."""
    block = min(BLOCK_BITS, bits)

    def send(held: list[np.ndarray], task: int) -> pa.RecordBatch:
        at, times = np.unique(np.concatenate(held), return_counts=True)
        part, first = np.unique(at // block, return_index=True)
        once = [x.astype(np.uint32).tobytes() for x in np.split(at % block, first[1:])]
        again = at[times > 1]
        ends = np.searchsorted(again, (part + 1) * block)
        twice = [x.astype(np.uint32).tobytes() for x in np.split(again % block, ends[:-1])]
        kinds = {"part": pa.int64(), "task": pa.int64(), "once": pa.binary(), "twice": pa.binary()}
        rows = {"part": part, "task": [task // FAN_IN] * len(part), "once": once, "twice": twice}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for text in batch.column(1):
                own = [k for k in set(line_keys(text.as_py(), least)) if k]
                if own:
                    held.append(np.unique(places(own, bits)))
                    n += len(held[-1])
                if n >= PLACES:
                    yield send(held, task)
                    held, n = [], 0
        if n:
            yield send(held, task)

    def merged(rows: pd.DataFrame, once: np.ndarray, twice: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"part": [rows.part[0]], "task": [rows.task[0] // FAN_IN], "once": [once.tobytes()], "twice": [twice.tobytes()]})

    def merge_places(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(block, dtype=bool), np.zeros(block, dtype=bool)
        for a, b in zip(rows.once, rows.twice, strict=True):
            at = np.frombuffer(a, np.uint32)
            twice[at[once[at]]] = True
            twice[np.frombuffer(b, np.uint32)] = True
            once[at] = True
        return merged(rows, np.packbits(once), np.packbits(twice))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        once = np.zeros(block // 8, dtype=np.uint8)
        twice = np.zeros(block // 8, dtype=np.uint8)
        for a, b in zip(rows.once, rows.twice, strict=True):
            seen = np.frombuffer(a, np.uint8)
            twice |= (once & seen) | np.frombuffer(b, np.uint8)
            once |= seen
        return merged(rows, once, twice)

    schema = "part long, task long, once binary, twice binary"
    filters = lines.mapInArrow(gather, schema).groupBy("part", "task").applyInPandas(merge_places, schema)
    for level in range(1, LEVELS):  # each joins what FAN_IN groups left; the last takes all that are left of a block
        keys = ["part", "task"] if level < LEVELS - 1 else ["part"]
        filters = filters.groupBy(*keys).applyInPandas(merge, schema)
    filters = filters.select("part", "twice")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in filters.toLocalIterator():  # bits / 8 bytes in all
        out[row.part * block // 8 : (row.part + 1) * block // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def suspected(lines: DataFrame, seen_twice: np.ndarray, least: int) -> DataFrame:
    """(doc_id, key) of the lines whose bits are all set."""
    bits = len(seen_twice) * 8
    sent = lines.sparkSession.sparkContext.broadcast(seen_twice)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [k for k in set(line_keys(text.as_py(), least)) if k]
                if own and doc is not None:
                    at = places(own, bits)
                    maybe = ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                    hit = [k for k, m in zip(own, maybe, strict=True) if m]
                    keys += hit
                    ids += [doc] * len(hit)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary())})

    return lines.mapInArrow(test, "doc_id long, key binary")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_POINTS, filter_bits: int | None = None) -> DataFrame:
    """(doc_id, keys): of each document the hashes of the lines that it loses; ``filter_bits`` follow the lines if not given."""
    lines = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Both uses read the suspects anew from the documents: cheaper than keeping them, and nothing is lost with an executor.
    maybe = suspected(lines, build_filter(lines, least, filter_bits or filter_bits_for(lines)), least)
    first = maybe.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    # Stored, so that a hot line's rows needn't meet the task that grouped it and a skewed join can be split.
    later = maybe.join(stored(first.select("key", "first")), "key").filter("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_POINTS, filter_bits: int | None = None) -> DataFrame:
    """All columns of ``docs`` with the lines dropped from ``text``, and ``_n_lines``, ``_n_dropped``.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z in lower case. A key of at least ``least``
    code points that two documents hold loses all its lines except in the document with the smallest id. A null or
    empty text is one empty line. Rows of one id are one document; rows without an id keep their lines and don't
    count. A text that loses lines keeps the others joined by ``\\n`` (all lost: an empty text); other texts,
    nulls included, stay as they are. An empty table gives an empty result.
    """
    drops = repeated_lines(docs, doc_id, text, least, filter_bits).select(F.col("doc_id").alias("_doc"), F.col("keys").alias("_keys"))
    joined = docs.join(drops, F.col(doc_id).cast("long") == F.col("_doc"), "left").drop("_doc")
    at = docs.columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for whole, keys in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (whole or "").encode().split(b"\n")
                n_lines.append(len(lines))
                if keys:
                    gone = set(keys)
                    kept = [x for x in lines if line_key(x, least) not in gone]
                    n_dropped.append(len(lines) - len(kept))
                    whole = b"\n".join(kept).decode() if len(kept) < len(lines) else whole
                else:
                    n_dropped.append(0)
                texts.append(whole)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            names = [*batch.schema.names[:-1], "_n_lines", "_n_dropped"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)

    schema = extended(docs, _n_lines="long", _n_dropped="long")
    return joined.mapInArrow(rewrite, schema)
