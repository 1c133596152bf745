"""Training passages that copy test items, found by n-gram seeds and scored by local alignment.

Every n-gram of an item is a seed, however frequent it is. Places of a document that hold a seed are widened to
windows that could hold a whole copy, windows meet items by equal seeds, and Smith-Waterman over words scores each
meeting whose common words could reach the threshold, so that words changed, dropped or put in between lower the
score instead of hiding the copy. A copy without one n-gram of its item meets nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.frames import stored, text_batches
from corpus_engine.llm.words import BY_KIND, WORD, Words, blocks, grams, words_of

SEED_WORDS = 3
MATCH, OTHER, GAP = 2, -1, -1
LEAST_SCORE = 0.5
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def plain_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters and digits, without the marks between them."""
    found = words_of(data, offsets, BY_KIND)
    kept = found.kind == WORD
    start = found.start[kept]
    first = np.searchsorted(start, offsets)
    return Words(found.n, data, offsets, found.hash[kept], start, found.end[kept], found.kind[kept], first)


def item_words(items: DataFrame, size: int) -> DataFrame:
    """``item_id, words`` (hashes) ``, seeds`` (distinct n-grams) of each item with at least ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, seeds = [], [], []
            for row, stop, data, offsets in blocks(batch.column(1)):
                found = plain_words(data, offsets)
                hashed, whole = grams(found, size)
                for i in range(stop - row):
                    part = slice(found.first[i], found.first[i + 1])
                    own = np.unique(hashed[part][whole[part]])
                    if len(own):
                        ids.append(batch.column(0)[row + i].as_py())
                        words.append(found.hash[part].view(np.int64))
                        seeds.append(own.view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, kind), pa.array(seeds, kind)], names=["item_id", "words", "seeds"])

    return items.mapInArrow(run, "item_id long, words array<long>, seeds array<long>")


class Map:
    """A bit map of fixed size that holds two bits of each value; it may suspect values it does not hold."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, np.zeros(bits // 8, dtype=np.uint8)

    @classmethod
    def of(cls, values: DataFrame, n: int, each: int = 1024, most: int = MOST_BITS) -> Map:
        """Map of the column ``seed`` with ``n`` rows; its size follows ``n``, with ``each`` bits a row, up to ``most``."""
        out = cls(min(max(LEAST_BITS, 1 << (each * max(n, 1)).bit_length()), most))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(out.places(batch.column(0).to_numpy().view(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

        place = F.col("at") + 1  # the functions number buckets and values from 1
        bits = values.select("seed").mapInArrow(run, "at long").groupBy(F.bitmap_bucket_number(place).alias("part"))
        for r in bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toLocalIterator():
            start = (r.part - 1) * 4096
            out.held[start : start + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
        return out

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = values & np.uint64(self.bits - 1)
        high = (values >> np.uint64(32)) & np.uint64(self.bits - 1)
        return low.astype(np.int64), high.astype(np.int64)

    def maybe(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), dtype=bool)
        for at in self.places(values):
            out &= (self.held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def windows_of(docs: DataFrame, seeds: Map, size: int, reach: int) -> DataFrame:
    """``doc_id, row_key, start, words, seeds`` of the places of each document that hold suspected seeds.

    Seeds at most ``reach`` words apart share a window, which reaches as far beyond them. Windows are handed on block
    by block, so a task holds those of a block of texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for row, _, data, offsets in blocks(batch.column(2)):
                words = plain_words(data, offsets)
                hashed, whole = grams(words, size)
                hit = np.flatnonzero(whole)[sent.value.maybe(hashed[whole])]
                if not len(hit):
                    continue
                rows, starts, held, own = [], [], [], []
                text = words.text_of()[hit]
                cuts = np.flatnonzero((np.diff(hit) > reach) | (np.diff(text) > 0)) + 1
                for part in np.split(np.arange(len(hit)), cuts):
                    t = text[part[0]]
                    a = max(words.first[t], hit[part[0]] - reach)
                    b = min(words.first[t + 1], hit[part[-1]] + size + reach)
                    rows.append(row + t)
                    starts.append(a - words.first[t])
                    held.append(words.hash[a:b].view(np.int64))
                    own.append(np.unique(hashed[hit[part]]).view(np.int64))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int64()), pa.array(held, kind), pa.array(own, kind)],
                    names=["doc_id", "row_key", "start", "words", "seeds"],
                )

    return docs.mapInArrow(run, "doc_id long, row_key long, start long, words array<long>, seeds array<long>")


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """(score, first word, word after the last, words matched) of the best local alignment within the window."""
    m = len(window)
    steps = np.arange(1, m + 1, dtype=np.int64) * -GAP
    table = np.zeros((len(item) + 1, m + 1), dtype=np.int64)
    for i, word in enumerate(item, 1):
        above = table[i - 1]
        row = np.maximum(above[:-1] + np.where(window == word, MATCH, OTHER), above[1:] + GAP)
        row = np.maximum(row, 0)
        # A gap in the item: the best of what stands to the left, less one step for each word skipped.
        table[i, 1:] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(table.argmax(), table.shape)
    score, end, matched = int(table[i, j]), int(j), 0
    while i and j and table[i, j] > 0:
        same = item[i - 1] == window[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else OTHER):
            i, j, matched = i - 1, j - 1, matched + bool(same)
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, int(j), end, matched


def alignments(pairs: DataFrame, least: float) -> DataFrame:
    """Scores of ``doc_id, row_key, start, words, item_id, item``, those of at least ``least``."""
    schema = "doc_id long, row_key long, item_id long, score double, first_word long, last_word long, matched long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            keys = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for i in range(batch.num_rows):
                window = batch.column(3)[i].values.to_numpy()
                item = batch.column(5)[i].values.to_numpy()
                if np.isin(item, window).sum() < least * len(item):  # each word of the item matches once at most
                    continue
                score, a, b, matched = align(item, window)
                if score >= least * MATCH * len(item):
                    doc, row, start, item_id = (k[i] for k in keys)
                    out.append((doc, row, item_id, score / (MATCH * len(item)), start + a, start + b - 1, matched))
            if out:
                kinds = [pa.float64() if n == "score" else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return pairs.select("doc_id", "row_key", "start", "words", "item_id", "item").mapInArrow(run, schema)


def copies(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = SEED_WORDS,
    least: float = LEAST_SCORE,
) -> DataFrame:
    """``doc_id, row_key, item_id, score, first_word, last_word, matched``: the best copy of each item in each document.

    Words are runs of letters and digits in lower case. ``score`` is the alignment's part of a perfect one (1: word
    for word); copies below ``least`` are left out. ``first_word`` and ``last_word`` count the document's words from
    0. Copies without ``size`` words of the item in a row are not found, so items with fewer have none, nor have null
    texts; rows without an id are told apart by
    ``row_key``, a hash of id and text, and equal rows are reported once. Ties go to the earlier place. Either table
    may be empty; then so is the result.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"), F.lower(F.col(text)).alias("text")
    )
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.lower(F.col(item_text)).alias("text")).filter("text IS NOT NULL")
    with text_batches(docs.sparkSession):
        known = stored(item_words(tests, size))
        every = stored(known.select("item_id", F.explode("seeds").alias("seed")))
        n, longest = every.count(), known.agg(F.max(F.size("words"))).first()[0] or size
        # m matches and e other steps score 2m - e >= 2 * least * l, with m <= l words of the item; they span m + e words at most.
        reach = int(np.ceil((3 - 2 * least) * longest))
        found = stored(windows_of(rows, Map.of(every, n), size, reach))
        met = found.select("doc_id", "row_key", "start", F.explode("seeds").alias("seed")).join(every, "seed")
        met = met.select("doc_id", "row_key", "start", "item_id").distinct()
        same = F.col("row_key").eqNullSafe(F.col("_key")) & (F.col("start") == F.col("_start"))
        windows = found.select(F.col("row_key").alias("_key"), F.col("start").alias("_start"), "words").dropDuplicates(["_key", "_start"])
        whole = known.select(F.col("item_id").alias("_item"), F.col("words").alias("item"))
        pairs = met.join(windows, same).join(whole, F.col("item_id") == F.col("_item"))
        scored = stored(alignments(pairs, least))
    best = F.max(F.struct("score", (-F.col("first_word")).alias("at"), "last_word", "matched")).alias("best")
    out = scored.groupBy("doc_id", "row_key", "item_id").agg(best)
    return out.select(
        "doc_id", "row_key", "item_id", "best.score", (-F.col("best.at")).alias("first_word"), "best.last_word", "best.matched"
    )
