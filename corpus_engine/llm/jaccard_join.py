"""Documents whose sets of word shingles are similar, by adaptive multi-match prefixes.

Shingles are put in one order for all documents: by the count of a sketch of fixed size over the whole corpus, so
that common ones come last. With similarity at least ``t``, two sets of which each has at least ``ceil(t * size)``
shingles in common share ``l`` tokens in their prefixes of ``size - ceil(t * size) + l``. Every document chooses its own ``l``
by the estimated number of candidates: a longer prefix has to share more tokens, and a pair needs the smaller of its
two ``l``. A token that stands so late in either set that what follows can't make up the overlap counts for nothing.
Candidates are verified exactly on the whole sets.

Most tokens of prefixes are held by one class. They are found first, by their hashes alone, which travel packed by
bucket; a bit map of the others, sized by their number up to a bound, then lets few rows into the shuffle that does
not need to. A map that is full lets more through and loses none.

Equal sets are one class from the start. Large groups of near copies are never written out as pairs: members of a
token's list are first compared with one leader of the list, and linked ones fall into one component. Only lists
that still hold different components are compared further, first the centres of their groups; the triangle
inequality (1 - similarity is a distance) leaves out members that can't be linked, and the rest are compared one by one.

Before a pair's texts are fetched, its signatures are compared: bit maps of the parity of the shingles that fall on
each bit. Bits in which two differ are at most as many as shingles in which the sets differ, so the distance of a
pair is at least what the signatures say, and pairs that this puts beyond the threshold are no links.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.decontam import Map
from corpus_engine.llm.frames import stored, text_batches
from corpus_engine.llm.graph import components
from corpus_engine.llm.words import blocks, mix, shingle_sets, words_of

WORDS = 5
PERCENT = 75
SKETCH_BITS = 18
SKETCH_PARTS = 16
MOST_MATCHES = 8
LEADER_ROUNDS = 2
#: Lists of a token that the sketch expects to be longer are split for the choice of leaders.
LIST_ROWS = 4096
#: Classes of a group that a task holds against as many others.
BLOCK_CLASSES = 1024
MAP_BITS = 1 << 24
#: Tokens that a task packs at once, and those of all documents that a bucket is planned for.
PACK_TOKENS, BUCKET_TOKENS = 1 << 21, 1 << 20
LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 6, 20
#: Bits of the map of repeated tokens: a value, and at most (64 MB).
TOKEN_BITS, MOST_TOKEN_BITS = 16, 1 << 29
#: Pairs of a class beyond which they are dealt to parts, each with its own copy of the class's text.
HOT_PAIRS = 256


def needed(n, percent: int):
    """Least number of shared shingles for a set of ``n``: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def class_ids(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each set, independent of order; empty sets have 0."""
    n = np.diff(first)
    zero = np.zeros(1, dtype=np.uint64)
    ends = np.concatenate([zero, np.cumsum(mix(sets), dtype=np.uint64)])
    more = np.concatenate([zero, np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    one, two = ends[first[1:]] - ends[first[:-1]], more[first[1:]] - more[first[:-1]]
    out = mix(one ^ (two * np.uint64(0x9E3779B97F4A7C15)) + n.astype(np.uint64))
    return np.where(n > 0, out, np.uint64(0)).view(np.int64)


def sets_of(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, where each row's begin) of blocks of whole texts."""
    for row, _, data, offsets in blocks(column):
        yield row, *shingle_sets(words_of(data, offsets), words)


def survey(docs: DataFrame, words: int) -> DataFrame:
    """Per document ``doc_id, text_key, n, class_id``; and rows of the shingle sketch (``part, task, counts``)."""
    size = 1 << SKETCH_BITS
    step = size // SKETCH_PARTS
    names = ["doc_id", "text_key", "n", "class_id", "part", "task", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int32)
        for batch in batches:
            n, ids = [], []
            for _, sets, first in sets_of(batch.column(2), words):
                n.append(np.diff(first))
                ids.append(class_ids(sets, first))
                counts += np.bincount((sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.int32)
            if batch.num_rows:
                none = pa.nulls(batch.num_rows, pa.int64())
                columns = [batch.column(0), batch.column(1), pa.array(np.concatenate(n)), pa.array(np.concatenate(ids))]
                yield pa.RecordBatch.from_arrays([*columns, none, none, pa.nulls(batch.num_rows, pa.binary())], names=names)
        if counts.any():
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            task = TaskContext.get().partitionId() // 64
            parts = pa.array([counts[i * step : (i + 1) * step].tobytes() for i in range(SKETCH_PARTS)], pa.binary())
            numbers = pa.array(range(SKETCH_PARTS), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, numbers, pa.array([task] * SKETCH_PARTS, pa.int64()), parts], names=names)

    return docs.mapInArrow(run, "doc_id long, text_key long, n long, class_id long, part long, task long, counts binary")


def sketch_of(surveyed: DataFrame) -> np.ndarray:
    """The summed sketch: ``2**SKETCH_BITS`` counts, whatever the input."""

    def add(rows: pd.DataFrame, kind: type) -> pd.DataFrame:
        total = sum(np.frombuffer(x, kind).astype(np.int64) for x in rows.counts)
        return pd.DataFrame({"part": [rows.part[0]], "task": [0], "counts": [total.tobytes()]})

    schema = "part long, task long, counts binary"
    rows = surveyed.filter("part IS NOT NULL").select("part", "task", "counts")
    rows = rows.groupBy("part", "task").applyInPandas(lambda g: add(g, np.int32), schema)
    rows = rows.groupBy("part").applyInPandas(lambda g: add(g, np.int64), schema)
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    step = len(out) // SKETCH_PARTS
    for r in rows.collect():
        out[r.part * step : (r.part + 1) * step] = np.frombuffer(r.counts, np.int64)
    return out


def expected(sketch: np.ndarray) -> np.ndarray:
    """Documents that share a token of each bucket beyond what chance puts there."""
    mean = sketch.mean()
    return np.maximum(sketch - mean - 2 * np.sqrt(mean), 0).astype(np.int64)


def choose_matches(likely: np.ndarray, base: int) -> int:
    """The ``l`` with the least cost: candidates (those of the prefix over ``l``) and one more token for each step."""
    most = min(MOST_MATCHES, len(likely) - base)
    if most < 2 or not likely[: base + most].any():
        return 1
    total = np.cumsum(likely[: base + most])[base:]
    steps = np.arange(1, most + 1)
    return int((total / steps + steps).argmin()) + 1


class Prefixes:
    """Chooses the prefix of each class, once per task (``done`` holds the classes that it has seen)."""

    def __init__(self, sketch: np.ndarray, words: int, percent: int):
        self.counts, self.likely, self.words, self.percent = sketch, expected(sketch), words, percent

    def of(self, column: pa.Array, done: set[int]) -> Iterator[tuple[np.ndarray, ...]]:
        """(token, its expected list, class, n, matches, place) of the prefixes of each block of texts."""
        shift = np.uint64(64 - SKETCH_BITS)
        for _, sets, first in sets_of(column, self.words):
            n, ids = np.diff(first), class_ids(sets, first)
            bucket = (sets >> shift).astype(np.int64)
            text = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((sets, self.counts[bucket], text))
            tokens, bucket = sets[order], bucket[order]
            base = n - needed(n, self.percent)
            matches = np.ones(len(n), dtype=np.int64)
            held = self.likely[bucket]
            for i in range(len(n)):
                if n[i] and ids[i] not in done:
                    done.add(ids[i])
                    matches[i] = choose_matches(held[first[i] : first[i + 1]], int(base[i]))
                else:
                    matches[i] = 0
            length = np.where(matches > 0, base + matches, 0)
            place = np.arange(len(tokens)) - first[:-1][text]
            kept = place < length[text]
            own = text[kept]
            yield tokens[kept], held[kept], ids[own], n[own], matches[own], place[kept]


LOW = np.uint64((1 << 48) - 1)


def token_keys(low: np.ndarray, bucket: np.ndarray | np.uint64) -> np.ndarray:
    """The value of a token in the map of repeated ones, from its 48 low bits and its bucket."""
    return mix(low + bucket * np.uint64(0x9E3779B97F4A7C15))


def repeated_tokens(docs: DataFrame, chosen: Prefixes, bucket_bits: int) -> DataFrame:
    """``seed``: the values of tokens that stand twice in the prefixes of what tasks hold.

    Tokens travel as 48 bits in one row per bucket and pack. Two tokens with one value, and copies of a class in
    several tasks, let a token through that one class holds; no shared token is left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chosen)
    shift = np.uint64(64 - bucket_bits)

    def pack(tokens: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.sort(np.concatenate(tokens))
        third = np.zeros(len(rows), dtype=bool)
        third[2:] = rows[2:] == rows[:-2]  # two of a value say all
        rows = rows[~third]
        low = (rows & LOW).view(np.uint8).reshape(-1, 8)[:, :6]
        buckets, start = np.unique(rows >> shift, return_index=True)
        packed = [x.tobytes() for x in np.split(low, start[1:])]
        return pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64)), pa.array(packed, pa.binary())], names=["bucket", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        held, n = [], 0
        for batch in batches:
            for tokens, *_ in sent.value.of(batch.column(0), done):
                held.append(tokens)
                n += len(tokens)
                if n >= PACK_TOKENS:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    def repeated(rows: pa.Table) -> pa.Table:
        packed = np.frombuffer(b"".join(rows["tokens"].to_pylist()), np.uint8).reshape(-1, 6)
        low = np.zeros((len(packed), 8), dtype=np.uint8)
        low[:, :6] = packed
        low = np.sort(low.view(np.uint64).ravel())
        twice = np.unique(low[1:][low[1:] == low[:-1]])
        return pa.table({"seed": token_keys(twice, np.uint64(rows["bucket"][0].as_py())).view(np.int64)})

    return docs.select("text").mapInArrow(run, "bucket long, tokens binary").groupBy("bucket").applyInArrow(repeated, "seed long")


def token_map(docs: DataFrame, chosen: Prefixes, n_shingles: int) -> tuple[Map, int]:
    """The map of repeated tokens, and the bits of a token that name its bucket."""
    in_prefixes = n_shingles * (100 - chosen.percent) // 100
    bucket_bits = min(max((in_prefixes // BUCKET_TOKENS).bit_length(), LEAST_BUCKET_BITS), MOST_BUCKET_BITS)
    twice = stored(repeated_tokens(docs, chosen, bucket_bits))
    return Map.of(twice, twice.count(), TOKEN_BITS, MOST_TOKEN_BITS), bucket_bits


def prefixes(docs: DataFrame, chosen: Prefixes, shared: Map, bucket_bits: int) -> DataFrame:
    """``token, split, class_id, n, matches, place``: the prefix of each class, once per task, without tokens that
    the map knows to be held once; ``place`` from 0."""
    sent = docs.sparkSession.sparkContext.broadcast((chosen, shared))
    shift = np.uint64(64 - bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, twice = sent.value
        done: set[int] = set()
        for batch in batches:
            for columns in prefix.of(batch.column(0), done):
                kept = twice.maybe(token_keys(columns[0] & LOW, columns[0] >> shift))
                tokens, listed, rows, n, matches, place = (x[kept] for x in columns)
                parts = listed // LIST_ROWS + 1
                split = np.where(parts > 1, (rows.view(np.uint64) % parts.astype(np.uint64)).astype(np.int64), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (tokens.view(np.int64), split, rows, n, matches, place)],
                    names=["token", "split", "class_id", "n", "matches", "place"],
                )

    return docs.select("text").mapInArrow(run, "token long, split long, class_id long, n long, matches long, place long")


def shared_tokens(tokens: DataFrame, percent: int) -> DataFrame:
    """Rows of tokens that a class of a fitting size shares, each once. ``split`` is -1 but for long lists."""
    by_size = Window.partitionBy("token", "split").orderBy("n", "class_id")
    follows, before = F.lead(F.struct("class_id", "n")).over(by_size), F.lag(F.struct("class_id", "n")).over(by_size)
    rows = tokens.withColumns({"after": follows, "before": before})
    last = F.col("after").isNull() | (F.col("after.class_id") != F.col("class_id"))
    fits_after = (F.col("after.class_id") != F.col("class_id")) & (F.col("n") * 100 >= F.col("after.n") * percent)
    fits_before = F.col("before.n") * 100 >= F.col("n") * percent  # or a copy of the row, which costs little
    kept = (F.col("split") >= 0) | F.coalesce(fits_after, F.lit(False)) | F.coalesce(fits_before, F.lit(False))
    return rows.filter(last & kept).drop("after", "before")


def listed(tokens: DataFrame, percent: int, name: str) -> DataFrame:
    """``shared_tokens`` as table ``name``, bucketed by what names a list, so that looking at whole lists moves no row."""
    spark = tokens.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = shared_tokens(tokens.repartition(buckets, "token", "split"), percent)
    rows.write.bucketBy(buckets, "token", "split").saveAsTable(name)
    return spark.table(name)


def signature(sets: np.ndarray) -> bytes:
    """Parity of the shingles on each of at least two bits a shingle; a power of two of them, so that any two fold."""
    bits = max(64, 1 << (2 * len(sets) - 1).bit_length())
    return np.packbits(np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def differing(one: bytes, two: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


class Texts:
    """One text (compressed) and the signature of each class that shares a token, in a table bucketed by class that
    joins don't shuffle."""

    def __init__(self, docs: DataFrame, keys: DataFrame, words: int):
        spark = docs.sparkSession
        self.spark, self.name, self.words = spark, f"shingle_texts_{uuid.uuid4().hex}", words
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.chosen(docs, self.key_map(keys))
        rows = rows.repartition(buckets, "class_id").dropDuplicates(["class_id"])
        rows.write.bucketBy(buckets, "class_id").sortBy("class_id").saveAsTable(self.name)

    @staticmethod
    def key_map(keys: DataFrame) -> np.ndarray:
        """A bit map of fixed size of the text keys."""
        place = F.pmod(F.col("text_key"), F.lit(MAP_BITS)) + 1  # the functions number buckets and values from 1
        parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
        for r in parts.toLocalIterator():
            start = (r.part - 1) * 4096
            out[start : start + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
        return out

    def chosen(self, docs: DataFrame, keys: np.ndarray) -> DataFrame:
        sent, words = self.spark.sparkContext.broadcast(keys), self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, done, packer = sent.value, set(), zstandard.ZstdCompressor(level=3)
            for batch in batches:
                at = np.mod(batch.column(0).to_numpy(), MAP_BITS)
                hit = np.flatnonzero((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                texts = batch.column(1).take(pa.array(hit))
                for row, sets, first in sets_of(texts, words):
                    ids = class_ids(sets, first)
                    new = [i for i, x in enumerate(ids) if x and not (x in done or done.add(x))]
                    marks = pa.array([signature(sets[first[i] : first[i + 1]]) for i in new], pa.binary())
                    own = pa.array([packer.compress(texts[row + i].as_buffer()) for i in new], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[new]), marks, own], names=["class_id", "mark", "text"])

        return docs.select("text_key", "text").mapInArrow(run, "class_id long, mark binary, text binary")

    def hot(self, pairs: DataFrame) -> DataFrame | None:
        """``end, class_id, parts`` of the classes with many pairs; None if there are none. Pairs: stored."""
        ends = [pairs.select(F.lit(end).alias("end"), F.col(end).alias("class_id")) for end in ("a", "b")]
        counted = ends[0].unionByName(ends[1]).groupBy("end", "class_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_PAIRS)
        found = stored(counted.select("end", "class_id", F.ceil(F.col("n") / HOT_PAIRS).cast("int").alias("parts")))
        return None if found.isEmpty() else found

    def fetch(self, pairs: DataFrame, end: str, column: str, hot: DataFrame | None) -> DataFrame:
        """Adds the ``column`` of the class at an end of each pair. Pairs of a hot class are dealt to parts by their
        other end, and the class is copied for each part."""
        held = self.spark.table(self.name).select(F.col("class_id").alias(end), F.col(column).alias(f"{column}_{end}"))
        if hot is None:
            return pairs.join(held, end)
        own = hot.filter(F.col("end") == end).select(F.col("class_id").alias(end), "parts")
        other = "b" if end == "a" else "a"
        part = F.pmod(F.xxhash64(other), F.col("parts")).cast("int")
        some = pairs.join(own, end).withColumn("part", part).drop("parts")
        copies = held.join(own, end).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        rest = pairs.join(own, end, "left_anti").join(held, end)
        return rest.unionByName(some.join(copies, [end, "part"]).drop("part"))

    def least_distances(self, pairs: DataFrame, hot: DataFrame | None) -> DataFrame:
        """``a, b, apart`` of ``a, b, n_a, n_b``: a lower bound of the distance of each pair."""
        rows = pairs.select("a", "b", "n_a", "n_b")
        for end in ("a", "b"):
            rows = self.fetch(rows, end, "mark", hot)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                odd = np.array([differing(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(3), batch.column(4), strict=True)], dtype=np.float64)
                apart = 2 * odd / (batch.column(2).to_numpy() + odd)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], names=["a", "b", "apart"])

        rows = rows.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "mark_a", "mark_b")
        return rows.mapInArrow(run, "a long, b long, apart double")

    def marks(self, rows: DataFrame) -> DataFrame:
        """Adds the ``mark`` of ``class_id``."""
        return rows.join(self.spark.table(self.name).select("class_id", "mark"), "class_id")

    def verify(self, pairs: DataFrame, hot: DataFrame | None) -> DataFrame:
        """``a, b, shared, joined``: sizes of the intersection and union of the sets of each pair of classes."""
        rows = pairs.select("a", "b")
        for end in ("a", "b"):
            rows = self.fetch(rows, end, "text", hot)
        rows, words = rows.select("a", "b", "text_a", "text_b"), self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opener = zstandard.ZstdDecompressor()
            for batch in batches:
                for part in range(0, batch.num_rows, 64):
                    rows = batch.slice(part, 64)
                    sides = (pa.array([opener.decompress(x.as_buffer()) for x in rows.column(c)], pa.binary()).cast(pa.string()) for c in (2, 3))
                    one, two = ([sets[first[i] : first[i + 1]] for _, sets, first in sets_of(side, words) for i in range(len(first) - 1)] for side in sides)
                    shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)], dtype=np.int64)
                    joined = np.array([len(x) + len(y) for x, y in zip(one, two, strict=True)], dtype=np.int64) - shared
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(shared), pa.array(joined)], names=["a", "b", "shared", "joined"])

        return rows.mapInArrow(run, "a long, b long, shared long, joined long")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def fitting(one: str, two: str, percent: int):
    """Whether two sizes allow the similarity."""
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def reachable(tail, sizes, matches, percent: int):
    """Whether a token can be among the first ``matches`` shared ones of a link: what follows it (``tail``, itself
    included, in the set where that is less) and those before it must make up the overlap that the sizes ask for."""
    return (tail + matches - 1) * (100 + percent) >= sizes * percent


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``id, root`` after ``links`` (``a, b``) join what ``labels`` has; unlabelled classes are their own root."""
    if labels is None:
        return components(links)
    up = links
    for end in ("a", "b"):
        roots = labels.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        up = up.join(roots, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_root", end)).drop("_id", "_root")
    new = components(up.select("a", "b")).select(F.col("id").alias("old"), F.col("root").alias("new"))
    moved = labels.join(new, F.col("root") == F.col("old"), "left").select("id", F.coalesce("new", "root").alias("root"))
    fresh = new.join(labels, F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("root"))
    return stored(moved.unionByName(fresh))


SIDE = ("class_id", "n", "root", "away", "tail", "matches", "mark")


def compare_members(held: DataFrame, met: DataFrame, percent: int, schema: str = "a long, b long") -> DataFrame:
    """Pairs of a member of a group (``held``) and a class that met its centre (``met``, with ``apart``, the least
    distance of the centres) that can be linked by all that is known of the two.

    Both sides come in blocks of bounded size (``centre, block, batch``), which a task compares class by class.
    """
    limit = 1 - percent / 100 + 1e-9

    def run(members: pa.Table, others: pa.Table) -> pa.Table:
        a, b = [], []
        if members.num_rows and others.num_rows:
            ids, n, root, away, tail, matches = (members[c].to_numpy() for c in SIDE[:-1])
            marks = members["mark"].to_pylist()
            for other in others.to_pylist():
                both = n + other["n"]
                fits = (np.minimum(n, other["n"]) * 100 >= np.maximum(n, other["n"]) * percent) & (root != other["root"])
                fits &= other["apart"] <= limit + away + other["away"]
                fits &= reachable(np.minimum(tail, other["tail"]), both, np.minimum(matches, other["matches"]), percent)
                for i in np.flatnonzero(fits):
                    odd = differing(marks[i], other["mark"])
                    if 2 * odd <= limit * (both[i] + odd):
                        a.append(ids[i])
                        b.append(other["class_id"])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["centre", "block", "batch"]
    return held.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(run, schema)


def with_roots(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the root of ``class_id``."""
    return rows.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))


def led(rows: DataFrame, chance: list[Column]) -> DataFrame:
    """Rows of lists with the ``leader`` of each, the first by ``chance``, and the first and last root (``low, high``)."""
    own = ["class_id", "n", "root", "place", "matches"]
    first = F.min(F.struct(*[c.alias(f"at{i}") for i, c in enumerate(chance)], *own))
    whole = Window.partitionBy("token", "split")
    rows = rows.withColumns({"leader": first.over(whole), "low": F.min("root").over(whole), "high": F.max("root").over(whole)})
    return rows.withColumn("leader", F.struct(*[F.col(f"leader.{c}") for c in own]))


def link_classes(lists: DataFrame, members: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """``id, root`` of the classes that are linked with others; ``members`` (``class_id, n, matches, tail``) are those of
    ``lists``, with the longest rest of a set from one of its tokens on."""
    linked = F.col("shared") * 100 >= F.col("joined") * percent
    limit = 1 - percent / 100 + 1e-9
    labels: DataFrame | None = None
    links: DataFrame | None = None
    for turn in range(LEADER_ROUNDS):
        # At first one leader for many lists. Then each list has its own, of its largest component: the others, which
        # are fewer, each meet many of its members. Only lists that hold different components are looked at again;
        # the parts of a long one stay, as they are compared with each other in the end.
        if labels is None:
            rows = led(lists.withColumn("root", F.col("class_id")), [F.xxhash64(F.lit(turn), "class_id")])
        else:
            sizes = labels.groupBy("root").agg((-F.count(F.lit(1))).alias("fewer"))
            rows = with_roots(lists, labels.join(sizes, "root")).withColumn("fewer", F.coalesce("fewer", F.lit(-1)))
            rows = led(rows, [F.col("fewer"), F.xxhash64(F.lit(turn), "class_id", "token")])
            lists = rows = stored(rows.filter("low <> high OR split >= 0").drop("fewer", "low", "high"))
        met = rows.filter(F.col("root") != F.col("leader.root")).withColumn("led_n", F.col("leader.n"))
        tail = F.least(F.col("n") - F.col("place"), F.col("led_n") - F.col("leader.place"))
        matches = F.least(F.col("matches"), F.col("leader.matches"))
        pairs = met.filter(fitting("n", "led_n", percent) & reachable(tail, F.col("n") + F.col("led_n"), matches, percent)).select(
            F.col("class_id").alias("a"), F.col("leader.class_id").alias("b"), F.col("n").alias("n_a"), F.col("led_n").alias("n_b")
        )
        pairs = stored(pairs.distinct())
        hot = texts.hot(pairs)
        near = texts.least_distances(pairs, hot).filter(F.col("apart") <= limit)
        found = stored(texts.verify(near, hot).filter(linked))
        links = found if links is None else links.unionByName(found)
        labels = merged(labels, found.select("a", "b"))

    # Every class belongs to the group of the nearest leader it is linked with, at a known distance; others are groups
    # of one.
    distance = 1 - F.col("shared") / F.col("joined")
    centres = links.groupBy("a").agg(F.min(F.struct(distance.alias("away"), F.col("b").alias("centre"))).alias("c"))
    centres = centres.select(F.col("a").alias("class_id"), "c.centre", "c.away")
    members = with_roots(members, labels).join(centres, "class_id", "left")
    own_centre = [F.coalesce("centre", "class_id").alias("centre"), F.coalesce("away", F.lit(0.0)).alias("away")]
    members = stored(members.select("class_id", "n", "matches", "tail", "root", *own_centre))
    group = members.groupBy("centre").agg(F.max("away").alias("reach"), F.count(F.lit(1)).alias("size"))
    # A group has one root, so what a list holds is known from its groups.
    rows = lists.drop("root").join(members.select("class_id", "root", "centre"), "class_id")
    held = rows.groupBy("token", "centre").agg(
        F.min("root").alias("root"), F.min("matches").alias("matches"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max(F.col("n") - F.col("place")).alias("tail"), F.max("matches").alias("most_matches"),
    )
    held = stored(held)
    mixed = held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
    held = held.join(mixed, "token", "left_semi")
    held = stored(held.join(members.select(F.col("class_id").alias("centre"), F.col("n").alias("centre_n")), "centre"))
    columns = ("centre", "centre_n", "root", "matches", "most_matches", "least", "most", "tail")
    one = held.select("token", *[F.col(c).alias(f"{c}_a") for c in columns])
    two = held.select("token", *[F.col(c).alias(f"{c}_b") for c in columns])
    sizes_fit = (F.col("most_a") * 100 >= F.col("least_b") * percent) & (F.col("most_b") * 100 >= F.col("least_a") * percent)
    pairs = (
        one.join(two, "token")
        .filter((F.col("centre_a") < F.col("centre_b")) & (F.col("root_a") != F.col("root_b")))
        .filter(sizes_fit & reachable(F.least("tail_a", "tail_b"), F.col("least_a") + F.col("least_b"), F.least("most_matches_a", "most_matches_b"), percent))
        .groupBy(F.col("centre_a").alias("a"), F.col("centre_b").alias("b"), F.col("centre_n_a").alias("n_a"), F.col("centre_n_b").alias("n_b"))
        .agg(
            F.count(F.lit(1)).alias("tokens"),
            F.min(F.least("matches_a", "matches_b")).alias("matches"),
        )
        .filter(F.col("tokens") >= F.col("matches"))
    )
    pairs = stored(pairs)
    hot = texts.hot(pairs)
    between = stored(texts.least_distances(pairs, hot))
    links = texts.verify(between.filter(F.col("apart") <= limit), hot).filter(linked)
    labels = merged(labels, links.select("a", "b"))

    # Members of groups whose centres are near enough for a link between them.
    apart = between
    for end in ("a", "b"):
        sizes = group.select(F.col("centre").alias(end), F.col("reach").alias(f"reach_{end}"), F.col("size").alias(f"size_{end}"))
        apart = apart.join(sizes, end)
    apart = apart.filter((F.col("size_a") + F.col("size_b") > 2) & (F.col("apart") <= limit + F.col("reach_a") + F.col("reach_b")))
    # The larger group of a pair is held, the members of the smaller one are brought to it.
    larger = F.struct("size_a", "a") > F.struct("size_b", "b")
    met = apart.select(
        F.when(larger, F.col("a")).otherwise(F.col("b")).alias("held"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("centre"),
        F.greatest("size_a", "size_b").alias("size"), "apart",
    )
    met = stored(met)
    fresh = stored(texts.marks(with_roots(members.drop("root"), labels)).select("centre", *SIDE))
    shares = met.join(group.select("centre", F.col("size").alias("own")), "centre").groupBy("held")
    shares = stored(shares.agg(F.max("size").alias("size"), F.sum("own").alias("others")))
    parts = {"blocks": F.ceil(F.col("size") / BLOCK_CLASSES).cast("int"), "batches": F.ceil(F.col("others") / BLOCK_CLASSES).cast("int")}
    shares = shares.select("held", *[c.alias(n) for n, c in parts.items()])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "class_id"), F.col(c)).cast("int")
    left = fresh.join(shares.withColumnRenamed("held", "centre"), "centre")
    left = left.withColumn("block", dealt("blocks", 1)).withColumn("batch", every("batches"))
    right = met.join(fresh, "centre").select("held", "apart", *SIDE).join(shares, "held").withColumnRenamed("held", "centre")
    right = right.withColumn("batch", dealt("batches", 2)).withColumn("block", every("blocks"))
    side = ["centre", "block", "batch", *SIDE]
    right = right.select(*side, "apart").toDF(*side, "apart")  # columns of its own: both sides come from one table
    near = stored(compare_members(left.select(side), right, percent).distinct())
    return merged(labels, texts.verify(near, texts.hot(near)).filter(linked).select("a", "b"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text with fewer than ``words`` of them is one shingle,
    a null text and one without words have none and are linked with nothing. ``component_id`` is the smallest id that
    links reach, the row's own included. Rows without an id link like others, and have a null component if no row
    with an id is reached; repeated ids are rows of their own. Sets are compared as sets of 64-bit hashes. An empty
    table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    with text_batches(spark):
        surveyed = stored(survey(rows, words))
        found = surveyed.filter("part IS NULL").select("doc_id", "text_key", "n", "class_id")
        chosen = Prefixes(sketch_of(surveyed), words, percent)
        shared, bucket_bits = token_map(rows, chosen, found.agg(F.sum("n")).first()[0] or 0)
        name = f"shingle_lists_{uuid.uuid4().hex}"
        try:
            lists = listed(prefixes(rows, chosen, shared, bucket_bits), percent, name)
            tail = F.max(F.col("n") - F.col("place")).alias("tail")
            members = stored(lists.groupBy("class_id").agg(F.max("n").alias("n"), F.max("matches").alias("matches"), tail))
            classes = found.filter("n > 0").groupBy("class_id").agg(F.min("doc_id").alias("first"), F.min("text_key").alias("text_key"))
            texts = Texts(rows, members.select("class_id").join(classes, "class_id").select("text_key"), words)
            try:
                labels = link_classes(lists, members, texts, percent)
            finally:
                texts.drop()
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    named = with_roots(classes.select("class_id", "first"), labels)
    roots = named.join(labels.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(roots, "root", "left").select(F.col("class_id").alias("_class"), F.coalesce("least", "first").alias("component_id"))
    out = found.join(named, F.col("class_id") == F.col("_class"), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
