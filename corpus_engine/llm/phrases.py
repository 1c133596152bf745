"""Collocations of two and three words per language, grown best first from counts of their beginnings.

Words are counted first, then pairs of words that are both frequent. A pair has its own score and, as the beginning of
longer phrases, a bound that no longer phrase's score exceeds. The frontier of pairs is grown from the best score or
bound down: a pass over the texts counts only the phrases of three words that begin or end with a pair of the
frontier. A language is settled once so many phrases survive at or above the frontier's level as are asked for:
whatever lies beyond has a lower score. Others grow on, down to level 0, where every pair is in the frontier.

Words are 64-bit hashes until the end; two words of one hash are noticed, and the count starts again with another hash.
Sets of words and pairs reach the tasks as filters of bounded size, which let some others through: they cost shuffle,
not results, since everything counted is counted whole and looked up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.frames import stored
from corpus_engine.llm.words import LOWER, MARK, SPACE, WORD, Words, blocks, mix, words_of

#: What separates words, and what separates pieces that no phrase crosses.
BETWEEN_WORDS, BETWEEN_PIECES = (0x20, 0x09), (*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D)
SCALE = 1_000_000
#: A filter has 16 bits for each member, from the least to the most.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28
BLOCK_BYTES = 2 << 20
#: So many counts are held by a task before it hands them on.
MOST_HELD = 1 << 18
#: The first frontier has so many pairs for each phrase asked for, later ones so many times more.
FIRST_NODES, GROWTH = 4, 8
NO_LANGUAGE = "und"


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def keys(lang: np.uint64, columns: list[np.ndarray]) -> np.ndarray:
    """One number for the hashes of each row, by which filters know it."""
    out = np.full(len(columns[0]), lang)
    for c in columns:
        out = mix((out ^ c) * np.uint64(0x9E3779B97F4A7C15))
    return out


@dataclass
class Filter:
    """Two bits for each member; ``bits`` is a power of two."""

    bits: int
    packed: np.ndarray

    def test(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), dtype=bool)
        for shift in (0, 32):
            at = (key >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= ((self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return out


def build_filter(members: DataFrame, columns: list[str]) -> Filter:
    """A filter of the rows' (lang, columns); blocks of bits are gathered by Spark, at most ``MOST_BITS`` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.uint64)
            langs = batch.column(0).dictionary_encode()
            hashes = [c.to_numpy().view(np.uint64) for c in batch.columns[1:]]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                mine = langs.indices.to_numpy() == i
                out[mine] = keys(lang_hash(lang), [h[mine] for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["key"])

    members = members.select("lang", *columns)
    bits = LEAST_BITS
    while bits < min(16 * members.count(), MOST_BITS):
        bits <<= 1
    place = F.explode(F.array(F.col("key"), F.shiftrightunsigned("key", 32))).alias("place")
    at = members.mapInArrow(run, "key long").select(place).select((F.col("place").bitwiseAND(bits - 1) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("held"))
    packed = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        packed[(row.part - 1) * 4096 : row.part * 4096] = np.frombuffer(row.held, dtype=np.uint8)[: bits // 8]
    return Filter(bits, packed)


def tokens(column: pa.Array, attempt: int) -> Iterator[tuple[Words, np.ndarray]]:
    """Words and marks of blocks of texts, A-Z in lower case, and whether each goes on in the next word.

    Bytes are hashed after an exclusive or with ``attempt``, so that another attempt has other hashes.
    """
    classes = np.full(256, WORD, dtype=np.uint8)
    classes[np.array(BETWEEN_WORDS) ^ attempt] = SPACE
    classes[np.array(BETWEEN_PIECES) ^ attempt] = MARK
    letters = LOWER ^ np.uint8(attempt)
    for _, _, data, offsets in blocks(column, BLOCK_BYTES):
        words = words_of(letters[data], offsets, classes, lower=False)
        follows = np.zeros(len(words.hash), dtype=bool)
        follows[:-1] = (words.kind[1:] == WORD) & (words.kind[:-1] == WORD)
        ends = words.first[1:][words.first[1:] > words.first[:-1]] - 1
        follows[ends] = False  # the last word of a text
        yield words, follows


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows with equal columns as one, their ``n`` added, and a row of each.

    Rows are sorted by one mixed number; rows of two kinds that share it may stay apart, which later sums mend.
    """
    if not len(n):
        return columns, n, np.empty(0, np.int64)
    mixed = columns[0] if len(columns) == 1 else keys(np.uint64(0), columns)
    order = np.argsort(mixed, kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(n), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n[order], at), order[at]


@dataclass
class Held:
    """Counts of one language in a task."""

    size: int
    columns: list[list[np.ndarray]] = field(default_factory=list)
    n: list[np.ndarray] = field(default_factory=list)
    words: list[pa.Array] = field(default_factory=list)

    def merge(self) -> int:
        columns, n, at = summed([np.concatenate(c) for c in zip(*self.columns, strict=True)], np.concatenate(self.n))
        self.columns, self.n = [columns], [n]
        if self.words:
            self.words = [pa.concat_arrays(self.words).take(pa.array(at))]
        return len(n)

    def batch(self, lang: str) -> pa.RecordBatch:
        columns = [pa.array(c.view(np.int64)) for c in self.columns[0]]
        names = ["lang", *(f"h{i + 1}" for i in range(self.size)), "n"]
        out = [pa.array([lang] * len(self.n[0])), *columns, pa.array(self.n[0])]
        return pa.RecordBatch.from_arrays([*out, *self.words], names=[*names, *(["word"] if self.words else [])])


def spelled(words: Words, at: np.ndarray, attempt: int) -> pa.Array:
    """The words at some places."""
    offsets = np.stack([words.start, words.end], axis=1).ravel()
    data = words.data ^ np.uint8(attempt)
    runs = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return runs.take(pa.array(2 * at)).cast(pa.binary())


def count(texts: DataFrame, size: int, attempt: int, filters: tuple[Filter, ...] = ()) -> DataFrame:
    """(lang, h1.., n) of the runs of ``size`` words, pre-summed by task, with ``word`` if they are single words.

    Pairs are counted if both words are in the filter; runs of three if their first two words are in the first filter
    or their last two in the second.
    """
    sent = texts.sparkSession.sparkContext.broadcast(filters)  # each at most MOST_BITS

    def found(lang: str, column: pa.Array) -> Iterator[tuple[list[np.ndarray], np.ndarray, pa.Array | None]]:
        own = lang_hash(lang)
        for words, follows in tokens(column, attempt):
            h = words.hash
            if size == 1:
                at = np.flatnonzero(words.kind == WORD)
                columns, n, first = summed([h[at]], np.ones(len(at), np.int64))
                yield columns, n, spelled(words, at[first], attempt) if len(first) else pa.array([], pa.binary())
                continue
            if size == 2:
                known = sent.value[0].test(keys(own, [h]))
                at = np.flatnonzero(follows & known)
                at = at[known[at + 1]]
            else:
                at = np.flatnonzero(follows)
                begins, ends = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
                pair = keys(own, [h[at], h[at + 1]])
                begins[at], ends[at] = sent.value[0].test(pair), sent.value[1].test(pair)
                at = at[follows[at + 1]]
                at = at[begins[at] | ends[at + 1]]
            columns, n, _ = summed([h[at + i] for i in range(size)], np.ones(len(at), np.int64))
            yield columns, n, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Held] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.merge()
                yield counts.batch(lang)
            held.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                for columns, n, words in found(lang, batch.column(1).take(pa.array(np.flatnonzero(codes == i)))):
                    if not len(n):
                        continue
                    counts = held.setdefault(lang, Held(size))
                    counts.columns.append(columns)
                    counts.n.append(n)
                    counts.words += [words] if words is not None else []
                    total += len(n)
                    if total > 2 * MOST_HELD:
                        total = sum(c.merge() for c in held.values())
                        if total > MOST_HELD:
                            yield from flush()
                            total = 0
        yield from flush()

    hashes = ", ".join(f"h{i + 1} long" for i in range(size))
    return texts.select("lang", "text").mapInArrow(run, f"lang string, {hashes}, n long" + (", word binary" if size == 1 else ""))


def count_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, h1, n, word) of all words, and the attempt whose hashes tell them apart."""
    for attempt in range(8):
        rows = stored(count(texts, 1, attempt).groupBy("lang", "h1", "word").agg(F.sum("n").alias("n")))
        if rows.groupBy("lang", "h1").count().filter(F.col("count") > 1).isEmpty():
            return rows, attempt
    raise ArithmeticError("eight hashes of 64 bits in a row do not tell all words apart")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    squared = (F.lit(SCALE).cast("decimal(7,0)") * wide(a)).cast("decimal(28,0)") * wide(a)
    return F.call_function("div", squared.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def score_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs with the counts of their words, their score, and the bound of what begins with them.

    A phrase that goes on from a pair occurs at most as often as the pair, and as the most frequent pair that its
    second word begins (``m``). What follows its first word occurs at least as often as the phrase, so the score of the
    first cut, and with it the lowest, is at most 1000000 * m / l.
    """
    one = words.select("lang", "h1", F.col("n").alias("l"))
    two = words.select("lang", F.col("h1").alias("h2"), F.col("n").alias("r"))
    next_most = pairs.groupBy("lang", "h1").agg(F.max("n").alias("most")).select("lang", F.col("h1").alias("h2"), "most")
    out = pairs.withColumnRenamed("n", "a").join(one, ["lang", "h1"]).join(two, ["lang", "h2"]).join(next_most, ["lang", "h2"], "left")
    most = F.lit(SCALE).cast("decimal(7,0)") * F.least("a", "most").cast("decimal(19,0)")
    bound = F.call_function("div", most, F.col("l").cast("decimal(19,0)"))
    out = out.withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r"))).withColumn("bound", F.coalesce(bound, F.lit(-1)))
    return out.select("lang", "h1", "h2", "a", "l", "r", "score", "bound")


def level_of(pairs: DataFrame, nodes: int) -> DataFrame:
    """(lang, level): the highest score or bound that at least ``nodes`` pairs of the language reach, to a bin; else 0."""
    best = F.greatest("score", "bound")
    bins = pairs.groupBy("lang", F.floor(F.log2(best + 1) * 64).alias("bin")).agg(F.count("*").alias("n"), F.min(best).alias("level"))
    down = Window.partitionBy("lang").orderBy(F.col("bin").desc())  # some 1,300 bins at most
    reached = bins.withColumn("n", F.sum("n").over(down)).filter(F.col("n") >= nodes)
    return pairs.select("lang").distinct().join(reached.groupBy("lang").agg(F.max("level").alias("level")), "lang", "left").na.fill(0, ["level"])


def score_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Phrases of three words with the counts and score of the cut that scores lowest; of equal ones the first."""
    first = pairs.select("lang", "h1", "h2", F.col("a").alias("first_two"), F.col("l").alias("first"))
    last = pairs.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("last_two"), F.col("r").alias("last"))
    out = triples.withColumnRenamed("n", "a").join(first, ["lang", "h1", "h2"]).join(last, ["lang", "h2", "h3"])
    one, two = cut_score(F.col("a"), F.col("first"), F.col("last_two")), cut_score(F.col("a"), F.col("first_two"), F.col("last"))
    out = out.withColumn("one", one).withColumn("two", two)
    pick = lambda x, y: F.when(F.col("one") <= F.col("two"), F.col(x)).otherwise(F.col(y))
    return out.select("lang", "h1", "h2", "h3", "a", pick("first", "first_two").alias("l"), pick("last_two", "last").alias("r"), pick("one", "two").alias("score"))


def survivors(pairs: DataFrame, triples: DataFrame, levels: DataFrame, share: int) -> DataFrame:
    """Candidates at or above their language's level that no longer candidate holds in ``share`` per cent of its places."""
    longer = triples.select("lang", "h1", "h2", "a").unionByName(triples.select("lang", F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    longer = longer.groupBy("lang", "h1", "h2").agg(F.max("a").alias("longer"))
    high = pairs.join(levels, "lang").filter("score >= level").drop("level", "bound")
    kept = high.join(longer, ["lang", "h1", "h2"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    columns = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
    whole = triples.join(levels, "lang").filter("score >= level")
    return kept.withColumn("h3", F.lit(None).cast("long")).select(columns).unionByName(whole.select(columns))


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, share: int = 50, limit: int = 2000, first_nodes: int = FIRST_NODES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``limit`` phrases of each language.

    Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``, A-Z in lower case. A
    phrase of two or three words of one piece that occurs ``a >= least`` times is a candidate; its score is the lowest
    of floor(1000000 * a * a / (l * r)) over its cuts. It is dropped if a longer candidate that holds it occurs at
    least ``share`` per cent as often. Order: score and a falling, phrase rising by UTF-8 bytes. ``n`` is the number
    of words of the language. Null texts are empty, a null language is ``und``; repeated rows count as often as they
    stand; a table without candidates, an empty one too, gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    vocabulary, attempt = count_words(texts)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stored(vocabulary.filter(F.col("n") >= least))
    pairs = count(texts, 2, attempt, (build_filter(words, ["h1"]),)).groupBy("lang", "h1", "h2").agg(F.sum("n").alias("n"))
    pairs = stored(score_pairs(stored(pairs.filter(F.col("n") >= least)), words))

    # Languages that are not settled, each with the level down to which its frontier has been grown.
    state = stored(pairs.select("lang", F.lit(1 << 62).alias("above")).distinct())
    nodes, triples, done = first_nodes * limit, None, None
    while True:
        open_pairs = pairs.join(state, "lang")
        levels = stored(level_of(open_pairs, nodes))
        gained = open_pairs.join(levels, "lang")
        best = F.greatest("score", "bound")
        begin = stored(gained.filter((best >= F.col("level")) & (best < F.col("above"))).select("lang", "h1", "h2"))
        end = stored(gained.filter((F.col("score") >= F.col("level")) & (F.col("score") < F.col("above"))).select("lang", "h1", "h2"))
        filters = build_filter(begin, ["h1", "h2"]), build_filter(end, ["h1", "h2"])
        found = count(texts.join(levels, "lang", "left_semi"), 3, attempt, filters).groupBy("lang", "h1", "h2", "h3").agg(F.sum("n").alias("n"))
        found = stored(score_triples(found.filter(F.col("n") >= least), pairs))
        triples = found if triples is None else triples.unionByName(found)
        # A phrase may be counted through its beginning in one round and through its end in another.
        known = triples.join(levels.select("lang"), "lang", "left_semi").dropDuplicates(["lang", "h1", "h2", "h3"])
        kept = stored(survivors(pairs, known, levels, share))
        enough = kept.groupBy("lang").count().filter(F.col("count") >= limit).select("lang")
        settled = stored(levels.filter("level = 0").select("lang").unionByName(enough).distinct())
        now = kept.join(settled, "lang", "left_semi")
        done = now if done is None else done.unionByName(now)
        state = stored(levels.join(settled, "lang", "left_anti").withColumnRenamed("level", "above"))
        if state.isEmpty():
            break
        nodes *= GROWTH

    for i in (1, 2, 3):
        spelling = words.select("lang", F.col("h1").alias(f"h{i}"), F.col("word").cast("string").alias(f"w{i}"))
        done = done.join(spelling, ["lang", f"h{i}"], "left")
    done = done.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = done.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
