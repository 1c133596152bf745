"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Document frequencies are counted over all documents, exactly for the words of the templates and in a sketch of fixed
size for all others. A text is compared line by line, paragraph by paragraph, as a whole, and by every run of as many
words as a template has, so that a notice is found whatever shares its line. Licences of a family differ in few words
(a version, "lesser", "noncommercial"), which a cosine hardly sees: a template whose words of this kind are not just
those of the text is no match, however near it is. Files without a licence of their own take that of the nearest
directory above them that has a licence file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.decontam import plain_words
from corpus_engine.llm.frames import extended, stored
from corpus_engine.llm.licence_templates import NOTICES, TELLING_APART, VERSIONS
from corpus_engine.llm.words import blocks

LEAST_COSINE = 0.7
#: Counters of a row of the sketch, a power of two; words in one run of spans that are compared at once.
SKETCH, SPAN_WORDS = 1 << 18, 1 << 17
LICENCE_NAMES = ["license", "licence", "copying", "copyright", "notice", "unlicense"]


@dataclass
class Templates:
    """``names`` of the rows of ``unit`` (templates by vocabulary); ``vocabulary`` in rising order with its ``idf``.

    ``mark_of`` is the number of each word among those that tell licences apart, -1 for others; ``wants`` and ``bars``
    (templates by such words) say which of them a text must have and must not have.
    """

    names: list[str]
    vocabulary: np.ndarray
    counts: np.ndarray
    mark_of: np.ndarray
    wants: np.ndarray
    bars: np.ndarray
    idf: np.ndarray | None = None
    unit: np.ndarray | None = None
    other_idf: np.ndarray | None = None
    telling: np.ndarray | None = None
    least: float = 0.0

    @classmethod
    def of(cls, notices: dict[str, list[str]]) -> Templates:
        names = [k for k in sorted(notices) for _ in notices[k]]
        _, _, data, offsets = next(blocks(pa.array([t for k in sorted(notices) for t in notices[k]]), 1 << 30))
        words = plain_words(data, offsets)
        marks = sorted({*VERSIONS, *(w for own in TELLING_APART.values() for w in own)})
        vocabulary, at = np.unique(np.concatenate([words.hash, hashes_of(marks), hashes_of(list(TELLING_APART))]), return_inverse=True)
        counts = np.zeros((len(names), len(vocabulary)))
        np.add.at(counts, (words.text_of(), at[: len(words.hash)]), 1)
        number = {w: np.searchsorted(vocabulary, h) for w, h in zip([*marks, *TELLING_APART], hashes_of([*marks, *TELLING_APART]))}
        held = {w: counts[:, i] > 0 for w, i in number.items()}
        mark_of = np.full(len(vocabulary), -1)
        mark_of[[number[w] for w in marks]] = np.arange(len(marks))
        has = np.stack([held[w] for w in marks], axis=1)
        heeds = np.zeros_like(has)
        for family, own in [*TELLING_APART.items(), (None, VERSIONS)]:
            of = [marks.index(w) for w in own]
            heeds[np.ix_(held[family] if family else has[:, of].any(axis=1), of)] = True
        return cls(names, vocabulary, counts, mark_of, (heeds & has).astype(np.float32), (heeds & ~has).astype(np.float32))

    def agree(self, unit: np.ndarray, at: np.ndarray, units: int) -> np.ndarray:
        """Units by templates: whether words that tell licences apart agree; ``at`` are the words of each ``unit``."""
        held = np.zeros((units, self.wants.shape[1]), dtype=np.float32)
        some = self.mark_of[at] >= 0
        held[unit[some], self.mark_of[at[some]]] = 1
        return held @ self.bars.T + (1 - held) @ self.wants.T == 0

    def weigh(self, found: np.ndarray, sketch: np.ndarray, n: int, least: float) -> None:
        """Sets the weights from the documents (of ``n``) that hold each word; ``sketch`` has those of other words.

        ``telling`` marks words without one of which no template can be reached: the others' joint weight in any
        template stays below the threshold.
        """
        self.idf = np.log((1 + n) / (1 + found)) + 1
        self.other_idf = (np.log((1 + n) / (1 + sketch)) + 1).astype(np.float32)
        self.least = least
        weighed = self.counts * self.idf
        self.unit = weighed / np.linalg.norm(weighed, axis=1, keepdims=True)
        self.telling = self.counts.any(axis=0)
        joint = np.zeros(len(self.names))
        for w in np.argsort(self.idf, kind="stable"):
            joint = joint + self.unit[:, w] ** 2
            if joint.max() >= least**2:
                break
            self.telling[w] = False

    def places(self, hashed: np.ndarray) -> np.ndarray:
        """Number in the vocabulary of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at, -1)

    def weights(self, hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Weight of each word; of others that of the rarer of its two counters, which never count too little."""
        one, two = counters(hashed)
        return np.where(at >= 0, self.idf[at], np.maximum(self.other_idf[one], self.other_idf[two]))


def hashes_of(words: list[str]) -> np.ndarray:
    """The hash of each word."""
    _, _, data, offsets = next(blocks(pa.array(words), 1 << 30))
    return plain_words(data, offsets).hash


def counters(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of each word in the two rows of the sketch."""
    last = np.uint64(SKETCH - 1)
    return (hashed & last).astype(np.int64), ((hashed >> np.uint64(32)) & last).astype(np.int64) + SKETCH


def word_counts(docs: DataFrame, templates: Templates) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that hold each word of the vocabulary and each counter of the sketch, and the number of documents."""
    size = len(templates.vocabulary)
    wide = size + 2 * SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide + 1, dtype=np.int64)
        for batch in batches:
            total[wide] += batch.num_rows
            for _, _, data, offsets in blocks(batch.column(0)):
                words = plain_words(data, offsets)
                at, text = templates.places(words.hash), words.text_of()
                other = at < 0
                for held, of in ((at[~other], text[~other]), *((size + c, text[other]) for c in counters(words.hash[other]))):
                    np.add.at(total, np.unique(of * wide + held) % wide, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    out = np.zeros(wide + 1, dtype=np.int64)
    # One row per word of the templates and counter of the sketch.
    got = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("word").to_numpy()] = got.column("n").to_numpy()
    return out[:size], out[size:wide], int(out[wide])


def best_of(hashed: np.ndarray, unit_of: np.ndarray, units: int, templates: Templates) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine and template of each unit (-1 where no telling word stands); ``unit_of`` is the unit of each word."""
    at = templates.places(hashed)
    score, which = np.zeros(units), np.full(units, -1)
    telling = np.zeros(units, dtype=bool)
    telling[unit_of[(at >= 0) & templates.telling[at]]] = True
    if not telling.any():
        return score, which
    kept = telling[unit_of]
    pairs, count = np.unique(np.stack([unit_of[kept].astype(np.uint64), hashed[kept]], axis=1), axis=0, return_counts=True)
    own = pairs[:, 0].astype(np.int64)
    at = templates.places(pairs[:, 1])
    known = at >= 0
    weight = count * templates.weights(pairs[:, 1], at)
    norm = np.sqrt(np.bincount(own, weight**2, minlength=units))
    some = np.flatnonzero(telling)
    row = np.searchsorted(some, own[known])
    dots = np.zeros((len(some), len(templates.names)))
    np.add.at(dots, row, weight[known, None] * templates.unit[:, at[known]].T)
    dots /= np.maximum(norm[some], 1e-12)[:, None]
    dots[~templates.agree(row, at[known], len(some))] = 0
    score[some], which[some] = dots.max(axis=1), dots.argmax(axis=1)
    return score, which


def spans_of(hashed: np.ndarray, text: np.ndarray, templates: Templates) -> Iterator[tuple[np.ndarray, int]]:
    """Starts of the runs of words, within one text each, that could reach the threshold, with their length.

    The cosine to a template of what holds some of its words is at most the root of their part of its squared norm.
    """
    at, lengths = templates.places(hashed), templates.counts.sum(axis=1).astype(np.int64)
    part = np.concatenate([templates.unit**2, np.zeros((len(lengths), 1))], axis=1)  # the last is that of other words
    for length in np.unique(lengths):
        could = np.zeros(max(len(hashed) - length + 1, 0), dtype=bool)
        if not len(could):
            break
        for t in np.flatnonzero(lengths == length):
            held = np.concatenate([[0.0], np.cumsum(part[t][at])])
            could |= held[length:] - held[:-length] >= templates.least**2 - 1e-6
        could &= text[length - 1 :] == text[: len(could)]
        start = np.flatnonzero(could)
        step = max(SPAN_WORDS // length, 1)
        for i in range(0, len(start), step):
            yield start[i : i + step], int(length)


def scan_block(data: np.ndarray, offsets: np.ndarray, templates: Templates) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine and template of each text over its lines, its paragraphs, itself and its spans."""
    words, n = plain_words(data, offsets), len(offsets) - 1
    text, score, which = words.text_of(), np.zeros(n), np.full(n, -1)
    if not len(text):
        return score, which
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.start) + text  # never falls, and rises with each line and each text
    _, line = np.unique(line, return_inverse=True)
    lines_apart = np.diff(np.searchsorted(breaks, words.start), prepend=0)
    paragraph = np.cumsum((lines_apart > 1) | (np.diff(text, prepend=text[0]) > 0))
    _, paragraph = np.unique(paragraph, return_inverse=True)

    def take(hashed: np.ndarray, unit: np.ndarray, of_unit: np.ndarray) -> None:
        s, w = best_of(hashed, unit, len(of_unit), templates)
        order = np.lexsort((np.arange(len(of_unit)), -s))
        _, at = np.unique(of_unit[order], return_index=True)
        best = order[at]
        better = s[best] > score[of_unit[best]] + 1e-12
        score[of_unit[best][better]], which[of_unit[best][better]] = s[best][better], w[best][better]

    for unit in (line, paragraph, text):
        of_unit = np.zeros(int(unit[-1]) + 1, dtype=np.int64)
        of_unit[unit] = text
        take(words.hash, unit, of_unit)
    at = templates.places(words.hash)
    telling = np.zeros(n, dtype=bool)
    telling[text[(at >= 0) & templates.telling[at]]] = True
    hashed, text = words.hash[telling[text]], text[telling[text]]
    for start, length in spans_of(hashed, text, templates):
        rows = (start[:, None] + np.arange(length)).ravel()
        take(hashed[rows], np.repeat(np.arange(len(start)), length), text[start])
    return score, which


def scan(docs: DataFrame, text: str = "text", notices: dict[str, list[str]] = NOTICES, least: float = LEAST_COSINE) -> DataFrame:
    """All columns of ``docs`` and ``_licence``, ``_cosine``: the nearest template to any unit of the text and its cosine.

    Below ``least`` the licence is null (the cosine of the nearest stays). Templates that differ from a unit in words that
    tell licences apart count as cosine 0 there, so a licence that is not known but near to one is null. Null texts and texts without a word of
    the templates have cosine 0. Ties go to lines, then paragraphs, the whole, spans; to the earlier of them, then to the first template by name.
    """
    at, templates = docs.columns.index(text), Templates.of(notices)
    found, sketch, n = word_counts(docs.select(F.col(text).alias("text")), templates)
    templates.weigh(found, sketch, n, least)
    sent = docs.sparkSession.sparkContext.broadcast(templates)  # templates by vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        names = np.array([*held.names, None], dtype=object)
        for batch in batches:
            parts = [scan_block(data, offsets, held) for _, _, data, offsets in blocks(batch.column(at))]
            score = np.concatenate([p[0] for p in parts]) if parts else np.empty(0)
            which = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
            licence = pa.array(names[np.where(score >= least, which, -1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, licence, pa.array(np.minimum(score, 1.0))], names=[*batch.schema.names, "_licence", "_cosine"])

    return docs.mapInArrow(run, extended(docs, _licence="string", _cosine="double"))


def directory(path: Column) -> Column:
    """The directory of a path; empty for one without."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def above(folder: Column) -> Column:
    """The directory itself and all above it, the deepest first; the topmost is empty."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def is_licence_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    return F.regexp_replace(name, "\\.(txt|md|rst|html)$", "").isin(LICENCE_NAMES)


def inherit(scanned: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``_inherited_from`` and ``_effective``: the licence of a file, or that of the nearest directory above.

    A directory's licence is that of its licence files; of several the first by path counts, and files without a
    known licence are passed over. Directories meet each other, not files: every directory is looked up once, so a
    directory with very many files is one row. Files without a path inherit nothing.
    """
    files = scanned.withColumn("_folder", directory(F.col(path)))
    given = files.filter(is_licence_file(F.col(path)) & F.col("_licence").isNotNull()).groupBy(F.col("_folder").alias("_at"))
    given = given.agg(F.min(F.struct(F.col(path).alias("path"), F.col("_licence").alias("licence"))).alias("_given"))
    folders = files.filter(F.col("_licence").isNull()).select("_folder").distinct().filter("_folder IS NOT NULL")
    ways = folders.select("_folder", F.posexplode(above(F.col("_folder"))).alias("_steps", "_at"))
    nearest = ways.join(given, "_at").groupBy("_folder").agg(F.min(F.struct("_steps", "_given")).alias("_near"))
    nearest = stored(nearest.select(F.col("_folder").alias("_key"), F.col("_near._given.path").alias("_from"), F.col("_near._given.licence").alias("_theirs")))
    out = files.join(nearest, F.col("_licence").isNull() & (F.col("_folder") == F.col("_key")), "left")
    return out.withColumns({"_inherited_from": F.col("_from"), "_effective": F.coalesce("_licence", "_theirs")}).drop("_folder", "_key", "_from", "_theirs")
