"""Cutting texts into chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_array(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters, each sharing ``overlap`` with the one before.

    The text is cut once into blocks of ``size - overlap``; a window is its own block followed by
    the head of the next ones, so the cost stays linear in the text. A last block that the window
    before already holds is left out.
    """
    step = size - overlap
    if not 0 < step:
        raise ValueError("overlap must be smaller than size")
    reach = -(-size // step)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    last = F.greatest(F.lit(0), F.floor((F.length(text) - overlap - 1) / step)).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.left(F.array_join(F.slice(blocks, i + 1, F.lit(reach)), ""), F.lit(size)),
    )
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def fixed_windows(
    df: DataFrame, text: str, keep: list[str], size: int = 1000, overlap: int = 200
) -> DataFrame:
    """One row per window, with its 0-based ``chunk_index``."""
    cut = F.posexplode(window_array(F.col(text), size, overlap)).alias("chunk_index", "text")
    out = df.select(*keep, cut)
    return out.withColumn("n_chars", F.length("text"))


# Separators from coarse to fine, for the plain and the adaptive splitter.
PLAIN_SEPARATORS = ["\n\n", "\n", " ", ""]
ADAPTIVE_SEPARATORS = ["\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""]

# Base, smallest and largest chunk size by language.
SIZES = {"es": (512, 200, 800), "en": (600, 250, 900), "fr": (480, 180, 750)}
DEFAULT_SIZES = (512, 200, 800)
BASE_OVERLAP = 50
SHORTEST = 50


def adaptive_size(n_chars: Column, language: Column) -> tuple[Column, Column]:
    """Chunk size and overlap for a text of this length and language."""

    def by_language(i: int) -> Column:
        out = F.lit(DEFAULT_SIZES[i])
        for code, sizes in SIZES.items():
            out = F.when(language == code, sizes[i]).otherwise(out)
        return out

    base, smallest, largest = (by_language(i) for i in range(3))
    size = (
        F.when(n_chars < 1000, F.greatest(smallest, F.floor(n_chars / 2)))
        .when(n_chars < 5000, base)
        .when(n_chars < 20000, F.least(largest, base + 100))
        .otherwise(largest)
        .cast("int")
    )
    overlap = (
        F.when(n_chars < 1000, F.least(F.lit(50), F.floor(size / 4)))
        .when(n_chars < 5000, F.lit(BASE_OVERLAP))
        .when(n_chars < 20000, F.greatest(F.lit(BASE_OVERLAP), F.floor(size / 8)))
        .otherwise(F.greatest(F.lit(100), F.floor(size / 6)))
        .cast("int")
    )
    return size, overlap


def cut_keeping(text: str, separator: str) -> list[str]:
    """Parts of ``text`` that each start with the separator, but for the first."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def runs(text: str, size: int, separators: list[str]) -> Iterator[list[str]]:
    """Runs of neighbouring parts shorter than ``size``; longer parts are cut by finer separators."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    run: list[str] = []
    for part in cut_keeping(text, separators[at]):
        if len(part) < size or not finer:
            run.append(part)
            continue
        if run:
            yield run
            run = []
        yield from runs(part, size, finer)
    if run:
        yield run


def pack(run: list[str], size: int, overlap: int) -> Iterator[str]:
    """Joins the parts of a run up to ``size``, carrying at most ``overlap`` into the next chunk."""
    held: deque[str] = deque()
    total = 0
    for part in run:
        if held and total + len(part) > size:
            yield "".join(held).strip()
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    yield "".join(held).strip()


def split_text(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    if not text:
        return []
    return [c for run in runs(text, size, separators) for c in pack(run, size, overlap) if c]


def join_short(pieces: list[str], size: int, shortest: int = SHORTEST, legacy: bool = False) -> list[str]:
    """Pieces under ``shortest`` join the one before if both fit in ``size``, else the next, else they stay alone.

    With ``legacy`` those that don't fit the one before are dropped.
    """
    out: list[str] = []
    waiting = ""
    for piece in pieces:
        if waiting:
            if len(waiting) + len(piece) < size:
                piece, waiting = f"{waiting} {piece}", ""
            else:
                out.append(waiting)
                waiting = ""
        if len(piece) >= shortest:
            out.append(piece)
        elif out and len(out[-1]) + len(piece) < size:
            out[-1] += f" {piece}"
        elif not legacy:
            waiting = piece
    return [*out, waiting] if waiting else out


SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s)|\Z)", re.S)


def sentence_runs(piece: str, size: int) -> list[str]:
    """Sentences packed up to ``size`` each; their end marks are kept."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for sentence in SENTENCE.findall(piece):
        if held and total + 1 + len(sentence) > size:
            out.append(" ".join(held))
            held, total = [], 0
        total += len(sentence) + (1 if held else 0)
        held.append(sentence)
    return [*out, " ".join(held)] if held else out


def cut_long(pieces: list[str], size: int) -> list[str]:
    """Pieces over one and a half times ``size`` cut at sentence ends."""
    return [c for p in pieces for c in (sentence_runs(p, size) if len(p) > 1.5 * size else [p])]


#: About so many characters of texts are worked on at once in Python, one text at least.
PART_CHARS = 1 << 20


def parts_of(texts: pd.Series, most: int = PART_CHARS) -> Iterator[slice]:
    """Runs of rows of a batch whose texts have about ``most`` characters together; one empty run of an empty batch."""
    start = held = 0
    for i, t in enumerate(texts):
        size = 256 + (len(t) if isinstance(t, str) else 0)  # a row takes room however short its text
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    yield slice(start, len(texts))


def cut_column(cut: Callable[[str, int, int], list[str]], text: Column, size: Column, overlap: Column) -> Column:
    """``cut(text, size, overlap)`` of every row, in Arrow batches; a null text has no pieces.

    Pieces are handed on by a part of a batch, so that Python never holds those of a whole one.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes, overlaps in batches:
            for part in parts_of(texts):
                rows = zip(texts.iloc[part], sizes.iloc[part], overlaps.iloc[part])
                yield pd.Series([cut(t or "", int(s), int(o)) for t, s, o in rows], dtype=object)

    return run(text, size, overlap)


def separator_chunks(text: Column, size: Column, overlap: Column, separators: list[str]) -> Column:
    """Chunks cut at the coarsest separators that fit."""
    return cut_column(lambda t, s, o: split_text(t, s, o, separators), text, size, overlap)


def sentence_chunks(text: Column, size: Column) -> Column:
    """Texts over one and a half times ``size`` cut at sentence ends, others whole."""
    return cut_column(lambda t, s, o: cut_long([t], s) if t else [], text, size, F.lit(0))


def adaptive_chunks(
    df: DataFrame, text: str, language: str, keep: list[str], overlap: int | None = None, legacy: bool = False
) -> DataFrame:
    """One row per chunk of the adaptive splitter, with size, overlap and 0-based ``chunk_index``.

    ``overlap`` replaces the one that goes with the size; ``legacy`` drops short pieces that fit nowhere.
    """

    def cut(given: str, size: int, shared: int) -> list[str]:
        pieces = split_text(given, size, shared, ADAPTIVE_SEPARATORS)
        return cut_long(join_short(pieces, size, legacy=legacy), size)

    size, usual = adaptive_size(F.length(text), F.col(language))
    sized = df.withColumn("size", size).withColumn("overlap", usual if overlap is None else F.lit(overlap))
    pieces = cut_column(cut, F.col(text), F.coalesce("size", F.lit(1)), F.coalesce("overlap", F.lit(0)))
    return sized.select(*keep, "size", "overlap", F.posexplode(pieces).alias("chunk_index", "text"))
