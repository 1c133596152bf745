"""Text columns: cleaning, labels, trigrams, caps, slugs and light Markdown."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_VALUE = "(sin valor)"
# Texts that stand for a missing value.
NULL_LIKE = ["", "none", "nan", "null", "desconocido"]

SPACES = r"(?U)\s+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def words(c: Column) -> Column:
    """Words between white space, none of them empty."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def cap(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def clean_value(c: Column, most: int | None = None) -> Column:
    """One-line text of a value; ``(sin valor)`` for what means nothing.

    ``most`` cuts longer values for display; without it nothing is cut.
    """

    def cleaned(flat: Column) -> Column:
        cut = flat if most is None else F.when(F.length(flat) > most, F.concat(cap(flat, most), F.lit("..."))).otherwise(flat)
        return F.when(F.lower(flat).isin(NULL_LIKE), NO_VALUE).otherwise(cut)

    return F.coalesce(bind(collapse(c.cast("string")), cleaned), F.lit(NO_VALUE))


def drop_no_value(values: Column) -> Column:
    return F.filter(values, lambda v: v != NO_VALUE)


def clean_list(values: Column) -> Column:
    """Cleaned items joined by ``, ``; ``(sin valor)`` when none is left."""
    kept = F.coalesce(drop_no_value(F.transform(values, lambda v: clean_value(v))), F.array().cast("array<string>"))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(NO_VALUE)


def clean_pairs(pairs: list[tuple[str, Column]]) -> Column:
    """``Label: value`` pairs joined by ``; ``, without those that mean nothing."""
    kept = [
        F.when(clean_value(c) != NO_VALUE, F.concat(label(F.lit(name)), F.lit(": "), clean_value(c)))
        for name, c in pairs
    ]
    joined = F.concat_ws("; ", *kept)
    return F.when(joined != "", joined).otherwise(NO_VALUE)


def label(key: Column) -> Column:
    """Spaces for underscores, first character upper case, the rest lower case."""
    spaced = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.lower(F.substr(spaced, F.lit(2))))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the alphanumeric words, each padded by two spaces before and one after.

    The words are laid out with three spaces between them; every window of three characters that
    has a word character in its second or third place is a trigram of one padded word.
    """
    spaced = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "   "))
    padded = F.concat(F.lit("  "), spaced, F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=(.[^ ].|..[^ ]))"), F.lit(1)))


def literal_trigrams(term: str) -> list[str]:
    """The same trigrams for a term known when the query is built."""
    found = [p[i : i + 3] for w in re.findall(r"[^\W_]+", term.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]
    return sorted(set(found))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams of two texts."""


    def score(grams: Column) -> Column:
        shared = F.size(F.array_intersect(grams["a"], grams["b"]))
        total = F.size(grams["a"]) + F.size(grams["b"]) - shared
        return F.when(total > 0, shared / total).otherwise(0.0)

    return bind(F.struct(trigrams(a).alias("a"), trigrams(b).alias("b")), score)


def gram_pattern(gram: str) -> str:
    """Regular expression for a trigram inside lower-case text; its spaces stand for word ends."""
    inside = r"[\p{L}\p{N}]"
    bare = re.escape(gram.strip())
    before = f"(?<!{inside})" if gram.startswith(" ") else ""
    after = f"(?!{inside})" if gram.endswith(" ") else ""
    return before + bare + after


def necessary_pattern(terms: list[str], threshold: float) -> str:
    """Pattern that every text similar enough to some term matches.

    A similar text shares at least ``threshold`` of the term's trigrams. With all but one of that
    many left out - word starts first, they are the commonest - one of the others must occur. Places
    that begin none of them are passed over by one look at their character.
    """
    kept = []
    for term in terms:
        grams = sorted(literal_trigrams(term), key=lambda g: (len(g.strip()), -g.count(" ")))
        needed = math.ceil(round(threshold * len(grams), 9))
        kept += grams[max(0, needed - 1) :]
    starts = "".join(sorted({re.escape(g.strip()[0]) for g in kept}))
    return f"(?=[{starts}])(?:{'|'.join(gram_pattern(g) for g in sorted(set(kept)))})" if kept else ""


def resembles_any(c: Column, terms: list[str], threshold: float = 0.3) -> Column:
    """Trigram similarity with some term reaches ``threshold`` (inclusive).

    The terms are literals: their trigrams are computed once. A text's trigrams are computed only
    if it matches the pattern that every similar text matches.
    """

    def test(grams: Column) -> Column:
        hit = F.lit(False)
        for term in terms:
            wanted = literal_trigrams(term)
            if wanted:
                shared = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in wanted])))
                hit = hit | (shared >= threshold * (F.size(grams) + F.lit(len(wanted)) - shared))
        return hit

    pattern = necessary_pattern(terms, threshold)
    if not pattern:
        return F.lit(False)
    similar = F.when(F.lower(c).rlike(pattern), bind(trigrams(c), test))
    return F.coalesce(similar, F.lit(False))


def packed(c: Column) -> Column:
    """A text compressed, as it travels through a shuffle in many copies."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else zlib.compress(t.encode()))

    return run(c)


def unpacked(c: Column) -> Column:
    """The texts of an array of what ``packed`` made."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda x: None if x is None else [None if b is None else zlib.decompress(b).decode() for b in x])

    return run(c)


def token_estimate(c: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(F.length(c) / 4)


def slug(c: Column, size: int = 60, default: str = "report") -> Column:
    """Lower-case ASCII words joined by hyphens, at most ``size`` characters."""
    plain = F.translate(F.lower(c), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    kept = F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9_\s-]", ""), r"^[\s]+|[\s]+$", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")
    cut = cap(dashed, size)
    return F.when(cut == "", default).otherwise(cut)


def strip_code_fences(c: Column) -> Column:
    opened = F.regexp_replace(strip(c), r"\A```[a-zA-Z]*\n?", "")
    return strip(F.regexp_replace(opened, r"\n?```\z", ""))


def strip_inline_markdown(c: Column) -> Column:
    """Bold and italic marks removed: ``**``, ``*``, ``__``, then ``_``."""
    for mark in (r"\*\*", r"\*", "__", "_"):
        c = F.regexp_replace(c, f"{mark}(.+?){mark}", "$1")
    return c
