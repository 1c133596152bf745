"""Language guess by function words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_engine.functions.text import bind, cap

# Frequent function words by language; the first language wins a tie.
FUNCTION_WORDS = {
    "es": "de la que el en y los se del las por un para con una su al lo como más pero sus le ya o".split(),
    "en": "the of and to in is that it for was on are as with his they at be this from or had by not but".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus au pas sur ne se ce il sont".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
}
DEFAULT_LANGUAGE = "es"
SAMPLE_CHARS = 2000
LEAST_CHARS = 10


def within(listed: list[str]) -> Callable[[Column], Column]:
    return lambda word: word.isin(listed)


def guess_language(text: Column, sample: int | None = None) -> Column:
    """Language with the most function words; ``es`` for short or wordless texts.

    The whole text is read unless ``sample`` says how many characters (``SAMPLE_CHARS`` is a usual number).
    """
    seen = text if sample is None else cap(text, sample)
    tokens = F.filter(F.split(F.lower(seen), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    names = F.array(*[F.lit(lang) for lang in FUNCTION_WORDS])

    def winner(found: Column) -> Column:
        hits = [F.size(F.filter(found, within(ws))) for ws in FUNCTION_WORDS.values()]
        plain = F.trim(F.regexp_replace(seen, r"[^\p{L}\p{N}_\s]", " "))
        # Spaces between words only add to the length, so most texts need no second look.
        short = (F.length(F.array_join(found, "")) < LEAST_CHARS) & (F.length(plain) < LEAST_CHARS)
        return F.when(~short, bind(F.array(*hits), best_language))

    def best_language(counts: Column) -> Column:
        best = F.array_max(counts)
        return F.when(best > 0, F.element_at(names, F.array_position(counts, best).cast("int")))

    return F.coalesce(bind(tokens, winner), F.lit(DEFAULT_LANGUAGE))
