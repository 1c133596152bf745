"""Places named by a model: parsing answers, cleaning, first-wins dedup, geometry and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.functions.records import elements, parse_whole
from corpus_engine.functions.text import words

# Place types, their synonyms, and words that mark a name as no jurisdiction.
DEFAULT_TYPES = ["país", "estado", "municipio", "localidad"]
SETTLEMENTS = ["ciudad", "pueblo", "aldea"]
STRUCTURES = ["edificio", "museo", "parque", "universidad", "infraestructura"]
ROAD_WORDS = ["calle", "avenida"]
SIMPLE_BLACKLIST = [
    "catedral", "palacio", "jardines", "gran muralla", "parque nacional", "museo", "universidad", "unesco",
    "zona arqueológica", "abadía", "basílica", "conjunto", "sitio", "centro histórico", "reserva", "santuario",
    "templo", "fortaleza", "castillo", "monasterio",
]
BLACKLIST = [
    "catedral", "palacio", "jardines", "gran muralla", "parque nacional", "museo", "universidad", "instituto",
    "unesco", "zona arqueológica", "abadía", "basílica", "conjunto", "sitio", "centro histórico", "reserva",
    "santuario", "templo", "fortaleza", "castillo", "monasterio", "calle", "avenida",
]
NO_CONTEXT = "Contexto no proporcionado por el modelo."
UNKNOWN_PLACE = "No especificado"
NOT_AVAILABLE = ["N/A", "n/a", "N/a", ""]


def parse_answer(response: Column) -> Column:
    """JSON value in an answer: the text itself, its outermost object, or its outermost list."""
    text = F.trim(response)
    direct = F.when(text.startswith("{") | text.startswith("["), parse_whole(text))
    inner = parse_whole(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    listed = parse_whole(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")))
    return F.coalesce(direct, inner, listed)


def parse_answers(answers: DataFrame, response: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Answers with their ``items``, and those without any JSON.

    The items are the list in ``field`` of an object, or a bare list; an object without the field
    has none.
    """
    # A generator's output is computed once, however many filters and columns name it.
    parsed = answers.select("*", F.inline(F.array(F.struct(parse_answer(F.col(response)).alias("answer")))))
    held = F.try_variant_get("answer", f"$.{field}", "array<variant>")
    items = F.coalesce(held, elements(F.col("answer")), F.array().cast("array<variant>"))
    good = parsed.filter(F.col("answer").isNotNull()).withColumn("items", items).drop("answer")
    return good, parsed.filter(F.col("answer").isNull()).drop("answer")


def entity_rows(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per item of parsed answers with all that cleaning reads; what an item lacks is null."""
    rows = parsed.select(*keep, F.posexplode("items").alias("place", "item"))
    texts = [F.try_variant_get("item", f"$.{n}", "string").alias(n) for n in ("name", "type", "context", "estado", "pais")]
    return rows.select(*keep, "place", *texts, F.try_variant_get("item", "$.coordenadas", "array<double>").alias("coordenadas"))


def harmonised_type(kind: Column, requested: list[str] = DEFAULT_TYPES) -> Column:
    """Type among the requested ones; null when it has no place there."""
    low = F.lower(F.trim(kind))
    settlement = next((t for t in ("localidad", "municipio") if t in requested), None)
    mapped = low
    if settlement:
        mapped = F.when(low.isin(SETTLEMENTS), settlement).otherwise(mapped)
    if "infraestructura" in requested:
        mapped = F.when(low.isin(STRUCTURES), "infraestructura").otherwise(mapped)
    fallback = F.lit("localidad" if "localidad" in requested else None)
    return F.when(mapped.isin(requested), mapped).otherwise(fallback)


def plausible_name(name: Column, max_words: int, blacklist: list[str]) -> Column:
    """Some text of few words, without digits and without blacklisted words."""
    low = F.lower(F.trim(name))
    banned = F.exists(F.array(*[F.lit(b) for b in blacklist]), lambda b: F.contains(low, b))
    ok = (low != "") & (F.size(words(low)) <= max_words) & ~banned & ~low.rlike(r"\p{Nd}")
    return F.coalesce(ok, F.lit(False))


def plausible_entity(name: Column, kind: Column, requested: list[str] = DEFAULT_TYPES) -> Column:
    structures = "infraestructura" in requested
    ok = plausible_name(name, 8 if structures else 5, ROAD_WORDS if structures else BLACKLIST)
    return ok & F.coalesce(kind != "", F.lit(False))


def plausible_location(name: Column) -> Column:
    """The stricter test of the plain location list."""
    return plausible_name(name, 4, SIMPLE_BLACKLIST)


def literally_named(name: Column, context: Column) -> Column:
    """The context holds the name or one of its longer words; no context proves nothing."""
    low, text = F.lower(F.trim(name)), F.lower(F.coalesce(context, F.lit("")))
    long_words = F.filter(words(low), lambda w: F.length(w) > 3)
    found = F.contains(text, low) | F.exists(long_words, lambda w: F.contains(text, w))
    return text.isin("", NO_CONTEXT.lower()) | found


def first_wins(df: DataFrame, keys: list[Column], order: list[str | Column]) -> DataFrame:
    """First row of each key; every partition keeps only its first before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") == 1).drop("_n")


def with_hierarchy(df: DataFrame, focus: str | None) -> DataFrame:
    """State and country where the type calls for them and they are missing or not available."""

    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.col(c).isin(NOT_AVAILABLE)

    country = focus if focus and focus != "auto" else UNKNOWN_PLACE
    below_state = F.col("type").isin("municipio", "localidad")
    return df.withColumns(
        {
            "estado": F.when(below_state & missing("estado"), UNKNOWN_PLACE).otherwise(F.col("estado")),
            "pais": F.when((below_state | (F.col("type") == "estado")) & missing("pais"), country).otherwise(
                F.col("pais")
            ),
        }
    )


def context_or_default(context: Column) -> Column:
    return F.coalesce(context, F.lit(NO_CONTEXT))


def clean_entities(
    entities: DataFrame, order: list[str], requested: list[str] = DEFAULT_TYPES, focus: str | None = None
) -> DataFrame:
    """Harmonise, filter, keep the first of each (name, type), fill the hierarchy."""
    named = entities.filter(plausible_entity(F.col("name"), F.col("type"), requested))
    typed = named.withColumns(
        {"name": F.trim("name"), "type": harmonised_type(F.col("type"), requested)}
    ).filter(F.col("type").isNotNull())
    proven = typed.filter(literally_named(F.col("name"), F.col("context")))
    unique = first_wins(proven, [F.lower("name"), F.col("type")], order)
    return with_hierarchy(unique.withColumn("context", context_or_default(F.col("context"))), focus)


def point(coordinates: Column) -> Column:
    """GeoJSON point of exactly two numbers [longitude, latitude], else null."""
    valid = (F.size(coordinates) == 2) & F.forall(coordinates, lambda c: c.isNotNull())
    return F.when(valid, F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")))


def with_geometry(entities: DataFrame, boundaries: DataFrame, wanted: str) -> DataFrame:
    """Looks up a polygon or centroid by name, and by state and country where both sides know them.

    The entities are distinct by name and type; of several boundaries the one that agrees most wins.
    Adds ``boundary`` and ``osm_<wanted>_found``; a shape of another kind counts as not found.
    """
    accepted = {"polygon": ["Polygon", "MultiPolygon"], "centroid": ["Point"]}[wanted]

    def known(c: Column) -> Column:
        return F.when(c != UNKNOWN_PLACE, c)

    e, b = entities.alias("e"), boundaries.alias("b")
    fits = F.col("e.name") == F.col("b.name")
    exact = F.lit(0)
    for side in ("estado", "pais"):
        mine, theirs = known(F.col(f"e.{side}")), F.col(f"b.{side}")
        fits = fits & (mine.isNull() | theirs.isNull() | (mine == theirs))
        exact = exact + F.coalesce((mine == theirs).cast("int"), F.lit(0))
    right_kind = F.col("b.geometry_type").isin(accepted)
    joined = e.join(b, fits, "left").select(
        "e.*", F.when(right_kind, F.col("b.geometry")).alias("boundary"), (-exact).alias("_looseness")
    )
    best = first_wins(joined, [F.lower("name"), F.col("type")], ["_looseness", F.col("boundary").asc_nulls_last()])
    return best.withColumn(f"osm_{wanted}_found", F.col("boundary").isNotNull()).drop("_looseness")


def features(entities: DataFrame, properties: list[str], coordinates: str = "coordenadas") -> Column:
    """GeoJSON feature of an entity as text."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            point(F.col(coordinates)).alias("geometry"),
            F.struct(*properties).alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )


def location_list(named: DataFrame, group: str, name: str) -> DataFrame:
    """Distinct plausible locations of each group, one row each, in order."""
    clean = named.filter(plausible_location(F.col(name)))
    return clean.select(group, F.trim(name).alias("location")).distinct().orderBy(group, "location")
