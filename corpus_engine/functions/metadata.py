"""Document metadata: reading model answers, normalising, merging and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.text import strip, words

# Field, label, whether it is required.
FIELDS = [
    ("title", "Título", True),
    ("description", "Resumen", True),
    ("dateIssued", "Fecha de publicación", True),
    ("resourceType", "Tipo de recurso", True),
    ("identifier", "Identificador persistente", True),
    ("creator", "Autor(es)", True),
    ("publisher", "Institución responsable", True),
    ("subject", "Palabras clave", False),
    ("rights", "Licencia", True),
    ("language", "Idioma", True),
]

# Aliases; for resource types the first entry with an alias in the text counts.
RESOURCE_TYPES = {
    "dataset": ["dataset", "datos", "base de datos", "conjunto de datos"],
    "text": ["texto", "documento", "document"],
    "report": ["informe", "reporte", "report", "estudio"],
    "article": ["artículo", "article", "paper", "publicación"],
    "book": ["libro", "book", "manual", "guía"],
    "map": ["mapa", "map", "cartografía", "plano"],
    "presentation": ["presentación", "presentation", "slides"],
    "software": ["software", "programa", "aplicación"],
    "audiovisual": ["video", "audio", "multimedia"],
    "image": ["imagen", "image", "foto", "fotografía"],
    "collection": ["colección", "collection", "serie"],
}
LICENSES = {
    "CC-BY": ["creative commons attribution", "cc by", "cc-by"],
    "CC-BY-SA": ["creative commons share alike", "cc by-sa", "cc-by-sa"],
    "CC-BY-NC": ["creative commons non commercial", "cc by-nc", "cc-by-nc"],
    "CC0": ["creative commons zero", "cc0", "dominio público"],
    "MIT": ["mit license", "mit"],
    "APACHE": ["apache license", "apache"],
    "GPL": ["gnu general public license", "gpl"],
}
LANGUAGES = {
    "es": ["español", "spanish"],
    "en": ["inglés", "english"],
    "fr": ["francés", "french"],
    "pt": ["portugués", "portuguese"],
    "it": ["italiano", "italian"],
    "de": ["alemán", "german"],
}
NO_DATA = ["no disponible", "n/a", "no data"]
NO_TITLE = "Documento sin título"
NO_DESCRIPTION = "Descripción no disponible"
NO_CREATOR = "Autor no especificado"
NO_PUBLISHER = "Institución no especificada"
ALL_RIGHTS = "Todos los derechos reservados"

# List items of a keyword answer, and the shapes of a name.
KEYWORD_PATTERNS = [
    r"\d+\.\s*([^,\n.]+)",
    r"-\s*([^,\n.]+)",
    r"•\s*([^,\n.]+)",
    r",\s*([^,\n.]+)",
    r":\s*([^,\n.]+)",
]
CREATOR_PATTERNS = [
    r"(?:autor|author|por|by):\s*([^\.\n]+)",
    r"([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)",
]

NO_STRINGS = "array<string>"


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.when(c != "", c)


def answered(c: Column) -> Column:
    """Null for an empty answer and for one that says there is no data."""
    return F.when(~F.lower(c).isin(NO_DATA), filled(c))


def found_all(c: Column, patterns: list[str]) -> Column:
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns])


def first_of(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def keywords(c: Column, most: int | None = None) -> Column:
    """Distinct list items of 3 to 30 characters, lower case; all unless ``most`` is given."""
    items = F.transform(found_all(c, KEYWORD_PATTERNS), lambda k: F.lower(strip(k)))
    return first_of(F.array_distinct(F.filter(items, lambda k: F.length(k).between(3, 30))), most)


def creators(c: Column, most: int | None = None) -> Column:
    """Distinct names, all unless ``most`` is given; the first three words when no name is found."""
    names = F.transform(found_all(c, CREATOR_PATTERNS), lambda n: F.regexp_replace(strip(n), "[,.]+$", ""))
    named = F.array_distinct(F.filter(names, lambda n: F.length(n).between(4, 99)))
    opening = F.array_join(F.slice(words(c), 1, 3), " ")
    fallback = F.array(F.when(opening != "", opening).otherwise(NO_CREATOR))
    return first_of(F.when(F.size(named) > 0, named).otherwise(fallback), most)


def generated_identifier(key: Column) -> Column:
    """Identifier in UUID form that depends on the row key alone."""
    return F.regexp_replace(F.md5(key.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def identifier(c: Column, key: Column) -> Column:
    """DOI, else UUID, else a generated identifier."""
    doi = F.regexp_extract(c, r"10\.\d+/[^\s]+", 0)
    uuid = F.regexp_extract(F.lower(c), "[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", 0)
    return F.coalesce(filled(doi), filled(uuid), generated_identifier(key))


def iso_date(c: Column, run_date: str) -> Column:
    """First date of the text as ``YYYY-MM-DD``: Y-M-D, D/M/Y, D-M-Y, a bare year, else ``run_date``."""

    def part(pattern: str, i: int) -> Column:
        return F.lpad(F.regexp_extract(c, pattern, i), 2, "0") if i else F.regexp_extract(c, pattern, 0)

    def joined(pattern: str, year: int, month: int, day: int) -> Column:
        y = F.regexp_extract(c, pattern, year)
        return F.when(y != "", F.concat_ws("-", y, part(pattern, month), part(pattern, day)))

    year = filled(F.regexp_extract(c, r"(\d{4})", 1))
    return F.when(
        c.isNotNull(),
        F.coalesce(
            joined(r"(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3),
            joined(r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, 2, 1),
            joined(r"(\d{1,2})-(\d{1,2})-(\d{4})", 3, 2, 1),
            F.concat(year, F.lit("-01-01")),
            F.lit(run_date),
        ),
    )


def compact_date(c: Column) -> Column:
    """``D:YYYYMMDD…`` as ``YYYY-MM-DD``, null for any other text, one without month or day included."""
    parts = [F.substr(c, F.lit(at), F.lit(n)) for at, n in ((3, 4), (7, 2), (9, 2))]
    return F.when(c.rlike(r"^D:\d{8}"), F.concat_ws("-", *parts))


def by_alias(low: Column, pairs: list[tuple[str, str]]) -> Column:
    """Value of the first alias that the text contains."""
    return F.coalesce(*[F.when(F.contains(low, F.lit(alias)), value) for alias, value in pairs])


def alias_pairs(table: dict[str, list[str]], longest_first: bool = False) -> list[tuple[str, str]]:
    pairs = [(alias, value) for value, aliases in table.items() for alias in aliases]
    return sorted(pairs, key=lambda p: -len(p[0])) if longest_first else pairs


def resource_type(c: Column) -> Column:
    return F.when(c.isNotNull(), F.coalesce(by_alias(F.lower(c), alias_pairs(RESOURCE_TYPES)), F.lit("text")))


def license_code(c: Column, legacy_order: bool = False) -> Column:
    """License code; any other text stays as it is.

    The longest alias counts, so that ``cc by-sa`` is not taken for ``cc by``; ``legacy_order``
    takes the first entry of the table instead.
    """
    low, text = F.lower(c), F.trim(c)
    known = by_alias(low, alias_pairs(LICENSES, longest_first=not legacy_order))
    loose = F.when(F.contains(low, F.lit("creative commons")) | F.contains(low, F.lit("cc")), "CC-BY")
    return F.when(c.isNotNull(), F.coalesce(known, loose, filled(text), F.lit(ALL_RIGHTS)))


def language_code(c: Column) -> Column:
    low = F.trim(F.lower(c))
    code = F.when(low.isin(list(LANGUAGES)), low)
    return F.when(c.isNotNull(), F.coalesce(code, by_alias(low, alias_pairs(LANGUAGES)), F.lit("es")))


def read_answers(df: DataFrame, run_date: str, key: str) -> DataFrame:
    """Model answers (``model_*``) read field by field; unanswered fields are null."""
    readers = {
        "model_title": strip,
        "model_description": strip,
        "model_date": lambda c: iso_date(c, run_date),
        "model_type": resource_type,
        "model_identifier": lambda c: F.when(c.isNotNull(), identifier(c, F.col(key))),
        "model_creator": lambda c: F.when(c.isNotNull(), creators(c)),
        "model_publisher": strip,
        "model_keywords": lambda c: F.when(c.isNotNull(), keywords(c)),
        "model_rights": license_code,
        "model_language": language_code,
    }
    return df.withColumns({name: read(answered(F.col(name))) for name, read in readers.items()})


def merge(
    df: DataFrame, run_date: str, key: str, most_creators: int | None = None, most_subjects: int | None = None
) -> DataFrame:
    """The ten fields from file metadata and read answers.

    The longer title wins; description, date, identifier and type prefer the answer, publisher,
    rights and language the file; names and keywords are united in that order, all of them unless a
    number is given. Columns ``file_rights``, ``file_identifier`` and ``file_type`` are read where
    the table has them.
    """

    def from_file(name: str) -> Column:
        return filled(F.col(name)) if name in df.columns else F.lit(None).cast("string")

    none = F.array().cast(NO_STRINGS)
    file_title, model_title = filled(F.col("file_title")), filled(F.col("model_title"))
    longer = F.when(F.length(model_title) > F.length(file_title), model_title)
    named = F.concat(F.array(strip(F.col("file_creator"))), F.coalesce(F.col("model_creator"), none))
    names = F.array_distinct(F.filter(F.transform(named, strip), lambda n: n != ""))
    listed = F.transform(F.split(F.coalesce("file_keywords", F.lit("")), "[,;]"), lambda k: F.lower(strip(k)))
    answers = F.transform(F.coalesce(F.col("model_keywords"), none), lambda k: F.lower(k))
    subject = F.array_distinct(F.filter(F.concat(listed, answers), lambda k: F.length(k) > 2))
    return df.select(
        key,
        F.coalesce(longer, file_title, model_title, F.lit(NO_TITLE)).alias("title"),
        F.coalesce(
            filled(F.col("model_description")), filled(F.col("file_description")), F.lit(NO_DESCRIPTION)
        ).alias("description"),
        F.coalesce("model_date", compact_date(F.col("file_date")), F.lit(run_date)).alias("dateIssued"),
        F.coalesce("model_type", resource_type(from_file("file_type")), F.lit("text")).alias("resourceType"),
        F.coalesce("model_identifier", from_file("file_identifier"), generated_identifier(F.col(key))).alias("identifier"),
        first_of(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(NO_CREATOR))), most_creators).alias("creator"),
        F.coalesce(filled(F.col("file_publisher")), filled(F.col("model_publisher")), F.lit(NO_PUBLISHER)).alias(
            "publisher"
        ),
        first_of(subject, most_subjects).alias("subject"),
        F.coalesce(license_code(from_file("file_rights")), "model_rights", F.lit(ALL_RIGHTS)).alias("rights"),
        F.coalesce(language_code(filled(F.col("file_language"))), "model_language", F.lit("es")).alias("language"),
    )


def has_value(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    is_list = df.schema[name].dataType.typeName() == "array"
    return F.coalesce(F.size(c) > 0 if is_list else c != "", F.lit(False))


def completeness(df: DataFrame) -> DataFrame:
    """Adds ``quality_score`` and the labels of missing required and optional fields."""
    present = {name: has_value(df, name) for name, _, _ in FIELDS}
    completed = sum((p.cast("int") for p in present.values()), F.lit(0))

    def missing(required: bool) -> Column:
        labels = [F.when(~present[n], F.lit(label)) for n, label, r in FIELDS if r is required]
        return F.filter(F.array(*labels), lambda m: m.isNotNull())

    return df.withColumns(
        {
            "quality_score": F.round(completed / len(FIELDS) * 100, 2),
            "missing_required": missing(True),
            "missing_optional": missing(False),
        }
    )


def catalogue_payload(df: DataFrame, key: str, slugs: DataFrame, extras: list[str] = ()) -> DataFrame:
    """Metadata under catalogue names; empty fields are null, extras never replace a field.

    ``slugs`` holds (key, ``slugs``) of the keywords the controlled vocabulary knows.
    """
    names = {"title": "title", "description": "abstract", "language": "language"}
    joined = df.join(slugs, key, "left")
    out = [filled(F.col(a)).alias(b) for a, b in names.items()]
    taken = {"title", "abstract", "language", "keywords", "attribution"}
    return joined.select(
        key,
        *out,
        F.when(F.size("slugs") > 0, F.col("slugs")).alias("keywords"),
        filled(F.concat_ws(", ", "creator")).alias("attribution"),
        *[filled(F.col(e)).alias(e) for e in extras if e not in taken],
    )


def vocabulary_slugs(docs: DataFrame, key: str, words_column: str, vocabulary: DataFrame) -> DataFrame:
    """Slugs of the listed words that the vocabulary (``name``, ``slug``) knows, in list order."""
    known = vocabulary.groupBy(F.lower(F.trim("name")).alias("word")).agg(F.max("slug").alias("slug"))
    asked = docs.select(key, F.posexplode(words_column).alias("place", "word"))
    hits = asked.withColumn("word", F.lower(F.trim("word"))).join(known, "word")
    ordered = F.array_sort(F.collect_list(F.struct("place", "slug")))
    return hits.groupBy(key).agg(F.transform(ordered, lambda h: h["slug"]).alias("slugs"))
