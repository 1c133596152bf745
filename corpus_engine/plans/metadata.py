"""Queries over document metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.functions import metadata as M
from corpus_engine.plans.registry import query

RUN_DATE = "2024-01-01"

CTES = {
    "numbered": """
        SELECT doc_id, lang, source, o_orderpriority AS prio, strftime(o_orderdate, '%Y-%m-%d') AS day,
               year(o_orderdate) AS y, m.* EXCLUDE (doc_id),
               regexp_replace(md5(doc_id::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS made
        FROM model_metadata m JOIN documents USING (doc_id) JOIN orders ON o_orderkey = doc_id""",
    "answers": """
        SELECT *,
          CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 4 = 3 THEN y || '-01-01' ELSE day END END AS a_date,
          CASE doc_id % 4 WHEN 0 THEN ['Ana ' || source] WHEN 1 THEN ['Luis Pérez', 'María López']
                          WHEN 2 THEN ['sin firma de'] END AS a_creator,
          CASE doc_id % 3 WHEN 1 THEN ['clima', lower(prio), lower(prio[3:]), 'ríos', 'mares', 'lagos']
                          WHEN 2 THEN ['suelo', 'clima', 'agua'] END AS a_keywords,
          CASE doc_id % 4 WHEN 0 THEN '10.1234/abc.' || doc_id WHEN 1 THEN '0f8fad5b-d9cb-469f-a165-70867728950e'
                          WHEN 2 THEN made END AS a_identifier,
          ['dataset', 'report', 'map', 'text', 'article', 'text', 'report'][doc_id % 7 + 1] AS a_type,
          ['CC-BY-SA', 'MIT', 'CC-BY', 'CC-BY', 'GPL', 'Uso interno', 'CC0', 'Todos los derechos reservados']
            [doc_id % 8 + 1] AS a_rights,
          ['es', 'en', 'fr', 'de', 'es', NULL, 'pt'][doc_id % 7 + 1] AS a_language,
          CASE WHEN doc_id % 2 = 0 THEN 'Instituto B' END AS a_publisher,
          CASE WHEN doc_id % 6 > 1 THEN model_description END AS a_description
        FROM numbered""",
    "merged": """
        SELECT doc_id,
          CASE WHEN length(model_title) > length(file_title) THEN model_title
               ELSE coalesce(file_title, model_title, 'Documento sin título') END AS title,
          coalesce(a_description, file_description, 'Descripción no disponible') AS description,
          coalesce(a_date, CASE WHEN doc_id % 2 = 0 THEN day END, '2024-01-01') AS "dateIssued",
          a_type AS "resourceType", coalesce(a_identifier, made) AS identifier,
          CASE WHEN doc_id % 3 <> 0 OR a_creator IS NOT NULL
               THEN (CASE WHEN doc_id % 3 <> 0 THEN ['Autor ' || source] ELSE [] END) || coalesce(a_creator, [])
               ELSE ['Autor no especificado'] END AS creator,
          coalesce(file_publisher, a_publisher, 'Institución no especificada') AS publisher,
          (CASE WHEN doc_id % 5 = 0 THEN ['agua', 'suelo'] ELSE [] END)
            || list_filter(coalesce(a_keywords, []), lambda k: doc_id % 5 <> 0 OR k NOT IN ('agua', 'suelo')) AS subject,
          a_rights AS rights, coalesce(CASE WHEN doc_id % 5 < 2 THEN lang END, a_language, 'es') AS language
        FROM answers""",
}


def metadata(spark, d):
    return T.model_metadata(spark, d)


def answers(spark, d):
    return M.read_answers(metadata(spark, d), RUN_DATE, "doc_id")


def merged(spark, d):
    return M.merge(answers(spark, d), RUN_DATE, "doc_id")


@query("x27_keywords", "SELECT doc_id, array_to_string(a_keywords, '|') AS keywords FROM answers", CTES)
def x27(spark, d):
    words = F.array_join(M.keywords(F.col("model_keywords")), "|")
    return metadata(spark, d).select("doc_id", words.alias("keywords"))


@query("x28_creators", "SELECT doc_id, array_to_string(a_creator, '|') AS creators FROM answers", CTES)
def x28(spark, d):
    return answers(spark, d).select("doc_id", F.array_join("model_creator", "|").alias("creators"))


@query("x29_identifier", "SELECT doc_id, coalesce(a_identifier, made) AS identifier FROM answers", CTES)
def x29(spark, d):
    return metadata(spark, d).select(
        "doc_id", M.identifier(F.col("model_identifier"), F.col("doc_id")).alias("identifier")
    )


@query(
    "x30_normalised_codes",
    """SELECT doc_id, a_type AS resource_type, a_rights AS license,
              CASE WHEN doc_id % 8 = 0 THEN 'CC-BY' ELSE a_rights END AS license_legacy,
              coalesce(a_language, 'es') AS language FROM answers""",
    CTES,
)
def x30(spark, d):
    return metadata(spark, d).select(
        "doc_id",
        M.resource_type(F.col("model_type")).alias("resource_type"),
        M.license_code(F.col("model_rights")).alias("license"),
        M.license_code(F.col("model_rights"), legacy_order=True).alias("license_legacy"),
        M.language_code(F.col("model_language")).alias("language"),
    )


@query(
    "x31_metadata_merge",
    """SELECT * REPLACE (array_to_string(creator, '|') AS creator, array_to_string(subject, '|') AS subject)
       FROM merged""",
    CTES,
)
def x31(spark, d):
    joined = {c: F.array_join(c, "|") for c in ("creator", "subject")}
    return merged(spark, d).withColumns(joined)


@query(
    "x33_unanswered",
    """SELECT doc_id, CASE WHEN doc_id % 6 > 1 THEN model_description END AS description,
              CASE WHEN doc_id % 2 = 0 THEN model_publisher END AS publisher FROM model_metadata""",
)
def x33(spark, d):
    return metadata(spark, d).select(
        "doc_id",
        M.answered(F.col("model_description")).alias("description"),
        M.answered(F.col("model_publisher")).alias("publisher"),
    )


@query("x34_date_extraction", "SELECT doc_id, a_date AS issued FROM answers", CTES)
def x34(spark, d):
    return metadata(spark, d).select("doc_id", M.iso_date(F.col("model_date"), RUN_DATE).alias("issued"))


@query("x35_compact_date", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN day END AS issued FROM numbered", CTES)
def x35(spark, d):
    return metadata(spark, d).select("doc_id", M.compact_date(F.col("file_date")).alias("issued"))


@query(
    "a14_completeness",
    """SELECT doc_id, round((10 - len(req) - len(opt)) / 10 * 100, 2) AS quality_score,
              array_to_string(req, '|') AS missing_required, array_to_string(opt, '|') AS missing_optional FROM
         (SELECT doc_id, list_filter([CASE WHEN model_title IS NULL THEN 'Título' END,
            CASE WHEN a_description IS NULL THEN 'Resumen' END, CASE WHEN a_date IS NULL THEN 'Fecha de publicación' END,
            CASE WHEN a_identifier IS NULL THEN 'Identificador persistente' END,
            CASE WHEN a_creator IS NULL THEN 'Autor(es)' END,
            CASE WHEN a_publisher IS NULL THEN 'Institución responsable' END,
            CASE WHEN a_language IS NULL THEN 'Idioma' END], lambda m: m IS NOT NULL) AS req,
            CASE WHEN a_keywords IS NULL THEN ['Palabras clave'] ELSE [] END AS opt FROM answers)""",
    CTES,
)
def a14(spark, d):
    names = dict(
        title="model_title", description="model_description", dateIssued="model_date", resourceType="model_type",
        identifier="model_identifier", creator="model_creator", publisher="model_publisher",
        subject="model_keywords", rights="model_rights", language="model_language",
    )
    scored = M.completeness(answers(spark, d).select("doc_id", *[F.col(v).alias(k) for k, v in names.items()]))
    return scored.select(
        "doc_id",
        "quality_score",
        F.array_join("missing_required", "|").alias("missing_required"),
        F.array_join("missing_optional", "|").alias("missing_optional"),
    )


@query("a14_corpus_score", "SELECT 100.0::DOUBLE - 10 * avg((len(subject) = 0)::INT) AS mean_score FROM merged", CTES)
def a14_corpus(spark, d):
    return M.completeness(merged(spark, d)).agg(F.round(F.avg("quality_score"), 6).alias("mean_score"))


@query(
    "j12_vocabulary_lookup",
    """SELECT p_partkey, array_to_string([lower(p_type) || '-x'] ||
              (CASE WHEN p_size % 2 = 0 THEN ['large-x'] ELSE [] END), '|') AS slugs FROM part""",
)
def j12(spark, d):
    part = T.load(spark, d, "part")
    vocabulary = part.select(F.col("p_type").alias("name"), F.concat(F.lower("p_type"), F.lit("-x")).alias("slug"))
    words = F.array(
        F.col("p_brand"),
        F.concat(F.lit(" "), F.lower("p_type")),
        F.when(F.col("p_size") % 2 == 0, "Large ").otherwise("nada"),
    )
    docs = part.select("p_partkey", words.alias("words"))
    return M.vocabulary_slugs(docs, "p_partkey", "words", vocabulary.distinct()).select(
        "p_partkey", F.array_join("slugs", "|").alias("slugs")
    )


@query(
    "x32_catalogue_payload",
    """SELECT doc_id, title, description AS abstract, language,
              nullif(array_to_string(list_transform(list_filter(subject, lambda k: k LIKE '%-%'),
                                                    lambda k: 'p' || k[1]), '|'), '') AS keywords,
              array_to_string(creator, ', ') AS attribution, publisher FROM merged""",
    CTES,
)
def x32(spark, d):
    rows = merged(spark, d)
    priority = T.load(spark, d, "orders").select("o_orderpriority").distinct()
    vocabulary = priority.select(
        F.col("o_orderpriority").alias("name"), F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))).alias("slug")
    )
    slugs = M.vocabulary_slugs(rows, "doc_id", "subject", vocabulary)
    out = M.catalogue_payload(rows, "doc_id", slugs, extras=["publisher", "title"])
    return out.withColumn("keywords", F.array_join("keywords", "|"))
