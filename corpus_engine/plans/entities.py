"""Queries over places named by a model, and over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.operators import conversations as V
from corpus_engine.operators import entities as E
from corpus_engine.plans.registry import query

ORDER = ["file_ord", "batch", "pos"]
KEEP = ["pos", "name", "type"]

CTES = {
    "plausible": """
        SELECT * FROM model_entities WHERE trim(name) <> '' AND len(string_split(name, ' ')) <= 5
          AND NOT contains(lower(name), 'museo') AND NOT regexp_matches(name, '[0-9]')""",
    "typed": """
        SELECT * REPLACE (CASE WHEN type IN ('país', 'estado', 'municipio', 'localidad') THEN type
                               ELSE 'localidad' END AS type) FROM plausible""",
    "proven": """
        SELECT * FROM typed WHERE context IS NULL OR contains(lower(context), lower(name))
          OR len(list_filter(string_split(lower(name), ' '),
                             lambda w: length(w) > 3 AND contains(lower(context), w))) > 0""",
    "winners": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), type ORDER BY file_ord, batch, pos) AS n
                       FROM proven) WHERE n = 1""",
    "cleaned": """
        SELECT pos, name, type, coalesce(context, 'Contexto no proporcionado por el modelo.') AS context,
               CASE WHEN type IN ('municipio', 'localidad') AND coalesce(estado, 'N/A') IN ('N/A', 'n/a', '')
                    THEN 'No especificado' ELSE estado END AS estado,
               CASE WHEN type <> 'país' AND coalesce(pais, 'N/A') IN ('N/A', 'n/a', '')
                    THEN 'Chile' ELSE pais END AS pais, coordenadas
        FROM winners""",
}


def cleaned(spark, d):
    return E.clean_entities(T.model_entities(spark, d), ORDER, focus="Chile")


@query("p17_plausible_entities", "SELECT pos, name, type FROM plausible", CTES)
def p17(spark, d):
    return T.model_entities(spark, d).filter(E.plausible_entity(F.col("name"), F.col("type"))).select(*KEEP)


@query(
    "p17_with_structures",
    """SELECT pos, name, type FROM model_entities WHERE NOT regexp_matches(name, '[0-9]')""",
)
def p17_structures(spark, d):
    requested = [*E.DEFAULT_TYPES, "infraestructura"]
    keep = E.plausible_entity(F.col("name"), F.col("type"), requested)
    return T.model_entities(spark, d).filter(keep).select(*KEEP)


@query(
    "p18_literal_evidence",
    """SELECT pos, name, context FROM model_entities WHERE context IS NULL OR contains(lower(context), lower(name))
       OR len(list_filter(string_split(lower(name), ' '),
                          lambda w: length(w) > 3 AND contains(lower(context), w))) > 0""",
)
def p18(spark, d):
    keep = E.literally_named(F.col("name"), F.col("context"))
    return T.model_entities(spark, d).filter(keep).select("pos", "name", "context")


@query(
    "w5_first_occurrence",
    """SELECT pos, name, type FROM
         (SELECT *, row_number() OVER (PARTITION BY lower(name), type ORDER BY file_ord, batch, pos) AS n
          FROM model_entities) WHERE n = 1""",
)
def w5(spark, d):
    return E.first_wins(T.model_entities(spark, d), [F.lower("name"), F.col("type")], ORDER).select(*KEEP)


@query(
    "x23_harmonised_types",
    """SELECT pos, CASE WHEN type IN ('país', 'estado', 'municipio', 'localidad') THEN type ELSE 'localidad' END
                AS by_default,
              CASE WHEN type IN ('museo', 'edificio') THEN 'infraestructura' WHEN type = 'ciudad' THEN 'municipio'
                   WHEN type = 'municipio' THEN type END AS without_towns
       FROM model_entities""",
)
def x23(spark, d):
    kind = F.col("type")
    return T.model_entities(spark, d).select(
        "pos",
        E.harmonised_type(kind).alias("by_default"),
        E.harmonised_type(kind, ["municipio", "infraestructura"]).alias("without_towns"),
    )


@query("x24_hierarchy_defaults", "SELECT pos, name, type, estado, pais FROM cleaned", CTES)
def x24(spark, d):
    return cleaned(spark, d).select(*KEEP, "estado", "pais")


@query(
    "x25_default_context",
    "SELECT pos, coalesce(context, 'Contexto no proporcionado por el modelo.') AS context FROM model_entities",
)
def x25(spark, d):
    return T.model_entities(spark, d).select("pos", E.context_or_default(F.col("context")).alias("context"))


@query(
    "x38_coordinates",
    """SELECT pos, CASE WHEN pos % 9 <> 0 AND pos % 3 <> 2 THEN 'Point' END AS shape,
              CASE WHEN pos % 9 <> 0 AND pos % 3 <> 2 THEN coordenadas[1] END AS lon FROM model_entities""",
)
def x38(spark, d):
    k, c = F.col("pos"), F.col("coordenadas")
    given = F.when(k % 3 == 2, F.slice(c, 1, 1)).otherwise(c)
    shape = E.point(given)
    return T.model_entities(spark, d).select(
        "pos", shape["type"].alias("shape"), F.get(shape["coordinates"], F.lit(0)).alias("lon")
    )


@query(
    "j13_geometry_lookup",
    """SELECT pos, e.name, CASE WHEN geometry_type = 'Polygon' THEN geometry END AS boundary,
              coalesce(geometry_type = 'Polygon', FALSE) AS osm_polygon_found
       FROM cleaned e LEFT JOIN boundaries b ON b.name = e.name
         AND (e.pais IS NULL OR e.pais = 'No especificado' OR e.pais = 'México')""",
    CTES,
)
def j13(spark, d):
    shapes = T.boundaries(spark, d).select(
        "*", F.lit(None).cast("string").alias("estado"), F.lit("México").alias("pais")
    )
    return E.with_geometry(cleaned(spark, d), shapes, "polygon").select("pos", "name", "boundary", "osm_polygon_found")


@query(
    "a9_location_list",
    """SELECT DISTINCT file_ord, trim(name) AS location FROM model_entities
       WHERE len(string_split(name, ' ')) <= 4 AND NOT contains(lower(name), 'museo')
         AND NOT regexp_matches(name, '[0-9]')""",
)
def a9(spark, d):
    return E.location_list(T.model_entities(spark, d), "file_ord", "name")


@query(
    "u4_union_of_batches",
    """SELECT file_ord, name FROM model_entities WHERE batch < 3 UNION
       SELECT file_ord, name FROM model_entities WHERE batch >= 3""",
)
def u4(spark, d):
    found = T.model_entities(spark, d).select("file_ord", "batch", "name")
    early, late = found.filter("batch < 3"), found.filter("batch >= 3")
    return early.union(late).select("file_ord", "name").distinct()


@query(
    "x8_parsed_entities",
    """SELECT id, p_name AS name, p_type AS type, i AS place FROM model_responses,
         (SELECT CAST(unnest([0, 1]) AS INT) AS i)
       WHERE id % 6 IN (1, 3) OR (id % 6 IN (0, 2) AND i = 0)""",
)
def x8(spark, d):
    good, _ = E.parse_answers(T.model_responses(spark, d), "response", "entities")
    rows = good.select("id", F.posexplode("items").alias("place", "item"))
    return rows.select(
        "id",
        F.try_variant_get("item", "$.name", "string").alias("name"),
        F.try_variant_get("item", "$.type", "string").alias("type"),
        "place",
    )


@query(
    "x8_answers_to_places",
    "SELECT pos, name, type, context, estado, pais, coordenadas[1] AS lon FROM cleaned",
    CTES,
)
def x8_places(spark, d):
    """From answers in prose and JSON to cleaned places: parsing, types, plausibility, evidence, first wins, defaults."""
    given = ["name", "type", "context", "estado", "pais", "coordenadas"]
    listed = F.to_json(F.struct(F.array(F.struct(*given)).alias("entities")))
    answers = T.model_entities(spark, d).select(*ORDER, F.concat(F.lit("Lugares: "), listed, F.lit(" Eso es todo.")).alias("response"))
    good, _ = E.parse_answers(answers, "response", "entities")
    places = E.clean_entities(E.entity_rows(good, ORDER), ORDER, focus="Chile")
    return places.select(*KEEP, "context", "estado", "pais", F.get("coordenadas", F.lit(0)).alias("lon"))


@query("x8_quarantine", "SELECT id, response FROM model_responses WHERE id % 6 IN (4, 5)")
def x8_quarantine(spark, d):
    return E.parse_answers(T.model_responses(spark, d), "response", "entities")[1]


@query("p19_without_system", "SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'")
def p19(spark, d):
    return V.without_system(T.load(spark, d, "conversations"))


@query(
    "w7_recent_history",
    """SELECT conv_id, count(*) AS n_turns,
              string_agg(CASE WHEN role = 'user' THEN 'USUARIO: ' ELSE 'ASISTENTE: ' END || text, chr(10) ORDER BY turn)
                AS history
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations
             WHERE role <> 'system') WHERE age <= 10 GROUP BY conv_id""",
)
def w7(spark, d):
    return V.recent_history(V.without_system(T.load(spark, d, "conversations")))


@query(
    "j4_history_listing",
    """SELECT h.conv_id, h.title, h.created, c.context_id, c.title AS context_title,
              w.workspace_id, w.title AS workspace_title
       FROM (SELECT conv_id, left(max(text) FILTER (WHERE turn = 0), 255) AS title, max(turn) AS created
             FROM conversations GROUP BY conv_id) h
       LEFT JOIN (SELECT DISTINCT conv_id, (conv_id * 7 + turn) % (SELECT count(*) FROM customer) AS context_id
                  FROM conversations WHERE role = 'user') b ON b.conv_id = h.conv_id
       LEFT JOIN contexts c ON c.context_id = b.context_id
       LEFT JOIN workspaces w ON w.workspace_id = c.workspace_id""",
)
def j4(spark, d):
    turns = T.load(spark, d, "conversations")
    histories = turns.groupBy("conv_id").agg(
        F.left(F.max(F.when(F.col("turn") == 0, F.col("text"))), F.lit(V.TITLE_CHARS)).alias("title"),
        F.max("turn").alias("created"),
    )
    n = T.row_count(T.load(spark, d, "customer"))
    bridge = (
        turns.filter(F.col("role") == "user")
        .select("conv_id", ((F.col("conv_id") * 7 + F.col("turn")) % n).alias("context_id"))
        .distinct()
    )
    out = V.history_listing(histories, bridge, T.contexts(spark, d), T.workspaces(spark, d))
    c = F.col("context")
    return out.select(
        "conv_id",
        "title",
        "created",
        c["id"].alias("context_id"),
        c["title"].alias("context_title"),
        c["workspace"]["id"].alias("workspace_id"),
        c["workspace"]["title"].alias("workspace_title"),
    )


@query(
    "t5_newest_conversations",
    "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id DESC",
)
def t5(spark, d):
    last = T.load(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return last.orderBy(F.col("last_turn").desc(), F.col("conv_id").desc())
