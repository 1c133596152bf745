"""Queries over JSON records and flat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.functions import records as R
from corpus_engine.functions import text as X
from corpus_engine.operators import records as K
from corpus_engine.plans.registry import query
from corpus_engine.session import cut_lineage

DEPTH = 3
ID = ["file_id", "l_orderkey", "l_partkey", "l_linenumber"]
ID_SQL = "file_id, l_orderkey, l_partkey, l_linenumber"

# Leaves of a record in record order.
LEAF_ROWS = f"""
    SELECT {ID_SQL}, unnest(
      [{{'ord': 1, 'path': 'anio', 'key': 'anio', 'type': 'integer', 'value': anio::VARCHAR}},
       {{'ord': 2, 'path': 'estado', 'key': 'estado', 'type': 'string', 'value': estado}},
       {{'ord': 3, 'path': 'total', 'key': 'total', 'type': 'number', 'value': total::VARCHAR}},
       {{'ord': 4, 'path': 'urgente', 'key': 'urgente', 'type': 'boolean',
         'value': CASE WHEN urgente THEN 'True' ELSE 'False' END}},
       {{'ord': 5, 'path': 'cliente.nombre', 'key': 'cliente.nombre', 'type': 'string', 'value': nombre}},
       {{'ord': 6, 'path': 'cliente.segmento', 'key': 'cliente.segmento', 'type': 'string', 'value': segmento}},
       {{'ord': 7, 'path': 'partidas.0.articulo', 'key': 'partidas.array.articulo', 'type': 'string', 'value': art0}},
       {{'ord': 8, 'path': 'partidas.0.cantidad', 'key': 'partidas.array.cantidad', 'type': 'integer',
         'value': cant0::VARCHAR}},
       {{'ord': 9, 'path': 'partidas.1.articulo', 'key': 'partidas.array.articulo', 'type': 'string', 'value': art1}},
       {{'ord': 10, 'path': 'partidas.1.cantidad', 'key': 'partidas.array.cantidad', 'type': 'integer',
         'value': cant1::VARCHAR}},
       {{'ord': 13, 'path': 'nota_interna', 'key': 'nota_interna',
         'type': CASE WHEN nota IS NULL THEN 'null' ELSE 'string' END, 'value': nota}}]
      || list_transform(range(len(etiquetas)), lambda i: {{'ord': 11 + i::INT, 'path': 'etiquetas.' || i,
         'key': 'etiquetas.array', 'type': 'string', 'value': etiquetas[i + 1]}}), recursive := true)
    FROM order_lines"""

# Nodes of a record as the walk names them.
NODE_ROWS = """
    SELECT unnest(
      [{'path': 'anio', 'type': 'number', 'text': anio::VARCHAR},
       {'path': 'estado', 'type': 'string', 'text': estado},
       {'path': 'total', 'type': 'number', 'text': total::VARCHAR},
       {'path': 'urgente', 'type': 'boolean', 'text': urgente::VARCHAR},
       {'path': 'cliente', 'type': 'object', 'text': 'nombre ' || nombre || ' segmento ' || segmento},
       {'path': 'cliente.nombre', 'type': 'string', 'text': nombre},
       {'path': 'cliente.segmento', 'type': 'string', 'text': segmento},
       {'path': 'partidas', 'type': 'array',
        'text': 'articulo ' || art0 || ' cantidad ' || cant0 || ' articulo ' || art1 || ' cantidad ' || cant1},
       {'path': 'partidas', 'type': 'object', 'text': 'articulo ' || art0 || ' cantidad ' || cant0},
       {'path': 'partidas', 'type': 'object', 'text': 'articulo ' || art1 || ' cantidad ' || cant1},
       {'path': 'partidas.articulo', 'type': 'string', 'text': art0},
       {'path': 'partidas.articulo', 'type': 'string', 'text': art1},
       {'path': 'partidas.cantidad', 'type': 'number', 'text': cant0::VARCHAR},
       {'path': 'partidas.cantidad', 'type': 'number', 'text': cant1::VARCHAR},
       {'path': 'etiquetas', 'type': 'array', 'text': array_to_string(etiquetas, ' ')},
       {'path': 'nota_interna', 'type': CASE WHEN nota IS NULL THEN 'null' ELSE 'string' END,
        'text': coalesce(nota, 'null')}]
      || list_transform(etiquetas, lambda e: {'path': 'etiquetas', 'type': 'string', 'text': e}), recursive := true)
    FROM order_lines"""

LINE_CTES = {"leaf_rows": LEAF_ROWS, "node_rows": NODE_ROWS}


def sql_trigrams(expr: str) -> str:
    return (
        "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower("
        + expr
        + r"), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), "
        "lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def sql_resembles(grams: str, terms: list[str], threshold: float = 0.3) -> str:
    tests = []
    for t in terms:
        wanted = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in X.literal_trigrams(t)) + "]"
        shared = f"len(list_intersect({grams}, {wanted}))"
        tests.append(f"{shared} >= {threshold} * (len({grams}) + len({wanted}) - {shared})")
    return "(" + " OR ".join(tests) + ")"


def records(spark, d):
    docs = T.order_docs(spark, d)
    return docs.withColumn("rec", F.from_json("doc", T.ORDER_DOC_SCHEMA))


def variants(spark, d):
    docs = T.order_docs(spark, d)
    return docs.withColumn("v", F.parse_json("doc"))


@query("x1_flatten", f"SELECT {ID_SQL}, path, value FROM leaf_rows", LINE_CTES)
def x1(spark, d):
    flat = records(spark, d).select(*ID, F.inline(R.leaves(F.col("rec"), T.ORDER_DOC_SCHEMA)))
    return flat.select(*ID, "path", "value")


@query(
    "x2_keys_and_types",
    f"""SELECT {ID_SQL}, key, type FROM leaf_rows
        WHERE path NOT LIKE 'partidas.1%' AND path <> 'etiquetas.1'""",
    LINE_CTES,
)
def x2(spark, d):
    leaf = R.leaves(F.col("rec"), T.ORDER_DOC_SCHEMA)
    return records(spark, d).select(*ID, F.inline(R.keys_and_types(leaf)))


@query(
    "x3_path_navigation",
    f"""SELECT {ID_SQL}, nombre, total, anio::VARCHAR AS anio, CAST(NULL AS VARCHAR) AS falta FROM order_lines""",
)
def x3(spark, d):
    v = F.col("v")
    return variants(spark, d).select(
        *ID,
        R.at_path(v, ["cliente", "nombre"]).alias("nombre"),
        R.at_path(v, ["total"], "double").alias("total"),
        R.at_path(v, ["anio"]).alias("anio"),
        R.at_path(v, ["cliente", "nombre", "x"]).alias("falta"),
    )


@query(
    "x4_type_guard",
    f"""SELECT {ID_SQL}, TRUE AS nombre_is_string, FALSE AS total_is_string, nota IS NOT NULL AS nota_is_string
        FROM order_lines""",
)
def x4(spark, d):
    v = F.col("v")
    return variants(spark, d).select(
        *ID,
        R.is_string_at(v, ["cliente", "nombre"]).alias("nombre_is_string"),
        R.is_string_at(v, ["total"]).alias("total_is_string"),
        R.is_string_at(v, ["nota_interna"]).alias("nota_is_string"),
    )


@query(
    "x5_record_text",
    f"""SELECT {ID_SQL}, 'Anio: ' || anio || chr(10) || 'Estado: ' || estado || chr(10) || 'Total: ' || total
          || chr(10) || 'Urgente: ' || (CASE WHEN urgente THEN 'True' ELSE 'False' END)
          || chr(10) || 'Cliente.nombre: ' || nombre || chr(10) || 'Cliente.segmento: ' || segmento
          || chr(10) || 'Partidas.0.articulo: ' || art0 || chr(10) || 'Partidas.0.cantidad: ' || cant0
          || chr(10) || 'Partidas.1.articulo: ' || art1 || chr(10) || 'Partidas.1.cantidad: ' || cant1
          || array_to_string(list_transform(range(len(etiquetas)),
               lambda i: chr(10) || 'Etiquetas.' || i || ': ' || etiquetas[i + 1]), '')
          || CASE WHEN nota IS NULL THEN '' ELSE chr(10) || 'Nota interna: ' || nota END AS text
        FROM order_lines""",
)
def x5(spark, d):
    text = R.record_text(F.col("rec"), T.ORDER_DOC_SCHEMA)
    return records(spark, d).select(*ID, text.alias("text"))


@query(
    "x5_row_text",
    """SELECT c_custkey, 'C name: ' || c_name || chr(10) || 'C mktsegment: '
         || CASE WHEN c_acctbal < 0 THEN '(sin valor)' ELSE c_mktsegment END AS text FROM customer""",
)
def x5_row(spark, d):
    segment = F.when(F.col("c_acctbal") < 0, " NaN ").otherwise(F.col("c_mktsegment"))
    rows = T.load(spark, d, "customer").withColumn("c_mktsegment", segment)
    return rows.select("c_custkey", R.row_text(["c_name", "c_mktsegment"]).alias("text"))


@query(
    "x6_serialized_results",
    """SELECT report_id, array_to_string(list_filter([user_id, file_path, external_url, report_id::VARCHAR],
         lambda v: v IS NOT NULL), '|') AS row_text FROM reports""",
)
def x6(spark, d):
    values = R.serialized([F.col(c) for c in ("user_id", "file_path", "external_url", "report_id")])
    rows = T.reports(spark, d).select("report_id", values.alias("row"))
    return rows.filter(F.size("row") > 0).select("report_id", F.array_join("row", "|").alias("row_text"))


@query(
    "x7_canonical_json",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN json(props)::VARCHAR WHEN 1 THEN event_type
         ELSE '{' || event_type END AS item FROM events""",
)
def x7(spark, d):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.col("props")).when(k % 3 == 1, F.col("event_type")).otherwise(
        F.concat(F.lit("{"), "event_type")
    )
    return T.load(spark, d, "events").select("event_id", R.canonical_json(raw).alias("item"))


# Records with lists in lists, a large fraction, odd keys, and keys that differ from record to record.
MIXED_SQL = """
    SELECT event_id, unnest(list_filter([
        {'pos': 0, 'path': 'id', 'key': 'id', 'type': 'integer', 'value': event_id::VARCHAR},
        {'pos': 1, 'path': 'props.k', 'key': 'props.k', 'type': 'integer', 'value': json_extract_string(props, '$.k')},
        {'pos': 2, 'path': 'importe_total', 'key': 'importe_total', 'type': 'number', 'value': '12345678.' || (event_id % 9 + 1)},
        {'pos': 3, 'path': 'listas.0.0', 'key': 'listas.array.array', 'type': 'integer', 'value': '1'},
        {'pos': 4, 'path': 'listas.0.1', 'key': 'listas.array.array', 'type': 'number', 'value': '2.50'},
        {'pos': 5, 'path': 'listas.1.a', 'key': 'listas.array.a', 'type': 'boolean', 'value': 'True'},
        {'pos': 6, 'path': 'it''s', 'key': 'it''s', 'type': 'null', 'value': NULL},
        CASE WHEN event_id % 3 = 0 THEN {'pos': 7, 'path': 'tipo', 'key': 'tipo', 'type': 'string', 'value': event_type} END],
        lambda e: e IS NOT NULL), recursive := true) FROM events"""


def mixed_records(spark, d):
    eid = F.col("event_id")
    end = F.when(eid % 3 == 0, F.concat(F.lit(', "tipo": "'), "event_type", F.lit('"}'))).otherwise("}")
    text = F.concat(
        F.lit('{"id": '), eid.cast("string"), F.lit(', "props": '), "props", F.lit(', "importe_total": 12345678.'),
        (eid % 9 + 1).cast("string"), F.lit(', "listas": [[1, 2.50], {"a": true}], "it\'s": null'), end,
    )
    return T.load(spark, d, "events").select("event_id", R.text_leaves(text).alias("leaf"))


@query("x1_any_shape", "SELECT event_id, CAST(pos AS INT) AS pos, path, key, type, value FROM mixed", {"mixed": MIXED_SQL})
def x1_any(spark, d):
    rows = mixed_records(spark, d)
    return rows.select("event_id", F.posexplode("leaf").alias("pos", "e")).select("event_id", "pos", "e.*")


@query("x2_any_shape", "SELECT event_id, key, min_by(type, pos) AS type FROM mixed GROUP BY event_id, key", {"mixed": MIXED_SQL})
def x2_any(spark, d):
    return mixed_records(spark, d).select("event_id", F.inline(R.keys_and_types(F.col("leaf"))))


@query(
    "x5_any_shape",
    """SELECT event_id, string_agg(upper(replace(path, '_', ' ')[1]) || lower(replace(path, '_', ' ')[2:]) || ': ' || value,
                                   chr(10) ORDER BY pos) AS text
       FROM mixed WHERE value IS NOT NULL GROUP BY event_id""",
    {"mixed": MIXED_SQL},
)
def x5_any(spark, d):
    return mixed_records(spark, d).select("event_id", R.leaves_text(F.col("leaf")).alias("text"))


@query("p16_any_shape", "SELECT event_id, path, value FROM mixed WHERE value IS NOT NULL", {"mixed": MIXED_SQL})
def p16_any(spark, d):
    return mixed_records(spark, d).select("event_id", F.inline(R.clean_leaves(F.col("leaf"))))


@query(
    "x11_clean_value",
    r"""SELECT doc_id, unnest([t, '(sin valor)', '(sin valor)', '(sin valor)', '(sin valor)', CASE WHEN length(t) > 5000
               THEN t[:5000] || '...' ELSE t END]) AS value
        FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
)
def x11(spark, d):
    """Every text whole, four values that mean nothing, and the text as it is cut for display."""
    odd = [F.lit(" None\n"), F.lit(""), F.lit("DESCONOCIDO"), F.lit(None).cast("string")]
    values = F.array(X.clean_value(F.col("text")), *[X.clean_value(v) for v in odd], X.clean_value(F.col("text"), 5000))
    return T.load(spark, d, "documents").select("doc_id", F.explode(values).alias("value"))


@query(
    "x11_clean_nested",
    f"""SELECT {ID_SQL},
          CASE WHEN len(etiquetas) = 0 THEN '(sin valor)' ELSE array_to_string(etiquetas, ', ') END AS tags,
          'Nombre: ' || nombre || coalesce('; Nota interna: ' || nota, '') AS pairs FROM order_lines""",
)
def x11_nested(spark, d):
    rec = F.col("rec")
    pairs = [("nombre", rec["cliente"]["nombre"]), ("nota_interna", rec["nota_interna"])]
    return records(spark, d).select(
        *ID, X.clean_list(rec["etiquetas"]).alias("tags"), X.clean_pairs(pairs).alias("pairs")
    )


@query(
    "x12_trigram_similarity",
    f"""SELECT s_suppkey, s_name, round(i / (len(a) + len(b) - i), 6) AS similarity FROM
          (SELECT s_suppkey, s_name, {sql_trigrams("s_name")} AS a, {sql_trigrams("n_name || ' supplier'")} AS b,
                  len(list_intersect({sql_trigrams("s_name")}, {sql_trigrams("n_name || ' supplier'")})) AS i
           FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
)
def x12(spark, d):
    nation = T.load(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    pairs = T.load(spark, d, "supplier").join(nation, "s_nationkey")
    score = X.trigram_similarity(F.col("s_name"), F.concat("n_name", F.lit(" supplier")))
    return pairs.select("s_suppkey", "s_name", F.round(score, 6).alias("similarity"))


@query(
    "x16_tokens_and_md5",
    "SELECT doc_id, length(text) // 4 AS tokens, md5(text) AS text_md5 FROM documents",
)
def x16(spark, d):
    return T.load(spark, d, "documents").select(
        "doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.md5("text").alias("text_md5")
    )


@query(
    "x17_text_caps",
    """SELECT doc_id, text[:800] AS shown, text[:2000] AS sample, text[:255] AS title,
              CAST(least(length(text), 12000) AS INT) AS n_prompt, CAST(least(length(text), 30000) AS INT) AS n_model
       FROM documents""",
)
def x17(spark, d):
    t = F.col("text")
    return T.load(spark, d, "documents").select(
        "doc_id",
        X.cap(t, 800).alias("shown"),
        X.cap(t, 2000).alias("sample"),
        X.cap(t, 255).alias("title"),
        F.length(X.cap(t, 12000)).alias("n_prompt"),
        F.length(X.cap(t, 30000)).alias("n_model"),
    )


@query(
    "p16_junk_leaves",
    f"SELECT {ID_SQL}, path, value FROM leaf_rows WHERE value IS NOT NULL",
    LINE_CTES,
)
def p16(spark, d):
    leaf = R.clean_leaves(R.leaves(F.col("rec"), T.ORDER_DOC_SCHEMA))
    return records(spark, d).select(*ID, F.inline(leaf))


@query(
    "j8_object_keys",
    """SELECT event_id, unnest(json_keys(props)) AS key, 'number' AS type, json_extract_string(props, '$.k') AS value
       FROM events""",
)
def j8(spark, d):
    events = T.load(spark, d, "events").withColumn("v", F.parse_json("props"))
    return R.object_entries(events, "v", ["event_id"]).withColumn("value", F.to_json("value"))


@query(
    "j9_recursive_walk",
    """SELECT path, type, count(*) AS n, CAST(sum(length(text)) FILTER (WHERE type = 'string') AS BIGINT)
         AS chars FROM node_rows GROUP BY path, type""",
    LINE_CTES,
)
def j9(spark, d):
    nodes = R.walk(variants(spark, d), "v", [], DEPTH, whole=False, once=True)
    scalar = F.when(F.col("type") == "string", F.length("text") * F.col("times"))
    return nodes.groupBy("path", "type").agg(F.sum("times").alias("n"), F.sum(scalar).alias("chars"))


@query(
    "u2_walk_branches",
    """SELECT path, type, count(*) AS n FROM node_rows
       WHERE path LIKE 'cliente.%' OR (path = 'partidas' AND type = 'object') OR (path = 'etiquetas' AND type = 'string')
       GROUP BY path, type""",
    LINE_CTES,
)
def u2(spark, d):
    """One step of the walk: members of objects with their key, elements of lists without one."""
    top = R.object_entries(variants(spark, d), "v", [])
    path = F.col("key").alias("path")
    inner = top.select(path, F.explode(R.members(F.col("value"))).alias("name", "value"))
    objects = inner.select(F.concat("path", F.lit("."), "name").alias("path"), "value")
    lists = top.select(path, F.explode(R.elements(F.col("value"))).alias("value"))
    nodes = objects.unionByName(lists).withColumn("type", R.variant_type(F.col("value")))
    return nodes.groupBy("path", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a3_key_catalog",
    """SELECT path AS key, type, count(*) AS count FROM node_rows
       WHERE path IN ('anio', 'estado', 'total', 'urgente', 'cliente', 'nota_interna')
          OR (path IN ('partidas', 'etiquetas') AND type = 'array') GROUP BY path, type""",
    LINE_CTES,
)
def a3(spark, d):
    return K.key_catalog(variants(spark, d), "v", T.files(spark, d))


@query("a3_event_keys", "SELECT unnest(json_keys(props)) AS key, 'number' AS type, count(*) AS count FROM events GROUP BY 1")
def a3_events(spark, d):
    return K.key_catalog(T.load(spark, d, "events").withColumn("v", F.parse_json("props")), "v")


FLAT_CATALOG = f"""
    SELECT key, type, count(*) AS count
    FROM (SELECT {ID_SQL}, key, type, ord FROM leaf_rows WHERE path NOT LIKE 'partidas.1%' AND path <> 'etiquetas.1')
    GROUP BY key, type"""


def flat(spark, d):
    leaf = R.leaves(F.col("rec"), T.ORDER_DOC_SCHEMA)
    return K.flat_catalog(records(spark, d), R.keys_and_types(leaf))


@query("a3_flat_catalog", "SELECT * FROM flat_catalog", {**LINE_CTES, "flat_catalog": FLAT_CATALOG})
def a3_flat(spark, d):
    return flat(spark, d)


@query("a4_discovered_keys", "SELECT DISTINCT path, type FROM node_rows", LINE_CTES)
def a4(spark, d):
    return K.discover_keys(variants(spark, d), "v").drop("keys")


TERMS = ["household", "red widget"]
FOUND = f"""
    SELECT DISTINCT path, type FROM
      (SELECT *, {sql_trigrams("text")} AS g FROM (SELECT DISTINCT path, type, text FROM node_rows)) t
    WHERE {sql_resembles("g", TERMS)}
       OR (type = 'number' AND regexp_matches(text, '\\b1997\\b'))"""


def found(spark, d):
    return K.discover_keys(variants(spark, d), "v", terms=TERMS, years=[1997], max_depth=DEPTH)


@query("a4_filtered_keys", "SELECT * FROM found", {**LINE_CTES, "found": FOUND})
def a4_filtered(spark, d):
    return found(spark, d).drop("keys")


@query(
    "j10_key_match",
    """SELECT f.path, regexp_replace(c.key, '\\.array(\\.|$)', '[]\\1', 'g') AS key, f.type, c.count,
              c.key <> c.bare AS is_array, array_to_string(string_split(c.bare, '.'), '/') AS json_path,
              CAST(len(string_split(c.bare, '.')) - 1 AS INT) AS is_nested_depth
       FROM found f JOIN (SELECT *, regexp_replace(key, '\\.array(\\.|$)', '\\1', 'g') AS bare FROM flat_catalog) c
       ON len(string_split(f.path, '.')) = len(string_split(c.bare, '.')) AND contains(c.bare, f.path)""",
    {**LINE_CTES, "flat_catalog": FLAT_CATALOG, "found": FOUND},
)
def j10(spark, d):
    # Both inputs are as many rows as there are keys; stored, so that the records behind them are walked once.
    out = K.match_keys(cut_lineage(found(spark, d)), cut_lineage(flat(spark, d)))
    return out.withColumn("json_path", F.array_join("json_path", "/"))
