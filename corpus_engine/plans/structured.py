"""Queries that search JSON records by type, range, quantity and likeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.functions import text as X
from corpus_engine.functions.questions import search_terms
from corpus_engine.functions.text import bind
from corpus_engine.operators import catalog as C
from corpus_engine.operators import likeness
from corpus_engine.operators import question_search as Q
from corpus_engine.operators import structured as S
from corpus_engine.plans.records import DEPTH, ID, ID_SQL, sql_resembles, sql_trigrams, variants
from corpus_engine.plans.registry import query
from corpus_engine.plans.retrieval import CTES as SEARCH_CTES
from corpus_engine.operators import retrieval as R
from corpus_engine.plans.retrieval import context_hits

# Keys of the order records as the key match reports them.
KEYS = [
    {"key": "anio", "type": "number"},
    {"key": "total", "type": "number"},
    {"key": "estado", "type": "string"},
    {"key": "cliente.nombre", "type": "string"},
    {"key": "cliente.segmento", "type": "string"},
    {"key": "partidas[].articulo", "type": "string"},
    {"key": "partidas[].cantidad", "type": "number"},
    {"key": "etiquetas[]", "type": "string"},
]
TERMS = ["red widget", "household"]
SEARCH = {
    "search_terms": TERMS,
    "has_terms": True,
    "has_range": True,
    "range": {"type": "year", "from": 1996, "to": 1998},
    "has_quantity": True,
    "quantity_filter": {"operator": ">", "value": 400000, "semantic_hint": None},
}


def sql_like(expr: str, terms: list[str] = TERMS) -> str:
    return f"(SELECT {sql_resembles('g', terms)} FROM (SELECT {sql_trigrams(expr)} AS g))"


# Likeness of every distinct text once; few texts, many records.
LIKE_CTES = {
    "like_texts": f"""
        SELECT DISTINCT t FROM (SELECT DISTINCT unnest([nombre, segmento, art0, art1, estado] || etiquetas) AS t
                                FROM order_lines) WHERE {sql_like("t")}""",
}
LIKE_ANY = "list_has_any([nombre, segmento, art0, art1, estado] || etiquetas, (SELECT list(t) FROM like_texts))"


def matching(spark, d):
    return S.filter_records(variants(spark, d), "v", SEARCH, KEYS)


@query(
    "p11_year_range",
    f"SELECT {ID_SQL}, anio FROM order_lines WHERE anio BETWEEN 1996 AND 1998",
)
def p11(spark, d):
    rows = S.where(variants(spark, d), "v", lambda v: S.some_leaf(v, "anio", S.in_year_range(1996, 1998)))
    return rows.select(*ID, F.variant_get("v", "$.anio", "int").alias("anio"))


@query(
    "p12_explicit_years",
    f"""SELECT {ID_SQL}, anio FROM order_lines
        WHERE anio IN (1996, 2000) OR regexp_matches(total::VARCHAR, '\\b(1996|2000)\\b')
           OR cant0 IN (1996, 2000) OR cant1 IN (1996, 2000)""",
)
def p12(spark, d):
    rows = S.filter_records(variants(spark, d), "v", {"years": [1996, 2000]}, KEYS)
    return rows.select(*ID, F.variant_get("v", "$.anio", "int").alias("anio"))


@query(
    "p13_quantity",
    f"SELECT {ID_SQL}, total >= 450000 AS big, cant0 = 7 OR cant1 = 7 AS seven FROM order_lines "
    "WHERE total >= 450000 OR cant0 = 7 OR cant1 = 7",
)
def p13(spark, d):
    def big(v):
        return S.some_leaf(v, "total", S.compares(">=", 450000))

    def seven(v):
        return S.some_leaf(v, "partidas[].cantidad", S.compares("=", 7))

    # A generator's output is computed once for the filter and the columns.
    tested = F.array(bind(F.col("v"), lambda v: F.struct(big(v).alias("big"), seven(v).alias("seven"))))
    return variants(spark, d).select(*ID, F.inline(tested)).filter(F.col("big") | F.col("seven"))


@query(
    "p14_fuzzy_terms",
    f"SELECT {ID_SQL} FROM order_lines WHERE {LIKE_ANY}",
    LIKE_CTES,
)
def p14(spark, d):
    search = {"has_terms": True, "search_terms": TERMS}
    return S.filter_records(variants(spark, d), "v", search, KEYS).select(*ID)


@query(
    "p14_fuzzy_documents",
    f"SELECT item_id, {sql_like('text', ['there', 'that the'])} AS alike FROM benchmark",
)
def p14_documents(spark, d):
    alike = X.resembles_any(F.col("text"), ["there", "that the"])
    return T.load(spark, d, "benchmark").select("item_id", alike.alias("alike"))


@query(
    "p15_combined_search",
    f"""SELECT {ID_SQL} FROM order_lines
        WHERE (anio BETWEEN 1996 AND 1998 OR cant0 BETWEEN 1996 AND 1998)
          AND (total > 400000 OR anio > 400000 OR cant0 > 400000 OR cant1 > 400000) AND {LIKE_ANY}""",
    LIKE_CTES,
)
def p15(spark, d):
    return matching(spark, d).select(*ID)


@query(
    "j7_array_exists",
    f"""SELECT {ID_SQL} FROM order_lines WHERE art0 IN (SELECT t FROM like_texts) OR art1 IN (SELECT t FROM like_texts)""",
    LIKE_CTES,
)
def j7(spark, d):
    rows = S.where(variants(spark, d), "v", lambda v: S.some_leaf(v, "partidas[].articulo", S.resembles(TERMS)))
    return rows.select(*ID)


@query(
    "t4_fallback_sample",
    f"""SELECT {ID_SQL}, nombre FROM order_lines WHERE file_id IN (SELECT file_id FROM files WHERE ext = 'json')
        ORDER BY file_id, l_orderkey, l_partkey, l_linenumber, total, nombre, cant0, nota, etiquetas::VARCHAR LIMIT 20""",
)
def t4(spark, d):
    files = T.files(spark, d).filter(C.is_structured()).select("file_id")
    rows = variants(spark, d).join(files, "file_id", "left_semi")
    out = S.fallback_sample(rows, [*ID, "doc"])
    return out.select(*ID, F.variant_get("v", "$.cliente.nombre", "string").alias("nombre"))


@query(
    "t6_result_preview",
    f"""SELECT s_suppkey AS file_id, coalesce(n_rows, 0) AS n_rows,
               coalesce(preview, 'No se encontraron datos estructurados para esta consulta.') AS preview
        FROM supplier LEFT JOIN
          (SELECT file_id, max(n) AS n_rows,
                  string_agg('--- REGISTRO ' || place || ' ---' || chr(10) || '["' || nombre || '",' || l_orderkey || ']'
                             || chr(10), chr(10) ORDER BY place) FILTER (WHERE place <= 15) AS preview
           FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey, l_partkey, l_linenumber) AS place,
                        count(*) OVER (PARTITION BY file_id) AS n
                 FROM order_lines WHERE anio = 1997 AND total > 490000) GROUP BY file_id)
        ON file_id = s_suppkey""",
)
def t6(spark, d):
    search = {
        "has_range": True,
        "range": {"from": 1997, "to": 1997},
        "has_quantity": True,
        "quantity_filter": {"operator": ">", "value": 490000},
    }
    rows = S.filter_records(variants(spark, d), "v", search, [k for k in KEYS if k["key"] in ("anio", "total")])
    name = F.variant_get("v", "$.cliente.nombre", "string")
    line = F.concat(F.lit('[ "'), name, F.lit('", '), F.col("l_orderkey").cast("string"), F.lit(" ]"))
    previews = S.preview(rows.withColumn("line", line), "file_id", ["l_orderkey", "l_partkey", "l_linenumber"], "line")
    suppliers = T.load(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"))
    return S.preview_or_notice(suppliers, previews, "file_id")


@query(
    "x26_question_terms",
    """SELECT qid, array_to_string(CASE shape WHEN 3 THEN [s || ' popular'] WHEN 4 THEN [s] WHEN 5 THEN [s]
                                   WHEN 6 THEN [s] ELSE [] END, '|') AS terms,
              CASE WHEN shape = 4 THEN y::VARCHAR ELSE '' END AS years,
              CAST(CASE WHEN shape IN (0, 5) THEN y END AS INT) AS year_from,
              CAST(CASE shape WHEN 0 THEN y + 2 WHEN 5 THEN y + 1 END AS INT) AS year_to,
              CASE shape WHEN 1 THEN '>' WHEN 6 THEN '<' END AS operator,
              CAST(CASE WHEN shape IN (1, 6) THEN price END AS DOUBLE) AS value,
              shape NOT IN (2, 7) AS has_request_action, shape NOT IN (2, 7) AS should_search
       FROM questions""",
)
def x26(spark, d):
    s = F.col("search")
    return search_terms(T.questions(spark, d), "text").select(
        "qid",
        F.array_join(s["search_terms"], "|").alias("terms"),
        F.array_join(s["years"], "|").alias("years"),
        s["range"]["from"].alias("year_from"),
        s["range"]["to"].alias("year_to"),
        s["quantity_filter"]["operator"].alias("operator"),
        s["quantity_filter"]["value"].alias("value"),
        s["has_request_action"].alias("has_request_action"),
        s["should_search"].alias("should_search"),
    )


HYBRID_CTES = {
    **SEARCH_CTES,
    **LIKE_CTES,
    "json_hits": f"""
        SELECT context_id AS qid, o.file_id, l_orderkey || '-' || l_linenumber AS item
        FROM context_files cf JOIN files f USING (file_id) JOIN order_lines o ON o.file_id = cf.file_id
        WHERE ext = 'json' AND anio BETWEEN 1996 AND 1998 AND total > 400000 AND {LIKE_ANY}""",
    "text_hits": """
        SELECT qid, file_id, chunk_index::VARCHAR AS item FROM ranked JOIN files USING (file_id)
        WHERE rank <= 20 AND 1 - distance > -0.35""",
}


def both_searches(spark, d):
    files = T.files(spark, d)
    structured = files.filter(C.is_structured()).select("file_id")
    scope = T.context_files(spark, d).withColumnRenamed("context_id", "qid")
    item = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    found = matching(spark, d).join(structured, "file_id", "left_semi").select("file_id", item.alias("item"))
    json_hits = scope.join(found, "file_id")
    text_hits = context_hits(spark, d, k=30, min_similarity=-0.35).select(
        "qid", "file_id", F.col("chunk_index").cast("string").alias("item")
    )
    questions = T.contexts(spark, d).withColumnRenamed("context_id", "qid")
    return S.hybrid(questions, json_hits, text_hits)


@query(
    "u5_hybrid_hits",
    """SELECT qid, file_id, item, 'json' AS source FROM json_hits
       UNION ALL SELECT qid, file_id, item, 'text' FROM text_hits""",
    HYBRID_CTES,
)
def u5(spark, d):
    return both_searches(spark, d)[0]


@query(
    "u5_answer_modes",
    """SELECT c.context_id AS qid, coalesce(j, 0) AS n_json, coalesce(t, 0) AS n_text,
              CASE WHEN j > 0 AND t > 0 THEN 'hybrid' WHEN j > 0 THEN 'json_only' WHEN t > 0 THEN 'rag'
                   ELSE 'none' END AS mode
       FROM contexts c LEFT JOIN (SELECT qid, count(*) AS j FROM json_hits GROUP BY qid) a ON a.qid = c.context_id
       LEFT JOIN (SELECT qid, count(*) AS t FROM text_hits GROUP BY qid) b ON b.qid = c.context_id""",
    HYBRID_CTES,
)
def u5_modes(spark, d):
    return both_searches(spark, d)[1]


# Every question of an order is asked in the JSON files of its customer's context.
ITEM_SQL = "l_orderkey || '-' || l_partkey || '-' || l_linenumber"
ALIKE = f"""
    SELECT term, text, i / (len(a) + len(b) - i) AS similarity FROM
      (SELECT term, text, a, b, len(list_intersect(a, b)) AS i FROM
        (SELECT DISTINCT term, {sql_trigrams("term")} AS a FROM question_terms) CROSS JOIN
        (SELECT DISTINCT text, {sql_trigrams("text")} AS b FROM leaf_values WHERE text IS NOT NULL))
    WHERE i >= 0.3 * (len(a) + len(b) - i) AND i > 0"""
QUESTION_CTES = {
    "asked": """
        SELECT qid, shape IN (3, 4, 5, 6) AS has_terms, shape = 4 AS has_years, shape IN (0, 5) AS has_range,
               shape IN (1, 6) AS has_quantity, y AS low, CASE shape WHEN 0 THEN y + 2 ELSE y + 1 END AS high,
               shape = 1 AS above, price,
               (shape IN (3, 4, 5, 6))::INT + (shape = 4)::INT + (shape IN (0, 5))::INT + (shape IN (1, 6))::INT AS blocks
        FROM questions WHERE shape NOT IN (2, 7)""",
    "question_terms": "SELECT qid, CASE shape WHEN 3 THEN s || ' popular' ELSE s END AS term FROM questions WHERE shape IN (3, 4, 5, 6)",
    "question_scope": """
        SELECT DISTINCT o_orderkey AS qid, cf.file_id FROM orders JOIN context_files cf ON cf.context_id = o_custkey
        JOIN files f ON f.file_id = cf.file_id WHERE ext = 'json'""",
    "line_leaves": f"""
        SELECT * FROM (SELECT file_id, {ITEM_SQL} AS item, unnest(
          [{{'path': 'anio', 'type': 'number', 'text': anio::VARCHAR}}, {{'path': 'estado', 'type': 'string', 'text': estado}},
           {{'path': 'total', 'type': 'number', 'text': total::VARCHAR}},
           {{'path': 'urgente', 'type': 'boolean', 'text': urgente::VARCHAR}},
           {{'path': 'cliente.nombre', 'type': 'string', 'text': nombre}},
           {{'path': 'cliente.segmento', 'type': 'string', 'text': segmento}},
           {{'path': 'partidas.articulo', 'type': 'string', 'text': art0}},
           {{'path': 'partidas.cantidad', 'type': 'number', 'text': cant0::VARCHAR}},
           {{'path': 'partidas.articulo', 'type': 'string', 'text': art1}},
           {{'path': 'partidas.cantidad', 'type': 'number', 'text': cant1::VARCHAR}},
           {{'path': 'nota_interna', 'type': 'string', 'text': nota}}]
          || list_transform(etiquetas, lambda e: {{'path': 'etiquetas', 'type': 'string', 'text': e}}), recursive := true)
        FROM order_lines WHERE file_id IN (SELECT file_id FROM question_scope)) WHERE text IS NOT NULL""",
    "leaf_values": "SELECT DISTINCT file_id, path, type, text FROM line_leaves",
    "alike": ALIKE,
    "found_keys": """
        SELECT DISTINCT qid, path, type FROM (
          SELECT t.qid, v.path, v.type FROM question_terms t JOIN alike a ON a.term = t.term
            JOIN question_scope s ON s.qid = t.qid JOIN leaf_values v ON v.file_id = s.file_id AND v.text = a.text
          UNION ALL
          SELECT q.qid, v.path, v.type FROM asked q JOIN question_scope s ON s.qid = q.qid JOIN leaf_values v ON v.file_id = s.file_id
          WHERE v.type = 'number' AND (has_quantity OR (has_range AND regexp_matches(text, '\\b[0-9]{4}\\b'))
                                       OR (has_years AND regexp_matches(text, '\\b' || low || '\\b'))))""",
    "used_keys": """
        SELECT DISTINCT f.qid, c.key, f.type FROM found_keys f
        JOIN (SELECT DISTINCT qid, path AS key FROM question_scope JOIN (SELECT DISTINCT file_id, path FROM leaf_values) USING (file_id)) c
          ON c.qid = f.qid AND len(string_split(c.key, '.')) = len(string_split(f.path, '.')) AND contains(c.key, f.path)""",
    "question_met": """
        SELECT k.qid, l.file_id, l.item, 1 AS block, a.similarity AS score
        FROM used_keys k JOIN question_terms t ON t.qid = k.qid JOIN alike a ON a.term = t.term JOIN question_scope s ON s.qid = k.qid
        JOIN line_leaves l ON l.file_id = s.file_id AND l.path = k.key AND l.text = a.text AND l.type = 'string' WHERE k.type = 'string'
        UNION ALL
        SELECT k.qid, l.file_id, l.item, 2, 0 FROM used_keys k JOIN asked q ON q.qid = k.qid JOIN question_scope s ON s.qid = k.qid
        JOIN line_leaves l ON l.file_id = s.file_id AND l.path = k.key
        WHERE has_quantity AND k.type = 'number' AND l.type = 'number' AND CASE WHEN above THEN text::DOUBLE > price ELSE text::DOUBLE < price END
        UNION ALL
        SELECT k.qid, l.file_id, l.item, 3, 0 FROM used_keys k JOIN asked q ON q.qid = k.qid JOIN question_scope s ON s.qid = k.qid
        JOIN line_leaves l ON l.file_id = s.file_id AND l.path = k.key
        WHERE has_years AND k.type = 'number' AND l.type = 'number' AND regexp_matches(text, '\\b' || low || '\\b')
        UNION ALL
        SELECT k.qid, l.file_id, l.item, 4, 0 FROM used_keys k JOIN asked q ON q.qid = k.qid JOIN question_scope s ON s.qid = k.qid
        JOIN line_leaves l ON l.file_id = s.file_id AND l.path = k.key
        WHERE has_range AND k.type IN ('number', 'string') AND regexp_full_match(text, '[0-9]{4}') AND try_cast(text AS INT) BETWEEN low AND high""",
    "question_found": """
        SELECT m.qid, 'search' AS mode, file_id, item, max(score) AS score FROM question_met m JOIN asked q ON q.qid = m.qid
        GROUP BY m.qid, file_id, item, blocks HAVING count(DISTINCT block) = blocks
        UNION ALL
        SELECT qid, 'fallback', file_id, item, 0 FROM
          (SELECT qid, file_id, item, row_number() OVER (PARTITION BY qid ORDER BY file_id, item) AS n FROM asked JOIN question_scope USING (qid)
           JOIN (SELECT DISTINCT file_id, item FROM line_leaves) USING (file_id) WHERE qid NOT IN (SELECT qid FROM used_keys)) WHERE n <= 20""",
    "question_best": """
        SELECT qid, mode, count(*) OVER (PARTITION BY qid) AS n_rows, file_id, item, score,
               row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_id, item) AS rank FROM question_found""",
}


def question_scope(spark, d):
    files = T.files(spark, d).filter(C.is_structured()).select("file_id")
    asked = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("context_id"))
    return asked.join(T.context_files(spark, d), "context_id").join(files, "file_id", "left_semi").select("qid", "file_id")


def question_records(spark, d):
    item = F.concat_ws("-", *[F.col(c).cast("string") for c in ID[1:]])
    return variants(spark, d).withColumn("item", item)


def question_hits(spark, d):
    questions = search_terms(T.questions(spark, d), "text").select("qid", "search")
    scope = question_scope(spark, d)
    # Only files that some question may read are walked into leaves and stored.
    rows = question_records(spark, d).join(scope.select("file_id").distinct(), "file_id", "left_semi")
    leaves = Q.leaf_rows(rows, "v", "file_id", "item", max_depth=DEPTH)
    return Q.search_records(questions, scope, leaves)


@query(
    "p15_question_search",
    "SELECT qid, mode, n_rows, file_id, item, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM question_best WHERE rank <= 20",
    QUESTION_CTES,
)
def p15_questions(spark, d):
    return question_hits(spark, d).withColumn("score", F.round("score", 6))


@query(
    "t6_question_preview",
    """SELECT o_orderkey AS qid, coalesce(max(n_rows), 0) AS n_rows,
              coalesce(string_agg('--- REGISTRO ' || rank || ' ---' || chr(10) || '["' || item || '"]' || chr(10), chr(10) ORDER BY rank)
                       FILTER (WHERE rank <= 15), 'No se encontraron datos estructurados para esta consulta.') AS preview
       FROM orders LEFT JOIN question_best ON qid = o_orderkey GROUP BY o_orderkey""",
    QUESTION_CTES,
)
def t6_questions(spark, d):
    line = F.concat(F.lit('["'), F.col("item"), F.lit('"]'))
    shown = S.numbered(question_hits(spark, d).withColumn("line", line), "qid", "rank", "line")
    return S.preview_or_notice(T.load(spark, d, "orders").select(F.col("o_orderkey").alias("qid")), shown, "qid")


@query(
    "u5_question_modes",
    """SELECT o_orderkey AS qid, coalesce(j, 0) AS n_json, coalesce(t, 0) AS n_text,
              CASE WHEN j > 0 AND t > 0 THEN 'hybrid' WHEN j > 0 THEN 'json_only' WHEN t > 0 THEN 'rag' ELSE 'none' END AS mode
       FROM orders LEFT JOIN (SELECT qid, least(max(n_rows), 20) AS j FROM question_best GROUP BY qid) a ON a.qid = o_orderkey
       LEFT JOIN (SELECT report_id AS qid, count(*) AS t FROM report_ranked WHERE rank <= 5 GROUP BY ALL) b ON b.qid = o_orderkey""",
    {**SEARCH_CTES, **QUESTION_CTES},
)
def u5_question_modes(spark, d):
    """Both searches for every question: its own conditions in JSON files, its vector in the files of its report."""
    structured = question_hits(spark, d)
    scope = T.report_files(spark, d).withColumnRenamed("report_id", "qid")
    text = R.search(T.report_questions(spark, d), scope, T.stored_chunks(spark, d), k=5, files=T.files(spark, d))
    text = text.select("qid", "file_id", F.col("chunk_index").cast("string").alias("item"))
    return S.hybrid(T.load(spark, d, "orders").select(F.col("o_orderkey").alias("qid")), structured, text)[1]


@query(
    "p14_term_table",
    f"""SELECT term, text, round(similarity, 6) AS similarity FROM
          (SELECT term, text, i / (len(a) + len(b) - i) AS similarity FROM
            (SELECT term, text, len(list_intersect(a, b)) AS i, a, b FROM
              (SELECT DISTINCT p_type AS term, {sql_trigrams("p_type")} AS a FROM part) CROSS JOIN
              (SELECT DISTINCT p_name AS text, {sql_trigrams("p_name")} AS b FROM part
               UNION SELECT DISTINCT p_brand, {sql_trigrams("p_brand")} FROM part
               UNION SELECT DISTINCT p_type, {sql_trigrams("p_type")} FROM part)))
        WHERE similarity >= 0.3""",
)
def p14_terms(spark, d):
    part = T.load(spark, d, "part")
    texts = part.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("text"))
    out = likeness.similar_texts(texts, part.select(F.col("p_type").alias("term")))
    return out.withColumn("similarity", F.round("similarity", 6))
