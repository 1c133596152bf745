"""Queries that search chunks by vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.functions import vectors as V
from corpus_engine.operators import nearest as N
from corpus_engine.operators import retrieval as R
from corpus_engine.plans.registry import query

FLOOR = -0.3

CTES = {
    "pairs": """
        SELECT q.qid, q.qlang, s.file_id, s.chunk_index, s.language,
               list_distance(s.embedding, q.qvec) AS distance
        FROM context_questions q JOIN context_files cf ON cf.context_id = q.qid
        JOIN chunk_store s ON s.file_id = cf.file_id""",
    "preferred": """
        SELECT * FROM (SELECT *, max(language = qlang AND qlang IN ('es', 'en', 'fr')) OVER (PARTITION BY qid) AS has
                       FROM pairs) WHERE NOT has OR language = qlang""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, file_id, chunk_index) AS rank
        FROM preferred""",
    "report_ranked": """
        SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY distance, file_id, chunk_index) AS rank FROM
          (SELECT *, max(language = qlang AND qlang IN ('es', 'en', 'fr')) OVER (PARTITION BY report_id) AS has FROM
            (SELECT q.report_id, q.qlang, s.file_id, s.chunk_index, s.language,
                    list_distance(s.embedding, q.qvec) AS distance
             FROM report_questions q JOIN report_files rf USING (report_id) JOIN chunk_store s USING (file_id)))
        WHERE NOT has OR language = qlang""",
    "items": """
        SELECT report_id, rank, file_id AS doc_id, filename AS title, file_id || '-' || chunk_index AS chunk_id, text
        FROM report_ranked JOIN files USING (file_id) JOIN chunks USING (file_id, chunk_index) WHERE rank <= 5""",
}


def scope_of(bridge, key):
    return bridge.select(F.col(key).alias("qid"), "file_id")


def context_hits(spark, d, store=None, **cuts):
    scope = scope_of(T.context_files(spark, d), "context_id")
    store = T.stored_chunks(spark, d) if store is None else store
    return R.search(T.context_questions(spark, d), scope, store, files=T.files(spark, d), **cuts)


def evidence(spark, d):
    scope = scope_of(T.report_files(spark, d), "report_id")
    store = T.stored_chunks(spark, d)
    hits = R.search(T.report_questions(spark, d), scope, store, k=5, files=T.files(spark, d))
    return R.evidence_items(hits, store, T.files(spark, d))


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 4))
    return df


@query(
    "x36_l2_distance",
    """SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS distance,
              round(1 - list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def x36(spark, d):
    emb = T.load(spark, d, "embeddings").select("vec_id", "embedding")
    other = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = emb.join(other, "vec_id")
    out = pairs.select("vec_id", V.l2_distance(F.col("embedding"), F.col("other")).alias("distance"))
    return rounded(out.withColumn("similarity", V.similarity(F.col("distance"))), "distance", "similarity")


@query(
    "x37_blank_vectors",
    "SELECT vec_id, vec_id % 10 < 3 AS blank FROM embeddings",
)
def x37(spark, d):
    k = F.col("vec_id") % 10
    v = (
        F.when(k == 0, F.array().cast("array<float>"))
        .when(k == 1, F.transform("embedding", lambda x: x * F.lit(0).cast("float")))
        .when(k > 2, F.col("embedding"))
    )
    return T.load(spark, d, "embeddings").select("vec_id", V.is_blank_vector(v).alias("blank"))


KNN_SQL = """
    SELECT qid, chunk_id, CAST(rank AS INT) AS rank, round(distance, 4) AS distance FROM
      (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS rank FROM
        (SELECT q.vec_id AS qid, c.file_id AS chunk_id,
                list_distance(c.embedding, q.embedding::DOUBLE[]) AS distance
         FROM embeddings q CROSS JOIN chunk_vectors c))
    WHERE rank <= 5"""


def knn_sides(spark, d):
    asked = T.load(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return asked, T.chunk_vectors(spark, d).withColumnRenamed("file_id", "chunk_id")


@query("j11_knn_join", KNN_SQL)
def j11(spark, d):
    return rounded(N.knn_join(*knn_sides(spark, d), k=5), "distance")


@query("j11_knn_by_cells", KNN_SQL)
def j11_cells(spark, d):
    """The same with many small cells and blocks."""
    return rounded(N.knn_join(*knn_sides(spark, d), k=5, pivots=64, block_rows=256), "distance")


@query(
    "w2_top_k_per_question",
    """SELECT qid, file_id, chunk_index, CAST(rank AS INT) AS rank, round(distance, 4) AS distance FROM
         (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, file_id, chunk_index) AS rank FROM pairs)
       WHERE rank <= 5""",
    CTES,
)
def w2(spark, d):
    questions, store = T.context_questions(spark, d), T.stored_chunks(spark, d)
    found = R.scored(questions, scope_of(T.context_files(spark, d), "context_id"), store)
    hits = R.top_k(found, 5)
    return rounded(hits.select("qid", "file_id", "chunk_index", "rank", "distance"), "distance")


@query(
    "w3_top_per_document",
    """SELECT qid, file_id, chunk_index, CAST(place AS INT) AS place FROM
         (SELECT *, row_number() OVER (PARTITION BY qid, file_id ORDER BY distance, chunk_index) AS place FROM pairs)
       WHERE place <= 3""",
    CTES,
)
def w3(spark, d):
    questions, store = T.context_questions(spark, d), T.stored_chunks(spark, d)
    found = R.scored(questions, scope_of(T.context_files(spark, d), "context_id"), store)
    hits = R.top_k(found, 3, ["qid", "file_id"], "place")
    return hits.select("qid", "file_id", "chunk_index", "place")


@query(
    "w6_language_preference",
    "SELECT qid, qlang, file_id, chunk_index, language FROM preferred",
    CTES,
)
def w6(spark, d):
    scope = scope_of(T.context_files(spark, d), "context_id")
    store = T.stored_chunks(spark, d).select("file_id", "chunk_index", "language")
    questions = T.context_questions(spark, d).select("qid", "qlang")
    return R.in_scope(questions, R.with_preference(questions, scope, T.files(spark, d)), store)


QUESTION = [0.125] * 64


@query(
    "t1_nearest_chunks",
    """SELECT file_id, chunk_index, round(distance, 4) AS distance FROM
         (SELECT file_id, chunk_index,
                 list_distance(embedding, list_transform(range(64), lambda i: 0.125::DOUBLE)) AS distance
          FROM chunk_store) ORDER BY distance, file_id, chunk_index LIMIT 50""",
)
def t1(spark, d):
    out = R.global_top_k(T.chunk_store(spark, d), QUESTION, 50, ["file_id", "chunk_index"])
    return out.select("file_id", "chunk_index", F.round("distance", 4).alias("distance"))


@query(
    "t2_two_stage_cut",
    f"""SELECT qid, file_id, chunk_index, CAST(rank AS INT) AS rank, round(1 - distance, 4) AS similarity
        FROM ranked WHERE rank <= 20 AND 1 - distance > {FLOOR}""",
    CTES,
)
def t2(spark, d):
    hits = context_hits(spark, d, k=50, min_similarity=FLOOR, keep=20)
    return rounded(hits.select("qid", "file_id", "chunk_index", "rank", "similarity"), "similarity")


@query(
    "p10_similarity_floor",
    """SELECT qid, file_id, chunk_index, round(1 - distance, 4) AS similarity FROM pairs WHERE 1 - distance > 0.3""",
    CTES,
)
def p10(spark, d):
    questions, store = T.context_questions(spark, d), T.stored_chunks(spark, d)
    found = R.scored(questions, scope_of(T.context_files(spark, d), "context_id"), store)
    hits = found.withColumn("similarity", V.similarity(F.col("distance")))
    hits = hits.filter(F.col("similarity") > 0.3)
    return rounded(hits.select("qid", "file_id", "chunk_index", "similarity"), "similarity")


CONTEXT_SQL = """
    SELECT qid, string_agg('**' || filename || '**:' || chr(10) || lines || chr(10), chr(10) ORDER BY first_rank)
             AS context, count(*) AS n_docs FROM
      (SELECT qid, file_id, filename, string_agg('- ' || text[:800], chr(10) ORDER BY place) AS lines,
              min(rank) AS first_rank FROM
        (SELECT *, row_number() OVER (PARTITION BY qid, file_id ORDER BY rank) AS place FROM ranked WHERE rank <= 20)
       JOIN files USING (file_id) JOIN chunks USING (file_id, chunk_index)
       WHERE place <= 3 GROUP BY qid, file_id, filename)
    GROUP BY qid"""


@query("a10_context_block", CONTEXT_SQL, CTES)
def a10(spark, d):
    store = T.stored_chunks(spark, d)
    return R.context_block(context_hits(spark, d, store, k=30), store, T.files(spark, d))


@query(
    "a12_evidence_list",
    """SELECT report_id, count(*) AS n_items, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids,
              string_agg(title, ',' ORDER BY rank) AS titles, CAST(sum(length(text)) AS BIGINT) AS n_chars
       FROM items GROUP BY report_id""",
    CTES,
)
def a12(spark, d):
    out = R.evidence_list(evidence(spark, d))
    chars = F.aggregate("evidence", F.lit(0).cast("long"), lambda s, e: s + F.length(e["text"]))
    return out.select(
        "report_id",
        F.size("evidence").cast("long").alias("n_items"),
        F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",").alias("chunk_ids"),
        F.array_join(F.transform("evidence", lambda e: e["title"]), ",").alias("titles"),
        chars.alias("n_chars"),
    )


@query(
    "a11_source_list",
    """SELECT r.report_id, coalesce(title, 'Sin fuentes') AS name,
              coalesce('file_id=' || doc_id || ', chunk_id=' || chunk_id, 'No se recuperó evidencia') AS detail,
              CAST(coalesce(rank, 1) AS INT) AS ord
       FROM reports r LEFT JOIN
         (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, doc_id, title ORDER BY rank) AS n
                         FROM items) WHERE n = 1) i ON i.report_id = r.report_id""",
    CTES,
)
def a11(spark, d):
    return R.source_list(T.reports(spark, d), evidence(spark, d))
