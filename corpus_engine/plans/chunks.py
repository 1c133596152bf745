"""Queries over chunks, their language and their batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.functions import chunking as H
from corpus_engine.functions import language as L
from corpus_engine.operators import chunks as K
from corpus_engine.plans.registry import query


def texts(spark, d):
    docs = T.load_spread(spark, d, "documents", ["doc_id", "text"])
    return docs.select(F.col("doc_id").alias("file_id"), "text")


def sql_language(text: str, sample: str = "[:2000]") -> str:
    """Language guess of an SQL text expression."""
    tokens = f"string_split_regex(trim(regexp_replace(lower(({text}){sample}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')), '\\s+')"
    lists = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in L.FUNCTION_WORDS.items()}
    score = {k: f"len(list_filter(toks, lambda t: list_contains({v}, t)))" for k, v in lists.items()}
    best = f"greatest({', '.join(score.values())})"
    cases = " ".join(f"WHEN {s} = {best} THEN '{k}'" for k, s in score.items())
    plain = f"trim(regexp_replace(({text}){sample}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'))"
    return (
        f"(SELECT CASE WHEN length({plain}) < 10 OR {best} = 0 THEN 'es' {cases} END "
        f"FROM (SELECT {tokens} AS toks))"
    )


@query("x13_fixed_windows", "SELECT file_id, chunk_index, text, n_chars FROM chunks")
def x13(spark, d):
    return H.fixed_windows(texts(spark, d), "text", ["file_id"])


@query("x13_separator_chunks")
def x13_separators(spark, d):
    pieces = H.separator_chunks(F.col("text"), F.lit(1000), F.lit(200), H.PLAIN_SEPARATORS)
    return texts(spark, d).select("file_id", F.posexplode(pieces).alias("chunk_index", "text"))


SIZE_SQL = """
    SELECT doc_id AS file_id, lang AS language, CAST(s AS INT) AS size,
           CAST(CASE WHEN n < 1000 THEN least(50, s // 4) WHEN n < 5000 THEN 50
                     WHEN n < 20000 THEN greatest(50, s // 8) ELSE greatest(100, s // 6) END AS INT) AS overlap
    FROM (SELECT *, CASE WHEN n < 1000 THEN greatest(mn, n // 2) WHEN n < 5000 THEN base
                         WHEN n < 20000 THEN least(mx, base + 100) ELSE mx END AS s
          FROM (SELECT doc_id, lang, length(text) AS n,
                  CASE lang WHEN 'en' THEN 600 WHEN 'fr' THEN 480 ELSE 512 END AS base,
                  CASE lang WHEN 'en' THEN 250 WHEN 'fr' THEN 180 ELSE 200 END AS mn,
                  CASE lang WHEN 'en' THEN 900 WHEN 'fr' THEN 750 ELSE 800 END AS mx FROM documents))"""


@query(
    "x14_adaptive_sizes",
    """SELECT file_id, size, overlap, CAST(n // (size - overlap) + 1 AS BIGINT) AS estimated
       FROM sizes JOIN (SELECT doc_id AS file_id, length(text) AS n FROM documents) USING (file_id)""",
    {"sizes": SIZE_SQL},
)
def x14_sizes(spark, d):
    size, overlap = H.adaptive_size(F.length("text"), F.col("lang"))
    docs = T.load(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), size.alias("size"), overlap.alias("overlap"), F.length("text").alias("n")
    )
    return docs.select(
        "file_id", "size", "overlap", (F.floor(F.col("n") / (F.col("size") - F.col("overlap"))) + 1).alias("estimated")
    )


@query("x14_adaptive_chunks")
def x14(spark, d):
    docs = T.load_spread(spark, d, "documents", ["doc_id", "text", "lang"]).withColumnRenamed("doc_id", "file_id")
    return H.adaptive_chunks(docs, "text", "lang", ["file_id"])


@query("x14_sentence_split")
def x14_sentences(spark, d):
    cut = H.sentence_chunks(F.col("text"), F.lit(500))
    return texts(spark, d).select("file_id", F.posexplode(cut).alias("chunk_index", "text"))


def coverage(chunks, most):
    """Of each file: whether all chunks fit, and a digest of what they hold, white space aside."""
    joined = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY chunk_index)")
    held = F.md5(F.regexp_replace(joined, r"\s", ""))
    return chunks.groupBy("file_id").agg(F.bool_and(F.length("text") <= most).alias("fits"), held.alias("content"))


COVERAGE_SQL = r"""SELECT doc_id AS file_id, true AS fits, md5(regexp_replace(text, '\s', '', 'g')) AS content
                   FROM documents WHERE regexp_matches(text, '\S')"""


@query("x13_separator_coverage", COVERAGE_SQL)
def x13_coverage(spark, d):
    """Without overlap the chunks are the text, nothing lost and nothing twice."""
    pieces = H.separator_chunks(F.col("text"), F.lit(1000), F.lit(0), H.PLAIN_SEPARATORS)
    return coverage(texts(spark, d).select("file_id", F.posexplode(pieces).alias("chunk_index", "text")), 1000)


@query("x14_adaptive_coverage", COVERAGE_SQL)
def x14_coverage(spark, d):
    docs = T.load_spread(spark, d, "documents", ["doc_id", "text", "lang"]).withColumnRenamed("doc_id", "file_id")
    return coverage(H.adaptive_chunks(docs, "text", "lang", ["file_id"], overlap=0), F.col("size") + 1)


@query("x14_sentence_coverage", COVERAGE_SQL)
def x14_sentence_coverage(spark, d):
    cut = H.sentence_chunks(F.col("text"), F.lit(500))
    rows = texts(spark, d).select("file_id", F.posexplode(cut).alias("chunk_index", "text"))
    # A sentence longer than the size stays whole; a chunk of several sentences fits.
    several = F.size(F.regexp_extract_all("text", F.lit(r"[.!?]\s"), F.lit(0))) > 0
    return coverage(rows, F.when(several, 750).otherwise(F.length("text")))


@query("x15_language_guess", f"SELECT doc_id, {sql_language('text', '')} AS language FROM documents")
def x15(spark, d):
    docs = T.load_spread(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", L.guess_language(F.col("text")).alias("language"))


@query("x15_language_whole_text", f"SELECT doc_id, {sql_language('text', '')} AS language FROM documents")
def x15_whole(spark, d):
    docs = T.load_spread(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", L.guess_language(F.col("text"), None).alias("language"))


@query(
    "a13_language_vote",
    f"""SELECT file_id, chunk_index, language FROM (SELECT file_id, chunk_index FROM chunks) JOIN
          (SELECT doc_id AS file_id, {sql_language('text', '')} AS language FROM documents) USING (file_id)""",
)
def a13(spark, d):
    return K.chunk_files(texts(spark, d)).select("file_id", "chunk_index", "language")


@query(
    "w1_chunk_ordinal",
    """SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS INT) AS chunk_index, n_chars
       FROM (SELECT file_id, chunk_index AS pos, n_chars FROM chunks)""",
)
def w1(spark, d):
    return T.chunks(spark, d).select("file_id", "chunk_index", "n_chars")


@query(
    "w4_batch_of_five",
    """SELECT file_id, chunk_index, CAST((row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) - 1) // 5
         AS INT) AS batch FROM chunks""",
)
def w4(spark, d):
    return T.chunks(spark, d).select("file_id", "chunk_index", K.batch_id(F.col("chunk_index")).alias("batch"))


@query("t3_chunk_order", "SELECT file_id, chunk_index, md5(text) AS text_md5 FROM chunks ORDER BY file_id, chunk_index")
def t3(spark, d):
    """Every file's chunks in order; the order holds within a file, so files need no order among each other."""
    placed = T.chunks(spark, d).select("file_id", "chunk_index", F.md5("text").alias("text_md5"))
    return placed.repartition("file_id").sortWithinPartitions("file_id", "chunk_index")


@query(
    "a6_chunk_stats",
    """SELECT file_id, CAST(length(d.text) AS INT) AS total_chars, CAST(count(*) AS INT) AS num_chunks,
              round(avg(c.n_chars), 4) AS avg_chunk_size
       FROM chunks c JOIN documents d ON doc_id = file_id GROUP BY file_id, d.text""",
)
def a6(spark, d):
    out = K.chunk_stats(texts(spark, d))
    return out.withColumn("avg_chunk_size", F.round("avg_chunk_size", 4))


@query(
    "a7_chunk_counts",
    """SELECT 'file' AS level, file_id AS id, count(*) AS n_chunks FROM chunks GROUP BY file_id UNION ALL
       SELECT 'workspace', workspace_id, count(*) FROM chunks JOIN files USING (file_id) GROUP BY workspace_id""",
)
def a7(spark, d):
    chunks = T.chunks(spark, d).select("file_id")
    placed = chunks.join(T.files(spark, d).select("file_id", "workspace_id"), "file_id")
    per_file = K.chunk_counts(chunks, "file_id").withColumnRenamed("file_id", "id")
    per_workspace = K.chunk_counts(placed, "workspace_id").select(F.col("workspace_id").cast("long").alias("id"), "n_chunks")
    return per_file.withColumn("level", F.lit("file")).unionByName(
        per_workspace.withColumn("level", F.lit("workspace"))
    )


BATCH_SQL = """
    SELECT file_id, CAST(chunk_index // 5 AS INT) AS batch, count(*) AS n_chunks,
           string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text
    FROM chunks GROUP BY ALL"""


@query("a8_ordered_batches", BATCH_SQL)
def a8(spark, d):
    return K.ordered_batches(T.chunks(spark, d))


@query("a8_file_batches", BATCH_SQL)
def a8_files(spark, d):
    return K.file_batches(texts(spark, d))


@query(
    "a15_text_census",
    """SELECT count(*) AS n_texts, count(DISTINCT md5(text)) AS n_distinct,
              CAST(sum(len(embedding) * 8) AS BIGINT) AS vector_bytes FROM chunk_store""",
)
def a15(spark, d):
    return K.text_census(T.chunk_store(spark, d))


@query(
    "a16_focus_sample",
    """SELECT context_id, file_id, sample FROM
         (SELECT context_id, min(file_id) AS file_id FROM context_files
          WHERE file_id IN (SELECT file_id FROM chunks) GROUP BY context_id)
       JOIN (SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS sample
             FROM chunks WHERE chunk_index < 5 GROUP BY file_id) USING (file_id)""",
)
def a16(spark, d):
    return K.focus_sample(T.context_files(spark, d), T.chunks(spark, d))
