"""Queries over workspaces, contexts, files and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.operators import catalog as C
from corpus_engine.plans.registry import query

USER = "user1"
DAY_FROM, DAY_TO = "1996-03-01", "1998-11-30"


@query(
    "p1_visible_workspaces",
    f"SELECT * FROM workspaces WHERE (user_id = '{USER}' OR public) AND active",
)
def p1(spark, d):
    return C.visible(T.workspaces(spark, d), USER)


@query("p2_owned_workspaces", f"SELECT * FROM workspaces WHERE user_id = '{USER}'")
def p2(spark, d):
    return C.owned(T.workspaces(spark, d), USER)


@query(
    "p3_visible_contexts",
    f"""SELECT * FROM contexts WHERE (user_id = '{USER}' OR public) AND active
        AND workspace_id IN (SELECT workspace_id FROM workspaces)""",
)
def p3(spark, d):
    return C.visible_contexts(T.contexts(spark, d), USER, T.workspaces(spark, d))


@query(
    "p4_workspace_files",
    """SELECT file_id, workspace_id, document_type, filename FROM files
       WHERE workspace_id IN (SELECT workspace_id FROM workspaces)""",
)
def p4(spark, d):
    return C.workspace_files(T.files(spark, d), T.workspaces(spark, d))


@query(
    "p5_context_files",
    """SELECT context_id, file_id, filename, document_type FROM files JOIN context_files USING (file_id)""",
)
def p5(spark, d):
    out = C.select_files(T.files(spark, d), context_files=T.context_files(spark, d))
    return out.select("context_id", "file_id", "filename", "document_type")


@query(
    "p6_structured_files",
    "SELECT file_id, filename, document_type FROM files WHERE document_type = 'application/json'",
)
def p6(spark, d):
    return T.files(spark, d).filter(C.is_structured()).select("file_id", "filename", "document_type")


@query(
    "p7_report_list",
    f"""SELECT report_id, report_type, status, file_format, strftime(created, '%Y-%m-%d') AS created_day
        FROM reports WHERE user_id = '{USER}' AND report_type = '2-HIGH' AND status = 'F'
        AND output_format = 'markdown' AND CAST(created AS DATE) BETWEEN DATE '{DAY_FROM}' AND DATE '{DAY_TO}'""",
)
def p7(spark, d):
    out = C.list_reports(
        T.reports(spark, d),
        user=USER,
        report_type="2-HIGH",
        status="F",
        output_format="markdown",
        date_from=DAY_FROM,
        date_to=DAY_TO,
    )
    return out.select(
        "report_id", "report_type", "status", "file_format", F.date_format("created", "yyyy-MM-dd").alias("created_day")
    )


@query(
    "p8_report_access",
    f"""SELECT report_id, user_id, NOT (user_id IS NOT NULL AND user_id <> '{USER}') AS allowed FROM reports""",
)
def p8(spark, d):
    return T.reports(spark, d).select("report_id", "user_id", C.may_read(F.col("user_id"), F.lit(USER)).alias("allowed"))


@query(
    "p9_download_url",
    """SELECT report_id, coalesce(external_url, 'https://example.org/media/' || file_path) AS url FROM reports""",
)
def p9(spark, d):
    url = C.download_url(F.col("external_url"), F.col("file_path"), "https://example.org/media/")
    return T.reports(spark, d).select("report_id", url.alias("url"))


REQUESTS_SQL = """
    SELECT o_orderkey AS report_id,
      CASE WHEN o_orderkey % 13 = 0 THEN 'memo' ELSE
        ['institutional', 'descriptive', 'summary', 'evaluation', 'presentation'][o_orderkey % 5 + 1] END AS report_type,
      CASE WHEN o_orderkey % 17 = 0 THEN 'html' WHEN o_orderkey % 17 = 1 THEN NULL ELSE 'markdown' END AS output_format,
      CASE WHEN o_orderkey % 19 = 0 THEN 'xls' ELSE 'pdf' END AS file_format,
      CASE WHEN o_orderkey % 23 = 0 THEN repeat('x', 256) ELSE 'Reporte ' || o_orderkey END AS report_name,
      o_orderkey % 29 AS n_file_ids
    FROM orders"""


@query(
    "p20_request_validation",
    """SELECT report_id, array_to_string(list_filter([
         CASE WHEN report_type NOT IN ('institutional', 'descriptive', 'summary', 'evaluation', 'presentation')
              THEN 'report_type' END,
         CASE WHEN coalesce(output_format, '') NOT IN ('markdown', 'plain_text') THEN 'output_format' END,
         CASE WHEN file_format NOT IN ('pdf', 'word', 'csv', 'pptx', 'txt') THEN 'file_format' END,
         CASE WHEN length(report_name) > 255 THEN 'report_name' END,
         CASE WHEN n_file_ids = 0 THEN 'file_ids' END], lambda v: v IS NOT NULL), ',') AS violations
       FROM requests""",
    ctes={"requests": REQUESTS_SQL},
)
def p20(spark, d):
    k = F.col("o_orderkey")
    requests = T.load(spark, d, "orders").select(
        k.alias("report_id"),
        F.when(k % 13 == 0, "memo").otherwise(T.pick(C.REPORT_TYPES, k % 5)).alias("report_type"),
        F.when(k % 17 == 0, "html").when(k % 17 != 1, "markdown").alias("output_format"),
        F.when(k % 19 == 0, "xls").otherwise("pdf").alias("file_format"),
        F.when(k % 23 == 0, F.repeat(F.lit("x"), 256))
        .otherwise(F.concat(F.lit("Reporte "), k.cast("string")))
        .alias("report_name"),
        (k % 29).alias("n_file_ids"),
    )
    return requests.select("report_id", F.array_join(C.request_violations(), ",").alias("violations"))


@query(
    "p20_upload_extensions",
    """SELECT file_id, lower(string_split(filename, '.')[-1]) IN ('pdf', 'txt', 'xls', 'xlsx') AS allowed FROM files""",
)
def p20_upload(spark, d):
    return T.files(spark, d).select("file_id", C.upload_allowed(F.col("filename")).alias("allowed"))


@query(
    "x41_media_type",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/csv'
         WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'text/plain' ELSE 'application/octet-stream' END AS media_type
       FROM documents""",
)
def x41(spark, d):
    ext = T.pick([".JSON", ".csv", ".tar.pdf", ".txt", ".weird", ""], F.col("doc_id") % 6)
    name = F.concat("source", ext)
    return T.load(spark, d, "documents").select("doc_id", C.media_type(name, T.MEDIA_TYPES).alias("media_type"))


@query(
    "j1_context_chunks",
    """SELECT context_id, count(*) AS n_chunks, CAST(sum(n_chars) AS BIGINT) AS n_chars
       FROM chunks JOIN context_files USING (file_id) GROUP BY context_id""",
)
def j1(spark, d):
    joined = C.chunks_of_contexts(T.chunks(spark, d), T.context_files(spark, d))
    return joined.groupBy("context_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("n_chars"))


@query(
    "j2_chunk_filenames",
    "SELECT file_id, chunk_index, filename FROM chunks JOIN files USING (file_id)",
)
def j2(spark, d):
    return C.with_filename(T.chunks(spark, d), T.files(spark, d)).select("file_id", "chunk_index", "filename")


ROLLUP_SQL = """
    SELECT w.workspace_id, w.title, count(DISTINCT f.file_id) AS n_files,
           count(DISTINCT c.context_id) FILTER (WHERE c.active) AS n_contexts
    FROM {} w LEFT JOIN files f ON f.workspace_id = w.workspace_id
    LEFT JOIN contexts c ON c.workspace_id = w.workspace_id GROUP BY ALL"""


@query("j3_workspace_sides", ROLLUP_SQL.format("workspaces"))
def j3(spark, d):
    out = C.workspace_rollup(T.workspaces(spark, d), T.files(spark, d), T.contexts(spark, d))
    return out.select("workspace_id", "title", "n_files", "n_contexts")


@query(
    "a1_workspace_rollup",
    """SELECT w.workspace_id, count(DISTINCT l_orderkey) AS n_files,
              count(DISTINCT c_custkey) FILTER (WHERE c_mktsegment <> 'MACHINERY') AS n_contexts
       FROM workspaces w LEFT JOIN customer ON c_nationkey = w.workspace_id
       LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
       GROUP BY w.workspace_id""",
)
def a1(spark, d):
    """The roll-up at fact size: an order with lines plays the file, a customer the context."""
    contexts = T.contexts(spark, d)
    orders = T.load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("context_id"))
    lines = T.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    filled = orders.join(lines, "o_orderkey", "left_semi")
    files = filled.join(contexts.select("context_id", "workspace_id"), "context_id").withColumnRenamed(
        "o_orderkey", "file_id"
    )
    out = C.workspace_rollup(T.workspaces(spark, d), files, contexts)
    return out.select("workspace_id", "n_files", "n_contexts")


@query(
    "a2_files_per_context",
    """SELECT c.context_id, count(cf.file_id) AS n_files FROM contexts c
       LEFT JOIN context_files cf ON cf.context_id = c.context_id GROUP BY c.context_id""",
)
def a2(spark, d):
    return C.files_per_context(T.contexts(spark, d), T.context_files(spark, d)).select("context_id", "n_files")


@query(
    "a5_file_kind_counts",
    """SELECT context_id, total, n_json, total - n_json AS n_text,
              total - n_json > 0 OR n_json = 0 AS search_text, n_json > 0 AS search_json
       FROM (SELECT context_id, count(file_id) AS total, count(*) FILTER (WHERE ext = 'json') AS n_json
             FROM contexts LEFT JOIN (SELECT * FROM context_files JOIN files USING (file_id)) USING (context_id)
             GROUP BY context_id)""",
)
def a5(spark, d):
    return C.file_kind_counts(T.contexts(spark, d), T.context_files(spark, d), T.files(spark, d))


FOREIGN_SQL = """
    SELECT rf.report_id, r.context_id, rf.file_id FROM report_files rf JOIN reports r USING (report_id)
    WHERE NOT EXISTS (SELECT 1 FROM context_files cf
                      WHERE cf.context_id = r.context_id AND cf.file_id = rf.file_id)"""


@query("j5_foreign_files", FOREIGN_SQL)
def j5(spark, d):
    out = C.foreign_ids(T.report_files(spark, d), T.reports(spark, d), T.context_files(spark, d))
    return out.select("report_id", "context_id", "file_id")


@query(
    "j6_files_in_reports",
    """SELECT context_id, file_id, filename FROM files JOIN context_files USING (file_id)
       WHERE file_id IN (SELECT file_id FROM report_files)""",
)
def j6(spark, d):
    out = C.select_files(T.files(spark, d), T.context_files(spark, d), T.report_files(spark, d))
    return out.select("context_id", "file_id", "filename")


@query(
    "j14_cascading_delete",
    """SELECT 'file' AS kind, file_id, CAST(NULL AS INT) AS chunk_index FROM files WHERE processed
       UNION ALL SELECT 'chunk', c.file_id, c.chunk_index FROM chunks c JOIN files f USING (file_id)
       WHERE f.processed""",
)
def j14(spark, d):
    all_files = T.files(spark, d)
    left, chunks = C.delete_files(all_files, T.chunks(spark, d), all_files.filter(~F.col("processed")))
    return left.select(F.lit("file").alias("kind"), "file_id", F.lit(None).cast("int").alias("chunk_index")).unionByName(
        chunks.select(F.lit("chunk").alias("kind"), "file_id", "chunk_index")
    )


@query(
    "j15_files_to_ingest",
    """SELECT file_id, filename FROM files WHERE NOT processed
       AND file_id NOT IN (SELECT doc_id FROM labels)""",
)
def j15(spark, d):
    stored = T.load(spark, d, "labels").select(F.col("doc_id").alias("file_id"))
    return C.files_to_ingest(T.files(spark, d), stored).select("file_id", "filename")


@query(
    "j15_get_or_create",
    """SELECT workspace_id, filename FROM
         (SELECT DISTINCT CAST(l_suppkey % 20 AS INT) AS workspace_id,
                 'src' || (l_suppkey % 20) || '_' || l_partkey || '.pdf' AS filename FROM lineitem) w
       WHERE NOT EXISTS (SELECT 1 FROM files f
                         WHERE f.workspace_id = w.workspace_id AND f.filename = w.filename)""",
)
def j15_create(spark, d):
    ws = (F.col("l_suppkey") % 20).cast("int")
    name = F.concat(F.lit("src"), ws.cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".pdf"))
    wanted = T.load(spark, d, "lineitem").select(ws.alias("workspace_id"), name.alias("filename"))
    return C.get_or_create(T.files(spark, d), wanted)


@query(
    "t5_newest_reports",
    "SELECT report_id, strftime(created, '%Y-%m-%d') AS created_day, status FROM reports",
)
def t5(spark, d):
    out = C.newest_first(T.reports(spark, d), "created", "report_id")
    return out.select("report_id", F.date_format("created", "yyyy-MM-dd").alias("created_day"), "status")


@query(
    "u1_all_uploads",
    """SELECT file_id, filename, 'catalogue' AS origin FROM files WHERE ext IN ('pdf', 'docx')
       UNION ALL SELECT file_id, filename, 'upload' FROM files WHERE ext NOT IN ('pdf', 'docx')""",
)
def u1(spark, d):
    files = T.files(spark, d).select("file_id", "filename", "ext")
    external = F.col("ext").isin("pdf", "docx")
    catalogue = files.filter(external).withColumn("origin", F.lit("catalogue"))
    return catalogue.unionByName(files.filter(~external).withColumn("origin", F.lit("upload"))).drop("ext")


@query(
    "u3_requested_minus_valid",
    """SELECT DISTINCT context_id, file_id FROM report_files JOIN reports USING (report_id)
       EXCEPT SELECT context_id, file_id FROM context_files""",
)
def u3_pairs(spark, d):
    asked = T.report_files(spark, d).join(T.reports(spark, d).select("report_id", "context_id"), "report_id")
    return asked.select("context_id", "file_id").subtract(T.context_files(spark, d))


@query(
    "u6_membership_edit",
    """SELECT context_id, file_id FROM
         (SELECT context_id, file_id FROM context_files
          UNION SELECT r.context_id, rf.file_id FROM report_files rf JOIN reports r USING (report_id)
          WHERE rf.file_id IN (SELECT file_id FROM files))
       EXCEPT SELECT context_id, file_id FROM context_files JOIN files USING (file_id) WHERE NOT processed""",
)
def u6(spark, d):
    files, members = T.files(spark, d), T.context_files(spark, d)
    add = T.report_files(spark, d).join(T.reports(spark, d).select("report_id", "context_id"), "report_id")
    remove = members.join(files.filter(~F.col("processed")).select("file_id"), "file_id")
    return C.edit_membership(members, add, remove, files)
