"""Queries that go through files: sources, sinks and streams.

They write to the shared folder of the cluster and read back what they wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import tables as T
from corpus_engine.functions import markup as M
from corpus_engine.operators import chunks as K
from corpus_engine.operators import entities as E
from corpus_engine.operators import inference
from corpus_engine.operators import ingest as G
from corpus_engine.plans import entities as EP
from corpus_engine.plans.chunks import sql_language
from corpus_engine.plans.chunks import texts as file_texts
from corpus_engine.plans.registry import query
from corpus_engine.plans.reports import csv_answers
from corpus_engine.session import shared_folder
from corpus_engine.sources import ranges as G2
from corpus_engine.sources import readers as R
from corpus_engine.sources import writers as W
from corpus_engine.streaming import ingest, turns


@query(
    "s1_json_entries",
    """SELECT event_id, 0::INT AS entry_index, json_extract_string(props, '$.k')::BIGINT AS k,
              CAST(NULL AS VARCHAR) AS kind FROM events
       UNION ALL SELECT event_id, 1, NULL, event_type FROM events WHERE event_id % 2 = 0""",
)
def s1(spark, d):
    """Lines that hold an object or a list of two, written and read back."""
    path = shared_folder(spark)
    eid = F.col("event_id").cast("string")
    first = F.concat(F.lit('{"id": '), eid, F.lit(', "props": '), "props", F.lit("}"))
    second = F.concat(F.lit(', {"id": '), eid, F.lit(', "kind": "'), "event_type", F.lit('"}]'))
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), first, second)).otherwise(first)
    T.load(spark, d, "events").select(line.alias("value")).write.text(path)
    entries, _ = R.read_json_entries(spark, path, lines=True)
    get = F.try_variant_get
    return entries.select(
        get("entry", "$.id", "long").alias("event_id"),
        "entry_index",
        get("entry", "$.props.k", "long").alias("k"),
        get("entry", "$.kind", "string").alias("kind"),
    )


@query("s1_json_ranges", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type AS kind FROM events")
def s1_ranges(spark, d):
    """All events as JSON lists, a list a file, read back in ranges."""
    path = shared_folder(spark)
    entry = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit(', "kind": "'), "event_type", F.lit('"}'))
    W.write_json_lists(T.load(spark, d, "events").select(entry.alias("entry")), path)
    entries, _ = G2.read_json_ranges(spark, path)
    get = F.try_variant_get
    return entries.select(
        get("entry", "$.id", "long").alias("event_id"), get("entry", "$.props.k", "long").alias("k"), get("entry", "$.kind", "string").alias("kind")
    )


S2_SQL = """SELECT c_custkey::VARCHAR AS c_custkey, m AS c_mktsegment,
              'C custkey: ' || c_custkey || chr(10) || 'C name: ' || c_name || ', Sr "x"' || chr(10)
                || 'C mktsegment: ' || m AS text
       FROM (SELECT *, CASE WHEN c_custkey % 4 < 3 THEN '(sin valor)' ELSE c_mktsegment END AS m FROM customer)"""


@query("s2_csv_ranges", S2_SQL)
def s2_ranges(spark, d):
    rows, _ = G2.read_csv_ranges(spark, written_customers(spark, d))
    return R.csv_texts(rows).select("c_custkey", "c_mktsegment", "text")


@query("s2_csv_rows", S2_SQL)
def s2(spark, d):
    rows, _ = R.read_csv_rows(spark, written_customers(spark, d))
    return R.csv_texts(rows).select("c_custkey", "c_mktsegment", "text")


def written_customers(spark, d):
    """Folder of CSV files with line ends and quotes in cells, and several words for a missing value."""
    path = shared_folder(spark)
    k = F.col("c_custkey")
    segment = F.when(k % 4 == 0, "NaN").when(k % 4 == 1, "N/A").when(k % 4 == 3, F.col("c_mktsegment"))
    customers = T.load(spark, d, "customer").select(
        "c_custkey", F.concat("c_name", F.lit(', Sr\n"x"')).alias("c_name"), segment.alias("c_mktsegment")
    )
    customers.write.csv(path, header=True, escape='"')
    return path


def file_contents(spark, d):
    """Files as bytes: some broken, some blank, some of a format that is not read."""
    k = F.col("doc_id")
    docs = T.load_spread(spark, d, "documents", ["doc_id", "text"])
    content = (
        F.when(k % 10 == 7, F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary")))
        .when(k % 10 == 8, F.lit(" \n\t ").cast("binary"))
        .otherwise(F.concat(F.lit("\n "), "text", F.lit(" \n")).cast("binary"))
    )
    name = F.concat(F.lit("doc.v1."), T.pick(["TXT", "json", "csv", "pdf", "docx", "xlsx"], k % 6))
    return docs.select("doc_id", name.alias("filename"), content.alias("content"))


TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "s3_text_files",
    f"SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (7, 8) THEN {TRIMMED} END AS text FROM documents",
)
def s3(spark, d):
    return file_contents(spark, d).select("doc_id", R.decoded(F.col("content")).alias("text"))


@query(
    "s3_files_on_disk",
    r"SELECT sum(length(regexp_replace(text, '\s', '', 'g')))::BIGINT AS n_chars, 0::BIGINT AS n_rejected FROM documents",
)
def s3_files(spark, d):
    """All texts written as files and read back through the router."""
    path = shared_folder(spark)
    T.load(spark, d, "documents").select("text").write.text(path)
    good, rejected = R.read_text_files(spark, path)
    held = good.agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("n_chars"))
    return held.withColumn("n_rejected", rejected.agg(F.count(F.lit(1))).scalar())


@query(
    "s4_format_routing",
    """SELECT doc_id, ['text', 'records', 'rows', 'text', 'text', NULL][doc_id % 6 + 1] AS route,
              CASE WHEN doc_id % 6 = 5 THEN 'unsupported format' WHEN doc_id % 10 = 7 THEN 'not UTF-8'
                   WHEN doc_id % 10 = 8 THEN 'empty' END AS reason FROM documents""",
)
def s4(spark, d):
    good, rejected = R.route_files(file_contents(spark, d), "filename", "content")
    return good.select("doc_id", "route", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("doc_id", "route", "reason")
    )


@query(
    "s5_chunk_table",
    """SELECT file_id, chunk_index, language, filename AS source, document_type AS content_type, n_chars AS chunk_size
       FROM chunks JOIN (SELECT file_id, filename, document_type FROM files) USING (file_id)""",
)
def s5(spark, d):
    path = shared_folder(spark)
    W.write_chunks(W.chunk_rows(T.chunks(spark, d), T.files(spark, d)), path)
    return spark.read.parquet(path).select("file_id", "chunk_index", "language", "metadata.*")


def all_formats(spark, d):
    """A document as text, as a JSON list of two records, or as CSV with an odd row, by its number."""
    k = F.col("doc_id")
    records = F.concat(
        F.lit('[{"doc_id": '), k.cast("string"), F.lit(', "importe": 12345678.90},\n {"fuente": {"nombre": "'), "source", F.lit('"}, "nada": null}]')
    )
    rows = F.concat(F.lit("doc_id,fuente_larga,fuente_larga\n"), k.cast("string"), F.lit(',"a ""b"",\n c",x\nNA,'), "source", F.lit(",n/a\n1,2\n"))
    docs = T.load_spread(spark, d, "documents", ["doc_id", "text", "source"])
    content = F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, records).otherwise(rows)
    name = F.concat(k.cast("string"), F.lit("."), T.pick(["txt", "json", "csv"], k % 3))
    files = docs.select(k.alias("file_id"), name.alias("filename"), T.pick(["text/plain", "application/json", "text/csv"], k % 3).alias("document_type"), content.cast("binary").alias("content"))
    return R.route_files(files, "filename", "content")[0].drop("content")


ALL_FORMATS_SQL = r"""
    WITH trimmed AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, source FROM documents),
    parts AS (
      SELECT doc_id AS file_id, CAST(i AS INT) AS chunk_index, t[i * 800 + 1 : i * 800 + 1000] AS text, NULL AS text_json, '.txt' AS ext
      FROM (SELECT doc_id, t, unnest(range(greatest(0, CAST(floor((length(t) - 201) / 800.0) AS BIGINT)) + 1)) AS i
            FROM trimmed WHERE doc_id % 3 = 0 AND t <> '')
      UNION ALL SELECT doc_id, 0, 'Doc id: ' || doc_id || chr(10) || 'Importe: 12345678.90',
        '{"doc_id": ' || doc_id || ', "importe": 12345678.90}', '.json' FROM documents WHERE doc_id % 3 = 1
      UNION ALL SELECT doc_id, 1, 'Fuente.nombre: ' || source, '{"fuente": {"nombre": "' || source || '"}, "nada": null}', '.json'
        FROM documents WHERE doc_id % 3 = 1
      UNION ALL SELECT doc_id, 0, 'Doc id: ' || doc_id || chr(10) || 'Fuente larga: a "b", c' || chr(10) || 'Fuente larga.1: x',
        '{"doc_id": "' || doc_id || '", "fuente_larga": "a \"b\",\n c", "fuente_larga.1": "x"}', '.csv' FROM documents WHERE doc_id % 3 = 2
      UNION ALL SELECT doc_id, 1, 'Doc id: (sin valor)' || chr(10) || 'Fuente larga: ' || source || chr(10) || 'Fuente larga.1: (sin valor)',
        '{"doc_id": "(sin valor)", "fuente_larga": "' || source || '", "fuente_larga.1": "(sin valor)"}', '.csv' FROM documents WHERE doc_id % 3 = 2
      UNION ALL SELECT doc_id, 2, ' cells.0: 1' || chr(10) || ' cells.1: 2', '{"_cells": ["1", "2"]}', '.csv'
        FROM documents WHERE doc_id % 3 = 2)
    SELECT file_id, chunk_index, text, text_json, file_id || ext AS source, CAST(length(text) AS BIGINT) AS chunk_size, 64::INT AS dims FROM parts"""


@query("s5_all_formats", ALL_FORMATS_SQL)
def s5_all(spark, d):
    """Files of three formats routed, cut, embedded, stored and read back."""
    path = shared_folder(spark)
    chunks, _ = G.chunk_table(all_formats(spark, d))
    W.write_chunks(G.with_vectors(chunks, inference.hashed_words(64), 64), path)
    back = spark.read.parquet(path)
    return back.select(
        "file_id",
        "chunk_index",
        "text",
        "text_json",
        F.get_json_object("metadata_json", "$.source").alias("source"),
        F.get_json_object("metadata_json", "$.chunk_size").cast("long").alias("chunk_size"),
        F.size("embedding").alias("dims"),
    )


@query(
    "s6_geojson",
    """SELECT pos, name, CASE WHEN coordenadas IS NULL THEN NULL ELSE 'Point' END AS shape, coordenadas[1] AS lon
       FROM cleaned""",
    EP.CTES,
)
def s6(spark, d):
    path = shared_folder(spark)
    places = EP.cleaned(spark, d)
    feature = E.features(places, ["name", "type", "context", "pais", "estado", "pos"])
    W.write_geojson(places.select("pos", feature.alias("feature")), path, ["pos"])
    lines = spark.read.text(path).filter(F.col("value").contains('"Feature"'))
    schema = (
        "geometry struct<type: string, coordinates: array<double>>, properties struct<name: string, pos: long>"
    )
    f = F.from_json(F.regexp_replace("value", "^,", ""), schema)
    return lines.select(f.alias("f")).select(
        "f.properties.pos", "f.properties.name", F.col("f.geometry.type").alias("shape"),
        F.get("f.geometry.coordinates", F.lit(0)).alias("lon"),
    )


@query("s7_report_texts", r"SELECT unnest([text, text || chr(12) || 'a\f\\' || chr(12)]) AS text FROM documents")
def s7(spark, d):
    """Every text, and again with form feeds and backslashes in it."""
    path = shared_folder(spark)
    docs = T.load(spark, d, "documents")
    W.write_texts(docs.select(F.explode(F.array("text", F.concat("text", F.lit("\fa\\f\\\\\f")))).alias("text")), path)
    return W.read_texts(spark, path)


@query("s8_tabular_reports", "SELECT s_suppkey::VARCHAR AS clave, s_name AS nombre FROM supplier")
def s8(spark, d):
    path = shared_folder(spark)
    rows = M.clean_csv(csv_answers(spark, d), "response").select(F.posexplode("lines").alias("place", "line"))
    W.write_tabular(rows.filter(F.col("place") > 0), path)
    return spark.read.csv(path, schema="clave string, nombre string")


INGEST_SQL = f"""
    SELECT file_id, chunk_index, text, language FROM (SELECT file_id, chunk_index, text FROM chunks) JOIN
      (SELECT doc_id AS file_id, {sql_language('text', '')} AS language FROM documents) USING (file_id)"""


@query(
    "r1_incremental_ingest",
    INGEST_SQL,
)
def r1(spark, d):
    table, checkpoint = shared_folder(spark), shared_folder(spark)
    arriving = T.load_stream(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    ingest.ingest(arriving, table, checkpoint).awaitTermination()
    return spark.read.parquet(table).select("file_id", "chunk_index", "text", "language")


@query("r1_batch_ingest", INGEST_SQL)
def r1_batch(spark, d):
    return K.chunk_files(file_texts(spark, d)).select("file_id", "chunk_index", "text", "language")


@query(
    "r2_recent_turns",
    """SELECT conv_id, count(*) AS n_turns,
              string_agg(CASE WHEN role = 'user' THEN 'USUARIO: ' ELSE 'ASISTENTE: ' END || text, chr(10) ORDER BY turn)
                AS history
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations
             WHERE role <> 'system') WHERE age <= 10 GROUP BY conv_id""",
)
def r2(spark, d):
    table, checkpoint = shared_folder(spark), shared_folder(spark)
    turns.keep_latest(turns.recent_turns(T.load_stream(spark, d, "conversations")), table, checkpoint).awaitTermination()
    return turns.latest(spark.read.parquet(table))
