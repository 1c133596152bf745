"""Sources, sinks, streams and model hooks on small files."""

import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_engine.functions.text import NO_VALUE
from corpus_engine.operators import conversations as V
from corpus_engine.operators import inference as I
from corpus_engine.operators import ingest as G
from corpus_engine.operators.chunks import chunk_files
from corpus_engine.plans.registry import QUERIES
from corpus_engine.sources import readers as R
from corpus_engine.sources import writers as W
from corpus_engine.streaming import ingest, turns


def test_json_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[\n {"a": 1},\n {"a": 2}\n]')
    (tmp_path / "one.json").write_text('{"a": 3}')
    (tmp_path / "bad.json").write_text('{"a": ')
    good, bad = R.read_json_entries(spark, str(tmp_path))
    rows = good.select("entry_index", F.variant_get("entry", "$.a", "int").alias("a")).collect()
    assert sorted(map(tuple, rows)) == [(0, 1), (0, 3), (1, 2)]
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]


def test_csv_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text('clave,nota_larga\n007,"dos ""x"", y"\n8,NA\n')
    (tmp_path / "u.csv").write_text('clave,nota_larga\n9,"dos\nlíneas"\n1,a,b\n2\n')
    good, ragged = R.read_csv_rows(spark, str(tmp_path))
    assert sorted(r.line.strip() for r in ragged.collect()) == ["1,a,b", "2"]
    assert [r.nota_larga for r in good.filter("clave = '9'").collect()] == ["dos\nlíneas"]
    rows = R.csv_texts(good.filter("clave <> '9'")).orderBy("clave").collect()
    assert [tuple(r) for r in rows] == [
        ("007", 'dos "x", y', 'Clave: 007\nNota larga: dos "x", y'),
        ("8", NO_VALUE, f"Clave: 8\nNota larga: {NO_VALUE}"),
    ]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("\n ñandú \n".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe malo")
    (tmp_path / "c.txt").write_bytes(b"  \n")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 plain looking")
    (tmp_path / "f.pdf").write_bytes(b"extracted before")
    good, rejected = R.read_text_files(spark, str(tmp_path))
    assert [(r["filename"], r["text"]) for r in good.orderBy("filename").collect()] == [("a.TXT", "ñandú"), ("f.pdf", "extracted before")]
    assert {r["filename"]: r["reason"] for r in rejected.collect()} == {
        "b.txt": "not UTF-8", "c.txt": "empty", "d.exe": "unsupported format", "e.pdf": "text not extracted",
    }


def test_geojson_parts_join_to_one_document(spark, tmp_path):
    rows = spark.range(50).select("id", F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit("}")).alias("feature"))
    W.write_geojson(rows.repartition(5), str(tmp_path / "g"), ["id"])
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "g" / "part-*"))))
    doc = json.loads(text)
    assert doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == list(range(50))


def test_geojson_with_equal_and_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(k, f'{{"k":{i}}}') for i, k in enumerate([1, 1, None, None, 2])], "id int, feature string")
    W.write_geojson(rows.repartition(3), str(tmp_path / "g"), ["id"])
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "g" / "part-*"))))
    assert sorted(f["k"] for f in json.loads(text)["features"]) == [0, 1, 2, 3, 4]


def test_texts_keep_form_feeds(spark, tmp_path):
    texts = ["a\fb", "c\\f", "\\\f\\", "", "x\ny"]
    W.write_texts(spark.createDataFrame([(t,) for t in texts], "text string"), str(tmp_path / "t"))
    assert sorted(r.text for r in W.read_texts(spark, str(tmp_path / "t")).collect()) == sorted(texts)


def test_long_texts_are_embedded_whole_or_not_at_all(spark):
    df = spark.createDataFrame([(1, "a " * 20_000 + "b"), (2, "a " * 20_000 + "c")], "id int, t string")
    a, b = (r.embedding for r in I.embed(df, "t", I.hashed_words(64), size=64).orderBy("id").collect())
    assert a != b
    assert [r.embedding for r in I.embed(df, "t", I.hashed_words(64), size=64, most_chars=100).collect()] == [None, None]


def test_ingest_chooses_among_texts_of_one_id(spark, tmp_path):
    src, table, check = (str(tmp_path / n) for n in ("src", "table", "check"))
    spark.createDataFrame([(1, "zeta"), (1, "alfa"), (2, "beta")], "file_id long, text string").repartition(3).write.parquet(src)
    arriving = spark.readStream.schema("file_id long, text string").parquet(src)
    ingest.ingest(arriving, table, check).awaitTermination()
    assert sorted((r.file_id, r.text) for r in spark.read.parquet(table).collect()) == [(1, "alfa"), (2, "beta")]


def test_chunk_table_by_language(spark, tmp_path):
    texts = spark.createDataFrame([(1, "de la que el en y los " * 90), (2, "the cat and the dog is " * 90)], "file_id long, text string")
    files = spark.createDataFrame([(1, "a.txt", "text/plain"), (2, "b.txt", "text/plain")], "file_id long, filename string, document_type string")
    W.write_chunks(W.chunk_rows(chunk_files(texts), files), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert {(r["file_id"], r["language"]) for r in back.collect()} == {(1, "es"), (2, "en")}
    assert {r["source"] for r in back.select("metadata.source").collect()} == {"a.txt", "b.txt"}


def test_stream_ingest_equals_batch_and_skips_known_files(spark, tmp_path):
    src, table, check = (str(tmp_path / n) for n in ("src", "table", "check"))
    texts = spark.createDataFrame([(i, f"texto número {i} " * (20 * i + 1)) for i in range(8)], "file_id long, text string")

    def run():
        arriving = spark.readStream.schema("file_id long, text string").parquet(src)
        ingest.ingest(arriving, table, check).awaitTermination()

    texts.filter("file_id < 5").write.parquet(src)
    run()
    texts.filter("file_id >= 3").write.mode("append").parquet(src)
    run()
    run()
    columns = ["file_id", "chunk_index", "text", "language"]
    got = sorted(map(tuple, spark.read.parquet(table).select(columns).collect()))
    assert got == sorted(map(tuple, chunk_files(texts).select(columns).collect()))


def test_stream_turns_equal_batch(spark, tmp_path):
    src, table, check = (str(tmp_path / n) for n in ("src", "table", "check"))
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"c{c} t{t}") for c in range(4) for t in range(6 * c + 2)]
    df = spark.createDataFrame(rows, turns.TURN)
    for step in ("turn < 5", "turn >= 5 AND turn < 13", "turn >= 13"):
        df.filter(step).coalesce(1).write.mode("append").parquet(src)
        arriving = spark.readStream.schema(turns.TURN).parquet(src)
        turns.keep_latest(turns.recent_turns(arriving), table, check).awaitTermination()
    got = sorted(map(tuple, turns.latest(spark.read.parquet(table)).select("conv_id", "history", "n_turns").collect()))
    assert got == sorted(map(tuple, V.recent_history(V.without_system(df)).select("conv_id", "history", "n_turns").collect()))


def test_parts_of_files():
    assert G.json_parts(' [ {"a": 1.50} ,\n[2], "x]" , null ] ') == ['{"a": 1.50}', "[2]", '"x]"', "null"]
    assert G.json_parts('{"a": [1, 2]}\n') == ['{"a": [1, 2]}'] and G.json_parts("[]") == []
    assert G.json_parts("") is None and G.json_parts("[1,") is None and G.json_parts("[1] 2") is None
    assert G.csv_parts('a,b\n1,"x\ny"\n\n2\n') == ['{"a": "1", "b": "x\\ny"}', '{"_cells": ["2"]}']
    assert G.csv_parts("") == [] and G.csv_parts("a,b") == []
    assert G.csv_parts("a,a,b,a.1\n1,2,n/a,\n") == ['{"a": "1", "a.1": "2", "b": "(sin valor)", "a.1.1": "(sin valor)"}']


def test_stream_and_batch_cut_routed_files_alike(spark, tmp_path):
    rows = [(1, "a.txt", "text/plain", "text", "hola " * 500), (2, "b.json", "application/json", "records", '[{"k": 1}, {"k": 2}]'),
            (3, "c.csv", "text/csv", "rows", "a,b\n1,2\n"), (4, "d.json", "application/json", "records", "{")]
    files = spark.createDataFrame(rows, "file_id long, filename string, document_type string, route string, text string")
    src, table, check = (str(tmp_path / n) for n in ("src", "table", "check"))
    files.write.parquet(src)
    arriving = spark.readStream.schema(files.schema).parquet(src)
    ingest.ingest(arriving, table, check).awaitTermination()
    good, rejected = G.chunk_table(files)
    got = spark.read.parquet(table).select(good.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, good.collect())) and good.count() == 6
    assert [r.file_id for r in rejected.collect()] == [4]


def test_embedding_hook(spark):
    def model(texts):
        if any("malo" in t for t in texts):
            raise ValueError("no")
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "uno"), (2, "malo"), (3, "uno"), (4, "cuatro"), (5, None)], "id long, t string")
    rows = {r["id"]: r["embedding"] for r in I.embed(df, "t", model, size=2).collect()}
    assert rows == {1: [3.0, 1.0], 2: [0.0, 0.0], 3: [3.0, 1.0], 4: [6.0, 1.0], 5: None}


def test_hashed_words_are_repeatable():
    embed = I.hashed_words(16)
    a, b = embed(["uno dos", "dos uno"]), embed(["uno dos"])
    assert np.allclose(a[0], a[1]) and np.allclose(a[0], b[0]) and np.isclose(np.linalg.norm(a[0]), 1)


def test_answer_hook(spark):
    def model(prompts):
        if any(p == "malo" for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("uno",), ("malo",)], "p string").coalesce(1)
    assert sorted(map(tuple, I.respond(df, "p", model).collect())) == [("malo", None, "no"), ("uno", "UNO", None)]


def test_shared_folder_is_fresh(spark):
    from corpus_engine.session import cut_lineage, shared_folder

    assert shared_folder(spark) != shared_folder(spark)
    assert cut_lineage(spark.range(3)).count() == 3


@pytest.mark.parametrize("k", [1, 3])
def test_history_keeps_the_last_turns(spark, k):
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(5)], turns.TURN)
    row = V.recent_history(df, k).first()
    assert row["history"] == "\n".join(f"USUARIO: t{t}" for t in range(5 - k, 5))


def test_long_cells_are_read_and_unreadable_files_kept(spark, tmp_path):
    long = "palabra " * 25_000
    rows = [(1, "a.csv", "text/csv", "rows", f'clave,nota\n7,"{long}"\n'), (2, "b.json", "application/json", "records", "{")]
    files = spark.createDataFrame(rows, "file_id long, filename string, document_type string, route string, text string")
    good, rejected = G.chunk_table(files)
    assert [json.loads(r.text_json) for r in good.collect()] == [{"clave": "7", "nota": long}]
    src, table, check = (str(tmp_path / n) for n in ("src", "table", "check"))
    files.write.parquet(src)
    for _ in range(2):
        arriving = spark.readStream.schema(files.schema).parquet(src)
        ingest.ingest(arriving, table, check).awaitTermination()
    assert [r.file_id for r in spark.read.parquet(table).collect()] == [1]
    kept = spark.read.parquet(ingest.rejected_of(table)).select(rejected.columns).collect()
    assert list(map(tuple, kept)) == [(2, "b.json", "application/json", "records", "{")] == list(map(tuple, rejected.collect()))


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_that_are_folders(spark, tmp_path, parts):
    docs = [(i, f"texto número {i} de la casa", "es") for i in range(7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(parts)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    heard = [(i % 3, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(9)]
    frame = spark.createDataFrame(heard, "conv_id long, turn long, role string, text string").repartition(parts)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((r.file_id, r.text) for r in QUERIES["r1_incremental_ingest"](spark, str(tmp_path)).collect()) == [(i, t) for i, t, _ in docs]
    assert sorted((r.conv_id, r.n_turns) for r in QUERIES["r2_recent_turns"](spark, str(tmp_path)).collect()) == [(0, 3), (1, 3), (2, 3)]


def test_streams_read_tables_that_are_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": [1, 2], "text": ["uno de la casa", "dos"]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [3], "text": ["tres"]}), tmp_path / "documents_more.parquet")
    found = QUERIES["r1_incremental_ingest"](spark, str(tmp_path)).collect()
    assert sorted((r.file_id, r.text) for r in found) == [(1, "uno de la casa"), (2, "dos"), (3, "tres")]
