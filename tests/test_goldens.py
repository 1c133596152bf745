"""Documented input and output pairs, and small hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from corpus_engine.functions import markup as K
from corpus_engine.functions import metadata as M
from corpus_engine.functions import records as R
from corpus_engine.functions import text as X
from corpus_engine.functions.language import guess_language
from corpus_engine.functions.markup import SPEC_SCHEMA, normalised_spec, slide_violations
from corpus_engine.functions.metadata import license_code
from corpus_engine.functions.questions import search_terms
from corpus_engine.operators import entities as E
from corpus_engine.operators import structured as S
from corpus_engine.operators.chunks import focus_of

NOTHING = dict(
    search_terms=[], years=[], has_terms=False, has_range=False, range=None, has_quantity=False,
    quantity_filter=None, has_request_action=False, should_search=False,
)
ASKED = {**NOTHING, "has_request_action": True, "should_search": True}
QUESTIONS = {
    "hola": NOTHING,
    "": NOTHING,
    "¿Cómo estás? Todo bien, gracias": NOTHING,
    "haz un resumen": ASKED,
    "haz un resumen de cultura popular": {**ASKED, "search_terms": ["cultura popular"], "has_terms": True},
    "dame los registros entre 2010 y 2012": {
        **ASKED, "has_range": True, "range": {"type": "year", "from": 2010, "to": 2012},
    },
    "quiero los registros con costo mayor a 100": {
        **ASKED, "has_quantity": True, "quantity_filter": {"operator": ">", "value": 100.0, "semantic_hint": None},
    },
    "energia renovable, hidrogeno verde en 2021": {
        **NOTHING, "search_terms": ["energia renovable", "hidrogeno verde"], "has_terms": True, "years": [2021],
        "should_search": True,
    },
    "precio mayor o igual a 2,5": {
        **NOTHING, "has_quantity": True, "should_search": True,
        "quantity_filter": {"operator": ">=", "value": 2.5, "semantic_hint": None},
    },
}


@pytest.mark.parametrize("question", QUESTIONS)
def test_question_terms(spark, question):
    df = spark.createDataFrame([(question,)], "text string")
    found = search_terms(df, "text").select("search").first()["search"].asDict(recursive=True)
    assert found == QUESTIONS[question]


def test_places(spark):
    names = {
        "China": True, "Francia": True, "Yucatán": True, "Normandía": True, "Beijing": True, "Versalles": True,
        "Palacio de Versalles": False, "Gran Muralla China": False, "UNESCO": False, "Abadía de Fontenay": False,
        " ": False, "Distrito 9": False, "uno dos tres cuatro cinco": False,
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select("name", E.plausible_location(F.col("name")).alias("ok")).collect()
    assert {r["name"]: r["ok"] for r in rows} == names


def test_trigram_similarity_of_published_pair(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert df.select(F.round(X.trigram_similarity(F.col("a"), F.col("b")), 6)).first()[0] == 0.363636


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6])
def test_prefilter_loses_no_similar_text(spark, threshold):
    terms = ["word", "cambio climático", "a", "x1 y2"]
    texts = ["two words", "swords", "clima", "el cambio", "climáticos", "a", "b a", "X1", "y2 x1", "", "w", "wor", "cam cli"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wanted = F.greatest(*[X.trigram_similarity(F.col("t"), F.lit(t)) for t in terms]) >= threshold
    rows = df.select("t", wanted.alias("want"), X.resembles_any(F.col("t"), terms, threshold).alias("got")).collect()
    assert [r["t"] for r in rows if r["want"] != r["got"]] == []


RECORD = {
    "anio": 2021, "b": True, "f": 1.5, "autores": [{"nombre": "Ana"}, {"nombre": "Luis"}], "doc": {"nombre": "X"},
    "tags": ["a", "b"], "z": None,
}
PATHS = [
    ("anio", "number"), ("autores", "array"), ("autores", "object"), ("autores.nombre", "string"), ("b", "boolean"),
    ("doc", "object"), ("doc.nombre", "string"), ("f", "number"), ("tags", "array"), ("tags", "string"), ("z", "null"),
]
SCHEMA = (
    "anio int, b boolean, f double, autores array<struct<nombre: string>>, doc struct<nombre: string>, "
    "tags array<string>, z string"
)


@pytest.fixture(scope="module")
def record(spark):
    df = spark.createDataFrame([(json.dumps(RECORD),)], "doc string")
    return df.select(F.parse_json("doc").alias("v"), F.from_json("doc", SCHEMA).alias("rec"))


def test_walk_finds_every_path(record):
    nodes = R.walk(record, "v", []).select("path", R.variant_type(F.col("value")).alias("t")).distinct()
    assert sorted((r["path"], r["t"]) for r in nodes.collect()) == PATHS


def test_walk_hands_on_deep_nodes_whole(record):
    nodes = R.walk(record, "v", [], max_depth=1).withColumn("json", F.to_json("value"))
    closed = {r["path"]: json.loads(r["json"]) for r in nodes.filter("unopened").collect()}
    assert closed == {k: v for k, v in RECORD.items() if isinstance(v, (dict, list)) and v}
    assert R.walk(record, "v", []).filter("unopened").count() == 0


def test_leaves_of_any_text():
    text = '{"b": 12345678.90, "a": [[1, {"x": true}], []], "c": null, "n": 1e3, "z": {}, "it\'s": "q"}'
    assert R.found_leaves(text) == [
        ("b", "b", "number", "12345678.90"), ("a.0.0", "a.array.array", "integer", "1"),
        ("a.0.1.x", "a.array.array.x", "boolean", "True"), ("c", "c", "null", None), ("n", "n", "number", "1e3"),
        ("it's", "it's", "string", "q"),
    ]
    assert R.found_leaves("[3]") == [("0", "array", "integer", "3")] and R.found_leaves('"s"') == [("", "", "string", "s")]
    assert R.found_leaves(None) is None and R.found_leaves("{") is None and R.found_leaves("[" * 100_000) is None


def test_keys_with_quotes_and_large_fractions(spark):
    doc = {"it's": 1, 'a"b': 2, """x'y"z""": {"k": 3}, "n": 12345678.9}
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(F.parse_json("doc").alias("v"), F.from_json("doc", "n double").alias("rec"))
    got = df.select(*[R.at_path(F.col("v"), path, "int") for path in (["it's"], ['a"b'], ["""x'y"z""", "k"], ["no", "k"])]).first()
    assert tuple(got) == (1, 2, 3, None)
    assert df.select(R.record_text(F.col("rec"), "n double")).first()[0] == "N: 12345678.9"


@pytest.mark.parametrize(
    "text,value",
    [("mayor a 1,000,000", 1e6), ("mayor a 1.500.000,50", 1500000.5), ("mayor a 3 mil", 3000.0), ("mayor a 2,5", 2.5),
     ("mayor a 1,234.5", 1234.5), ("mayor a 100", 100.0), ("mayor a 2 millones", 2e6), ("mayor a 12.75 pesos", 12.75)],
)
def test_numbers_in_questions(spark, text, value):
    df = spark.createDataFrame([("quiero los registros con costo " + text,)], "text string")
    found = search_terms(df, "text").first()["search"]
    assert found["quantity_filter"]["value"] == value
    assert found["search_terms"] == (["pesos"] if "pesos" in text else [])


def test_dates_without_a_day_are_none(spark):
    df = spark.createDataFrame([("D:2024",), ("D:20240131",), ("D:2024013",)], "d string")
    assert [r[0] for r in df.select(M.compact_date(F.col("d"))).collect()] == [None, "2024-01-31", None]


def test_packed_answers_of_any_length(spark):
    rows = ",".join(f'"{i},name {i}"' for i in range(40))
    df = spark.createDataFrame([(rows,), ('a,b\n"x, y","z, w"',), ('"one field"',), (None,)], "t string")
    got = [r[0] for r in df.select(K.csv_lines(F.col("t"))).collect()]
    assert got[0] == [f"{i},name {i}" for i in range(40)] and got[1] == ["a,b", '"x, y","z, w"'] and got[2] == ['"one field"']


def test_merge_reads_the_file(spark):
    columns = "id int, file_title string, model_title string, file_creator string, model_creator array<string>, file_keywords string, model_keywords array<string>, model_description string, file_description string, model_date string, file_date string, model_type string, model_identifier string, file_publisher string, model_publisher string, model_rights string, file_language string, model_language string, file_rights string, file_identifier string, file_type string"
    many = ",".join(f"word{i}" for i in range(14))
    row = (1, "t", None, "a", [f"n{i}" for i in range(8)], many, None, None, None, None, None, None, None, None, None, None, None, None, "CC BY 4.0", "id-7", "imagen")
    got = M.merge(spark.createDataFrame([row], columns), "2024-01-01", "id").first()
    assert got["identifier"] == "id-7" and got["rights"] != M.ALL_RIGHTS and len(got["creator"]) == 9 and len(got["subject"]) == 14
    assert len(M.merge(spark.createDataFrame([row], columns), "2024-01-01", "id", 5, 10).first()["subject"]) == 10


def test_flat_record(record):
    leaf = record.select(F.inline(R.leaves(F.col("rec"), SCHEMA))).collect()
    assert [(r["path"], r["value"]) for r in leaf] == [
        ("anio", "2021"), ("b", "True"), ("f", "1.5"), ("autores.0.nombre", "Ana"), ("autores.1.nombre", "Luis"),
        ("doc.nombre", "X"), ("tags.0", "a"), ("tags.1", "b"), ("z", None),
    ]
    kt = record.select(F.inline(R.keys_and_types(R.leaves(F.col("rec"), SCHEMA, legacy=True)))).collect()
    assert dict(map(tuple, kt)) == {
        "anio": "integer", "b": "integer", "f": "unknown", "autores.array.nombre": "string", "doc.nombre": "string",
        "tags.array": "string", "z": "unknown",
    }


def test_typed_tests_on_lists(record):
    def holds(test, key):
        return record.select(S.some_leaf(F.col("v"), key, test)).first()[0]

    assert holds(S.resembles(["luis"]), "autores[].nombre") and not holds(S.resembles(["pedro"]), "autores[].nombre")
    assert holds(S.resembles(["b"]), "tags[]") and holds(S.in_year_range(2020, 2021), "anio")
    assert holds(S.mentions_year([2021]), "anio") and not holds(S.mentions_year([2021]), "doc.nombre")
    assert not holds(S.compares(">", 0), "b") and holds(S.compares("<=", 1.5), "f")


def test_answers_with_a_tail_are_no_json(spark):
    df = spark.createDataFrame([('{"a": 1} y {"b": 2}',), ('{"a": 1}',), ("[1, 2] fin",)], "t string")
    rows = df.select(F.to_json(R.parse_whole(F.col("t"))).alias("v")).collect()
    assert [r["v"] for r in rows] == [None, '{"a":1}', None]


def test_sample_deck(spark):
    deck = {
        "title": "Reporte", "subtitle": "s", "filename": "dir/r",
        "slides": [
            {"layout": "title", "title": "otro"}, {"layout": "bullets", "title": "b", "bullets": ["x"]},
            {"layout": "two_columns", "left": {"heading": "l", "bullets": []}, "right": {"heading": "r"}},
            {"layout": "sources", "sources": [{"name": "n", "detail": "d"}]},
        ],
    }
    df = spark.createDataFrame([(json.dumps(deck),)], "t string").select(F.from_json("t", SPEC_SCHEMA).alias("s"))
    none = F.array().cast("array<struct<name: string, detail: string>>")
    out = df.select(normalised_spec(F.col("s"), F.lit("Mi reporte"), none).alias("n"), slide_violations(F.col("s"))).first()
    assert out[1] == [] and out["n"]["filename"] == "dir_r.pptx"
    assert [s["layout"] for s in out["n"]["slides"]] == ["title", "bullets", "two_columns", "sources"]
    assert out["n"]["slides"][0]["title"] == "Mi reporte"
    assert out["n"]["slides"][-1]["sources"][0]["name"] == "Sin fuentes"


def test_small_texts(spark):
    df = spark.createDataFrame([(" None ", "nota_interna", "Mixto  TEXTO\n fin")], "a string, k string, t string")
    row = df.select(
        X.clean_value(F.col("a")), X.label(F.col("k")), X.clean_value(F.col("t")), X.slug(F.col("t")),
        focus_of(F.lit("Perú\notra")), focus_of(F.lit(None).cast("string")), guess_language(F.lit("the cat and the dog")),
        guess_language(F.lit("hi")), license_code(F.lit("cc by-nc 4.0")), license_code(F.lit("cc by-nc"), True),
    ).first()
    assert list(row) == [
        "(sin valor)", "Nota interna", "Mixto TEXTO fin", "mixto-texto-fin", "Perú", "México", "en", "es", "CC-BY-NC",
        "CC-BY",
    ]
