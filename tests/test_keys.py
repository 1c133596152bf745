"""Key discovery at any depth, keys with dots, and key matching against the plain comparison."""

import json
import random

from pyspark.sql import functions as F

from corpus_engine import tables
from corpus_engine.functions import records as R
from corpus_engine.functions import text as X
from corpus_engine.operators import records as K
from corpus_engine.plans.registry import QUERIES
from tests.conftest import SMALL


def variants(spark, records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "doc string").select(F.parse_json("doc").alias("v"))


def nested(depth, leaf):
    return leaf if not depth else {f"k{depth}": nested(depth - 1, leaf)}


def plain_walk(value, keys=(), top=True):
    if isinstance(value, dict):
        for k, v in value.items():
            yield (*keys, k), v
            yield from plain_walk(v, (*keys, k), False)
    elif isinstance(value, list) and not top:
        for v in value:
            yield keys, v
            yield from plain_walk(v, keys, False)


DEEP = [nested(12, "hondo"), {"a": [[[{"b": nested(9, 7)}]], 5], "x.y": 1, "x": {"y": "dos"}, "": 3}, {"s": 1}]


def test_walk_whole_at_any_depth(spark):
    for step in (1, 2, 5, 20):
        got = R.walk_whole(variants(spark, DEEP), "v", [], step).select("keys", F.to_json("value").alias("j")).collect()
        want = [(list(k), v) for r in DEEP for k, v in plain_walk(r)]
        assert sorted((r.keys, json.dumps(json.loads(r.j), sort_keys=True)) for r in got) == sorted((k, json.dumps(v, sort_keys=True)) for k, v in want)


def test_discovery_below_the_eighth_level_and_of_dotted_keys(spark):
    found = K.discover_keys(variants(spark, DEEP), "v", terms=["hondo"]).collect()
    assert (".".join(f"k{i}" for i in range(12, 0, -1)), "string") in {(r.path, r.type) for r in found}
    every = {(tuple(r["keys"]), r.type) for r in K.discover_keys(variants(spark, DEEP), "v").collect()}
    assert {(("x.y",), "number"), (("x", "y"), "string"), (("",), "number")} <= every


def test_missing_value_has_no_type(spark):
    got = spark.range(1).select(R.variant_type(F.lit(None).cast("variant")).alias("t"), R.variant_type(F.parse_json(F.lit("null"))).alias("n")).first()
    assert got.t is None and got.n == "null"


def test_matching_equals_the_plain_comparison(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ab") for _ in range(draw.randrange(0, 6)))
    paths = {tuple(word() for _ in range(draw.randrange(1, 4))) for _ in range(120)}
    keys = {tuple(word() for _ in range(draw.randrange(1, 4))) for _ in range(120)}
    found = spark.createDataFrame([(list(p),) for p in paths], "keys array<string>")
    catalog = spark.createDataFrame([(list(k),) for k in keys], "parts array<string>")
    want = {(p, k) for p in paths for k in keys if len(p) == len(k) and ".".join(p) in ".".join(k)}
    for most in (1, 3):
        got = [(tuple(r.found), tuple(r.key)) for r in K.match_parts(found, catalog, most).collect()]
        assert want and set(got) == want and len(got) == len(want)


def test_matched_keys(spark):
    found = spark.createDataFrame([("nombre", ["nombre"], "string"), ("partidas.art", ["partidas", "art"], "string")], "path string, keys array<string>, type string")
    catalog = spark.createDataFrame([("renombre", "string", 3), ("partidas.array.articulo", "string", 4), ("nombre.array", "string", 1)], "key string, type string, count long")
    got = {(r.path, r.key, r.is_array, r.is_nested_depth) for r in K.match_keys(found, catalog).collect()}
    assert got == {("nombre", "renombre", False, 0), ("nombre", "nombre[]", True, 0), ("partidas.art", "partidas[].articulo", True, 1)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_discovery_at_any_depth_reads_records_once(spark):
    found = K.discover_keys(variants(spark, DEEP), "v")
    assert "parquet" not in plan_of(found)  # no level is stored and walked from there
    assert {(tuple(r["keys"]), r.type) for r in found.collect()} >= {(("a",), "array"), (("a",), "number")}


def test_equal_nodes_of_a_part_come_once(spark):
    same = variants(spark, [{"a": [1, 1, {"b": "dos"}], "n": None}] * 50).coalesce(1)
    nodes = R.walk(same, "v", [], None, whole=False, once=True).collect()
    assert sorted((r.path, r.type, r.text, r.times) for r in nodes if r.text) == [
        ("a", "number", "1", 100), ("a.b", "string", "dos", 50), ("n", "null", "null", 50)
    ]
    assert sorted((r.path, r.type, r.times) for r in nodes if not r.text) == [("a", "array", 50), ("a", "object", 50)]


def test_text_of_a_node_is_that_of_its_variant(spark):
    numbers = ["100.0", "1e5", "1.50", "12345678901234567890", "0.000001", "-0", "1e300", "-1.5E-7", "1e22", "7"]
    texts = ["true", "null", '"a\\"b\\\\ \\u00e9\\n{x}"', '""', "[]", "{}", '[1.0,[],{"z":1e5}]', '{"a b":{"\\"q":[{"z":null}]}}']
    docs = spark.createDataFrame([(f'{{"k":{v}}}',) for v in numbers + texts] + [("[1]",), ("3",), (None,)], "doc string")
    nodes = R.walk(docs.withColumn("v", F.parse_json("doc")), "v", ["doc"], 1)
    inner = F.variant_get(F.parse_json("doc"), "$.k", "variant")
    whole = F.when(R.variant_type(inner).isin("object", "array"), F.to_json(inner))
    told = F.coalesce(whole, F.try_variant_get(inner, "$", "string"), F.lit("null"))
    rows = nodes.select("doc", "type", "text", R.variant_type(inner).alias("t"), told.alias("x"), F.to_json("value").alias("a"), F.to_json(inner).alias("b")).collect()
    assert len(rows) == len(numbers + texts)
    assert [(r.type, r.text, json.loads(r.a)) for r in rows] == [(r.t, r.x, json.loads(r.b)) for r in rows]


def test_lines_are_not_sent_whole_to_the_tasks_of_their_orders(spark, tmp_path):
    day = F.lit("1996-01-02").cast("date")
    few = spark.range(3)
    few.select(F.col("id").alias("c_custkey"), F.lit("Ana").alias("c_name"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    few.select(F.col("id").alias("p_partkey"), F.lit("a").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("c").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    orders = spark.range(0, 64, 1, 1).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority"), F.lit("x" * 500).alias("o_comment"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(0, 256, 1, 1).select((F.col("id") % 64).alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"), F.lit("F").alias("l_linestatus"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = tables.order_docs(spark, str(tmp_path))
    assert docs.count() == 256
    assert "SortMergeJoin [l_orderkey" in plan_of(docs)


def test_pattern_passes_over_places_that_begin_no_trigram(spark):
    terms = ["red widget", "niño 7", "household"]
    pattern = X.necessary_pattern(terms, 0.3)
    assert pattern.startswith("(?=[")
    draw = random.Random(5)
    some = lambda: " ".join(draw.sample(["red", "widget", "niño", "7", "house", "hold", "-", "Ñu", "wide", "gadget", "azul"], 3))
    texts = [some()[draw.randrange(0, 6) :] for _ in range(200)] + terms
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    likes = [X.trigram_similarity(F.col("t"), F.lit(term)) >= 0.3 for term in terms]
    got = rows.select(X.resembles_any(F.col("t"), terms).alias("a"), (likes[0] | likes[1] | likes[2]).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and 3 < sum(r.a for r in got) < len(texts)
    assert X.necessary_pattern(["-"], 0.3) == ""


def test_records_are_parsed_once_for_their_keys(spark):
    for name in ("x2_keys_and_types", "a3_flat_catalog"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        # A filter on the number of entries would hold the parser once for every leaf.
        assert plan.count("from_json") == 1, name
