"""Large JSON lists and quoted CSV in ranges, against the readers of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpus_engine.sources import ranges as G
from corpus_engine.sources import readers as R

TEXTS = ["", "a,b", 'x"y', "back\\", "\\\\", '\\"', "[1,{", "}]", "línea\nnueva", "é,ñ,日", "  ", "no, [sí]"]


@pytest.fixture(params=[53, 1 << 27])
def small_ranges(spark, request):
    for key, value in (("spark.sql.files.maxPartitionBytes", request.param), ("spark.sql.files.openCostInBytes", 1)):
        spark.conf.set(key, str(value))
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def drawn(draw, deep=3):
    kind = draw.randrange(6 if deep else 4)
    if kind < 2:
        return draw.choice(TEXTS)
    if kind < 4:
        return draw.choice([1, -2.5, None, True, 1e10])
    if kind == 4:
        return [drawn(draw, deep - 1) for _ in range(draw.randrange(4))]
    return {draw.choice(TEXTS) + str(i): drawn(draw, deep - 1) for i in range(draw.randrange(4))}


def found(entries):
    rows = entries.select(F.element_at(F.split("path", "/"), -1).alias("f"), "entry_index", F.to_json("entry").alias("e")).collect()
    return sorted((r.f, r.entry_index, json.dumps(json.loads(r.e))) for r in rows)


def test_lists_in_ranges_equal_whole_files(spark, tmp_path, small_ranges):
    draw = random.Random(5)
    for i in range(6):
        listed = [drawn(draw) for _ in range(draw.randrange(1, 30))]
        (tmp_path / f"list{i}.json").write_text(json.dumps(listed, indent=draw.choice([None, 1]), ensure_ascii=i % 2 == 0))
    (tmp_path / "object.json").write_text(json.dumps({"a": [1, 2, {"b": "c,d"}], "e": ",]"}))
    for name, text in {
        "empty.json": "[]", "blank.json": " \n", "spaced.json": " \n [ 1 , [2,3] ] \n\n", "text.json": '"a,b"', "number.json": "5",
        "cut.json": '[{"a": 1}, {"b": ', "tail.json": "[1, 2] x", "comma.json": "[1, 2],", "two.json": "[1], [2]", "hole.json": "[1,,2]",
        "last.json": "[1,2,]", "open.json": '["a, b', "deep.json": "[[1,2]", "close.json": "[1]]", "mixed.json": "[1]{}",
    }.items():
        (tmp_path / name).write_text(text)
    want, broken = R.read_json_entries(spark, str(tmp_path))
    got, bad = G.read_json_ranges(spark, str(tmp_path))
    assert found(got) == found(want) and len(found(want)) > 30
    assert {r.path for r in bad.collect()} == {r.path for r in broken.select("path").collect()}


def test_quoted_csv_in_ranges_equals_whole_files(spark, tmp_path, small_ranges):
    draw = random.Random(6)
    cell = lambda: draw.choice(["1", "dos", 'a "b"', "x,y", "línea\nnueva", "\n", "NA", "", '"', "é"])
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set('",\n') else c
    for i in range(3):
        rows = [["id", "nombre", "nota larga"], *[[cell() for _ in range(3)] for _ in range(30)], ["solo"], ["a", "b", "c", "d"]]
        (tmp_path / f"{i}.csv").write_text("\n".join(",".join(map(quoted, r)) for r in rows) + "\n" * (i % 2))
    want, ragged = R.read_csv_rows(spark, str(tmp_path))
    got, odd = G.read_csv_ranges(spark, str(tmp_path))
    assert got.columns == want.columns
    whole = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == whole and len(whole) >= 85
    lines = lambda df: sorted(r.line for r in df.select("line", "cells").collect())
    assert lines(odd) == lines(ragged)


def test_another_header_is_handed_on(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n3,4\n")
    got, odd = G.read_csv_ranges(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("1", "2")]
    assert sorted(r.line for r in odd.collect()) == ["3,4", "x,z"]


def test_a_large_list_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "large.json", "w") as out:
        out.write("[" + ", ".join(json.dumps({"i": i, "t": "x, [\"" * (i % 7)}) for i in range(60_000)) + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        got, bad = G.read_json_ranges(spark, str(tmp_path))
        assert G.pieces(spark, str(tmp_path), ",").select("start").distinct().count() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = got.select("entry_index", F.variant_get("entry", "$.i", "long").alias("i"), F.length(F.variant_get("entry", "$.t", "string")).alias("n"))
    row = out.agg(F.count("*").alias("n"), F.count_if(F.col("i") == F.col("entry_index")).alias("same"), F.sum("n").alias("chars")).first()
    assert tuple(row) == (60_000, 60_000, sum(len("x, [\"") * (i % 7) for i in range(60_000))) and bad.count() == 0
