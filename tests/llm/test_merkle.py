"""The Merkle manifest against a plain one, its edges, and single requests."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpus_engine.llm import merkle, queries
from corpus_engine.llm.ranking import ranked

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Levels from the leaves to the one node that is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, at):
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield run[: at % 8], run[at % 8 + 1 :]
        at //= 8


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        ranked = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf_of(r))))
        trees[g] = ranked, climb([leaf_of(r) for r in ranked])
    top = climb([trees[g][1][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        ranked, levels = trees[g]
        for at, r in enumerate(ranked):
            path = [*path_of(levels, at), *path_of(top, k)]
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            node = leaf_of((*r[:4], text)) if odd else leaf_of(r)
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            siblings = sha("".join(x for left, right in path for x in [*left, *right]))
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0], siblings, node, node == top[-1][0]))
    return sorted(out, key=str)


def through(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).withColumn("group", F.lit(1)).withColumn("rank", F.lit("r")).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, queries.op12_merkle(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, "de": 1}, {"en": 64, "de": 65, None: 8, "": 2}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_equals_a_plain_tree(spark, tmp_path, sizes):
    rows = [(i, f"s{i % 3}" if i % 4 else None, lang, None if i % 5 == 0 else i, None if i % 7 == 0 else f"Text Ä{i}\n") for lang, n in sizes.items() for i in range(n)]
    assert through(spark, rows, tmp_path) == plain(rows)


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 11 + [(3, "a", "en", 1, "Same")] * 20 + [(3, "a", "en", 1, "Other"), (4, "a", "en", 0, ""), (4, "a", "EN", 0, "x" * 200_000)]
    assert through(spark, rows, tmp_path) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert through(spark, [], tmp_path) == []


def test_single_requests_and_stored_records(spark):
    rows = spark.range(600).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"))
    manifest = merkle.build(rows, merkle.leaf_digest([F.col("id")]), F.col("g"), F.col("id"))
    assert [r.count() for r in manifest.lower.records] == [75, 12, 3]
    asked = manifest.rows.filter("row.id IN (0, 77, 599)")
    for r in merkle.prove(manifest, asked).select("row.id", "leaf", "found", merkle.folded(F.col("leaf"), F.col("path")).alias("root"), F.size("path").alias("n")).collect():
        assert r.root == manifest.root and r.leaf == r.found and r.n == 4


def test_ranks_are_spread_and_without_gaps(spark):
    rows = spark.range(2_000).select((F.col("id") % 2).alias("g"), F.lit(7).alias("same"))
    out = ranked(rows, F.when(F.col("g") > 0, "big"), [F.col("same")])
    for key, part in out.toPandas().groupby("g"):
        assert sorted(part._rank) == list(range(1_000)) and set(part._last) == {999} and part._group.nunique() == 1
