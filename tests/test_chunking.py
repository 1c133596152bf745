"""Chunks: coverage, sizes, order."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_engine.functions import chunking as H
from corpus_engine.functions import records as R

TEXTS = ["", "a", "x" * 1000, "x" * 1001, "y" * 1800, "z" * 1801, "palabra " * 700, "ñandú. ¡Sí! " * 300]


def test_windows_cover_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = H.fixed_windows(df, "text", ["id"]).orderBy("id", "chunk_index").collect()
    for i, text in enumerate(TEXTS):
        cut = [r["text"] for r in rows if r["id"] == i]
        assert cut == [text[at : at + 1000] for at in range(0, max(len(text) - 200, min(len(text), 1)), 800)]
        assert "".join(c if n == 0 else c[200:] for n, c in enumerate(cut)) == text


words = st.lists(st.text("abc é.\n,", min_size=0, max_size=40), max_size=40).map("\n\n".join)


@settings(max_examples=150, deadline=None)
@given(words, st.integers(20, 120), st.integers(0, 15))
def test_split_keeps_sizes_and_every_character(text, size, overlap):
    chunks = H.split_text(text, size, overlap, H.ADAPTIVE_SEPARATORS)
    assert all(0 < len(c) <= size for c in chunks)
    at = 0
    for chunk in chunks:
        at = text.index(chunk, max(0, at - size))
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_overlap_repeats_the_end(spark):
    assert H.split_text("aa bb cc dd", 6, 3, [" ", ""]) == ["aa bb", "bb cc", "cc dd"]


def test_short_pieces_join_a_neighbour_or_stay():
    long, pieces = "l" * 60, ["corto", "l" * 60, "fin", "m" * 55, "cola"]
    assert H.join_short(pieces, 70) == [f"corto {long} fin", "m" * 55 + " cola"]
    assert H.join_short(pieces, 63) == ["corto", long, "fin " + "m" * 55, "cola"]
    assert H.join_short(pieces, 65, legacy=True) == [long + " fin", "m" * 55 + " cola"]
    assert H.join_short(["solo"], 100) == ["solo"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=90), max_size=30))
def test_joining_short_pieces_loses_nothing(pieces):
    joined = H.join_short(pieces, 100)
    assert "".join(joined).replace(" ", "") == "".join(pieces) and all(len(p) <= 100 for p in joined)


def test_sentences_keep_their_marks(spark):
    text = "Uno dos. ¿Tres? ¡Cuatro! Cinco seis siete ocho"
    assert H.sentence_runs(text, 16) == ["Uno dos. ¿Tres?", "¡Cuatro!", "Cinco seis siete ocho"]
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(H.sentence_chunks(F.col("t"), F.lit(40))).first()[0] == [text]
    assert len(df.select(H.sentence_chunks(F.col("t"), F.lit(16))).first()[0]) == 3


def test_adaptive_pieces_match_the_helper(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "id int, text string, lang string")
    rows = H.adaptive_chunks(df, "text", "lang", ["id"]).orderBy("id", "chunk_index").collect()
    for r in rows:
        assert len(r["text"]) <= r["size"] + 1
    assert {r["id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7}
    kept = H.adaptive_chunks(df.filter("id = 1"), "text", "lang", ["id"], legacy=True)
    assert kept.count() == 0


def test_pieces_of_a_batch_are_handed_on_in_parts(spark):
    texts = pd.Series(["a" * 600, None, "", "b" * 5000, "c" * 10, "d" * 10])
    parts = list(H.parts_of(texts, 2000))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(6))
    assert len(parts) == 3 and parts[1] == slice(3, 4)  # a long text alone
    assert list(H.parts_of(pd.Series([], dtype=object))) == [slice(0, 0)]


def test_chunks_of_many_parts_stay_with_their_row(spark):
    docs = spark.range(900).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("x"), F.col("id"), F.lit(" "), F.repeat(F.lit("una palabra. "), 300))).alias("t")).coalesce(1)
    cut = docs.select("id", "t", H.separator_chunks(F.col("t"), F.lit(400), F.lit(0), H.PLAIN_SEPARATORS).alias("p"), R.text_leaves(F.concat(F.lit('{"k": "'), "t", F.lit('"}'))).alias("leaf"))
    for row in cut.collect():
        assert "".join(row.p).replace(" ", "") == (row.t or "").replace(" ", "")
        assert [e.value for e in row.leaf or []] == ([row.t] if row.t else [])
