"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_engine.llm import decontam, graph, hashing_search, html_extract, jaccard_join, language_id, licence_scan, line_dedup, mixing, quality, warc
from corpus_engine.llm import words as W
from corpus_engine.session import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, component_id long, target double"


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, 7, 0.5, 99, 1.0) for r in rows], DOCS)


A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [
    (1, A, "en", "a"),
    (2, A.upper(), "en", "a"),
    (3, A + " seventeen", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, "Kurz", "de", "b"),
    (7, "kurz", None, "c"),
    (None, A, "en", "c"),
    (8, "\t \n", "en", "c"),
    (9, "Kurz Kurz", "de", "c"),
    (10, "x" * 300_000, "en", "c"),
]


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["Aa b\tC\x0bd  e f", None, "", "É é", "a b a b a b a b"]
    _, _, data, offsets = next(W.blocks(pa.array(texts)))
    found = W.words_of(data, offsets)
    assert found.counts().tolist() == [6, 0, 0, 2, 8]
    sets, first = W.shingle_sets(found, 5)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 2]
    same = W.words_of(*[(d, o) for _, _, d, o in W.blocks(pa.array(["zzz", "aa B c D e F"]))][0])
    assert (same.hash[1:] == found.hash[:6]).all()


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_blocks_cover_all_rows(size):
    import pyarrow as pa

    column = pa.array(["ab", None, "", "cdefg", "h"] * 3).slice(2, 9)
    parts = list(W.blocks(column, size))
    assert [p[0] for p in parts] + [9] == [0] + [p[1] for p in parts]
    assert b"".join(p[2].tobytes() for p in parts).decode() == "".join(x or "" for x in column.to_pylist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 200), (None, 1)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1
    assert len(set(got.values())) == 3 and len(got) == 41 + 60 + 1
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_edges(spark):
    out = sorted(jaccard_join.link_documents(docs_of(spark, ROWS)).collect(), key=lambda r: (r.doc_id or 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got[1] == got[2] == (12, 1) and got[3] == (13, 1) and got[None] == (12, 1)
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[8] == (0, 8)
    assert got[6] == (1, 6) and got[7] == (1, 6) and got[9] == (1, 9)
    assert jaccard_join.link_documents(docs_of(spark, [])).count() == 0
    assert jaccard_join.link_documents(docs_of(spark, ROWS + ROWS)).count() == 2 * len(ROWS)


def test_jaccard_links_through_chains_and_large_groups(spark):
    """Copies with other words in other places: links run along chains, and not every pair is one."""
    draw, rows = np.random.default_rng(4), []
    for family in range(3):
        base = [f"w{family}_{i}" for i in range(60)]
        for i in range(60):
            text = list(base)
            for at in draw.choice(60, size=draw.integers(0, 4), replace=False):
                text[at] = f"x{family}_{i}_{at}"
            rows.append((len(rows), " ".join(text), "en", "a"))
    from tests.llm.test_queries import components_by_brute_force

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs_of(spark, rows)).collect()}
    assert got == components_by_brute_force({r[0]: r[1] for r in rows})


def test_matches_and_prefixes():
    assert jaccard_join.choose_matches(np.zeros(20, np.int64), 5) == 1
    heavy = np.array([0] * 5 + [500] * 15)
    assert jaccard_join.choose_matches(heavy, 4) == 1  # one rare token, then only common ones
    assert jaccard_join.choose_matches(np.array([900, 0, 0, 0, 0, 0]), 0) > 1  # more rare tokens make the common one harmless
    assert jaccard_join.choose_matches(np.array([3]), 0) == 1


def test_jaccard_looks_at_whole_lists_without_moving_rows(spark):
    """The lists are dealt by token and split once, when they are written."""
    name, key = "lists_of_a_test", "spark.sql.autoBroadcastJoinThreshold"
    tokens = spark.createDataFrame([(t, -1, c, 20, 1, t % 5) for t in range(40) for c in range(t % 4)], "token long, split long, class_id long, n long, matches long, place long")
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        lists = jaccard_join.listed(tokens, 75, name)
        rows = jaccard_join.led(lists.withColumn("root", F.col("class_id")), [F.xxhash64("class_id")]).filter("low <> high")
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert {r.token: (r.low, r.high) for r in rows.collect()} == {t: (0, t % 4 - 1) for t in range(40) if t % 4 > 1}
    finally:
        spark.conf.set(key, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_line_dedup_edges(spark):
    rows = [
        (2, "  Same Line here \nshort\nown line of two", "en", "a"),
        (1, "x\nsame line HERE", "en", "a"),
        (3, "SAME LINE here\n same line here", "en", "a"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (None, "same line here\nkept", "en", "a"),
        (6, "twice in one\ntwice in one\r\nshort", "en", "a"),
        (6, "own line of two", "en", "a"),
    ]
    out = line_dedup.dedup_lines(docs_of(spark, rows))
    assert set(DOCS.replace(",", "").split()[::2]) <= set(out.columns)
    got = sorted((r.doc_id or 0, r.text, r._n_lines, r._n_dropped) for r in out.collect() if r.text is not None)
    assert got == sorted([
        (2, "short\nown line of two", 3, 1), (1, "x\nsame line HERE", 2, 0), (3, "", 2, 2), (5, "", 1, 0),
        (0, "same line here\nkept", 2, 0), (6, "twice in one\ntwice in one\r\nshort", 3, 0), (6, "", 1, 1),
    ])
    assert [r._n_lines for r in out.filter("text IS NULL").collect()] == [1]
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_does_not_hang_on_the_filter(spark, documents):
    """A filter far too small suspects more and drops the same."""
    small = line_dedup.dedup_lines(documents, filter_bits=64).select("doc_id", "text")
    assert small.exceptAll(line_dedup.dedup_lines(documents).select("doc_id", "text")).count() == 0


def test_line_filter_holds_what_two_documents_hold(spark, documents, monkeypatch):
    """Bit by bit, with few places held at a time and merges of two rows."""
    monkeypatch.setattr(line_dedup, "PLACES", 50)
    monkeypatch.setattr(line_dedup, "FAN_IN", 2)
    bits, times = 1 << 21, np.zeros(1 << 21, dtype=int)
    rows = documents.select("doc_id", "text")
    for r in rows.collect():
        own = [k for k in set(line_dedup.line_keys(r.text, 10)) if k]
        if own:
            times[np.unique(line_dedup.places(own, bits))] += 1
    assert (times > 1).any()
    assert np.array_equal(line_dedup.build_filter(rows.repartition(7), 10, bits), np.packbits(times > 1))
    n = sum((r.text or "").count("\n") + 1 for r in rows.collect())
    assert line_dedup.filter_bits_for(rows) >= line_dedup.LINE_BITS * n


def test_mixing_edges(spark):
    out = mixing.mix(docs_of(spark, ROWS + ROWS[:3]))
    rows = out.collect()
    assert len(rows) == len(ROWS) + 3 and out.columns == ["doc_id", "size", "source_size", "target", "copies", "taken"]
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [(1, None, None, None)])).collect()] == [0]


@pytest.mark.parametrize("rows,fan", [(64, 4), (5, 2)])
def test_mixing_tree_keeps_the_words(spark, rows, fan):
    data = [(i, "w " * (1 + i * 7 % 23), "en", "s" + str(i % 4 if i % 3 else 0)) for i in range(400)]
    out = mixing.mix(docs_of(spark, data), group_rows=rows, fan_in=fan).toPandas()
    for (_, target), part in out.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - target) <= 23
    wide = mixing.materialise(docs_of(spark, data), mixing.mix(docs_of(spark, data), group_rows=rows, fan_in=fan))
    assert wide.count() == out.copies.sum()


def test_language_edges(spark):
    data = [(i, t, lang, "a") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    docs = docs_of(spark, data)
    model = language_id.train(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, [(1, "the dog", None, None), (2, "die katze und der hund", "en", None), (3, None, None, None), (4, "123 !", None, None), (5, "", None, None)]), model).collect()}
    assert [got[i]._lang for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[3]._score == 0
    nothing = language_id.train(docs_of(spark, [(1, "a", None, None)]), "doc_id", "text", "lang")
    assert [r._lang for r in language_id.identify(docs.limit(1), nothing).collect()] == ["und"]
    single = language_id.train(docs.filter("lang = 'en'"), "doc_id", "text", "lang")
    assert [(r._lang, r._score) for r in language_id.identify(docs.limit(1), single).collect()] == [("en", 1.0)]
    assert language_id.identify(docs_of(spark, []), model).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 20])
def test_codewords_tell_classes_apart(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code}) == (n if n > 1 else 1)
    if n > 5:
        assert ((code.shape[1] - code @ code.T) / 2)[~np.eye(n, dtype=bool)].min() >= 3  # one wrong bit is put right


def test_quality_edges(spark):
    docs = docs_of(spark, [(i, "good plain words here" if i % 2 else "## !! ## !!", "en", "a") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    weights = quality.train(docs, labels)
    new = docs_of(spark, [(1, "plain good words", None, None), (2, "!! ##", None, None), (3, None, None, None), (4, "", None, None)])
    got = {r.doc_id: r._score for r in quality.score(new, weights).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]
    none = quality.train(docs, labels.limit(0))
    assert [r._score for r in quality.score(docs.limit(1), none).collect()] == [0.5]
    assert quality.score(docs_of(spark, []), weights).count() == 0


def test_search_edges(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (50, [1e-300, 1e-300]), (None, [1.0, 1.0]), (50, [1e-300, 1e-300])]
    table = spark.createDataFrame([(*r, 1, 0.0) for r in data], "vec_id long, embedding array<double>, rank int, score double")
    got = {}
    for r in hashing_search.nearest(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert [v for v, _ in got[0]] == [1, 3, 50, 2] and got[50][0][0] in (1, 2) and len(got[50]) == 4
    assert hashing_search.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hashing_search.nearest(table.filter("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_is_exact_with_a_full_radius():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, 12))
    codes = hashing_search.learn_codes(x, 5)
    ids = np.arange(300)
    q, v, s = hashing_search.search_segment(x, ids, x[:4], ids[:4], codes, codes.bits, 5)
    cos = hashing_search.unit(x) @ hashing_search.unit(x).T
    for i in range(4):
        order = [j for j in np.argsort(-cos[i]) if j != i][:5]
        assert v[q == i].tolist() == order and np.allclose(s[q == i], cos[i][order])


def test_decontam_edges(spark):
    item = "the quick brown fox jumps over a lazy dog near the old river bank today"
    edited = "THE quick, brown cat jumps over a very lazy dog near the river bank today!"
    docs = docs_of(spark, [(1, f"start {item} end", "en", "a"), (2, f"w w w {edited} z", "en", "a"), (3, "the quick brown and nothing else", "en", "a"), (4, None, None, None), (None, item, None, None), (5, "", None, None), (1, f"start {item} end", "en", "a")])
    items = spark.createDataFrame([(7, item), (8, "two words"), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.copies(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[1, 7].score == 1.0 and (got[1, 7].first_word, got[1, 7].last_word) == (1, 15)
    assert 0.6 < got[2, 7].score < 1 and got[2, 7].first_word == 3
    assert decontam.copies(docs, items.limit(0)).count() == 0 and decontam.copies(docs.limit(0), items).count() == 0


def test_decontam_finds_edited_copies_beside_exact_ones(spark):
    """Against Smith-Waterman of every item and document: edited copies share other seeds than the exact one does."""
    draw, item = np.random.default_rng(6), [f"w{i}" for i in range(24)]
    rows, n = [(0, " ".join(item))], 0

    def add(words):
        nonlocal n
        n += 1
        rows.append((n, " ".join(["a", "b", *words, "c"])))

    edited = list(item)
    for i, at in enumerate([3, 5, 8, 10, 13, 15, 18, 20, 22][::-1]):  # runs of 3, 2, 3, 2, ... words
        edited.insert(at, f"x{i}")
    for _ in range(5):
        add(edited)
    add(item[:3] + [w for i, word in enumerate(item[3:]) for w in (f"y{i}", word)])  # nearly twice as long
    for k in range(20):
        words = list(item)
        for i in range(draw.integers(0, 9)):
            words.insert(draw.integers(0, len(words)), f"z{k}z{i}")
        add(words)
    docs, items = docs_of(spark, [(*r, "en", "a") for r in rows]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: round(r.score * 48) for r in decontam.copies(docs, items).collect()}
    number = {w: i for i, w in enumerate({w for _, t in rows for w in t.split()})}
    scores = {i: decontam.align(np.array([number[w] for w in item]), np.array([number[w] for w in t.split()]))[0] for i, t in rows}
    assert got == {i: s for i, s in scores.items() if s >= 24} and got[1] == 39 and len(got) == len(rows)


def test_alignment_matches_plain_dynamic_programming():
    draw = np.random.default_rng(2)
    for _ in range(30):
        a, b = draw.integers(0, 4, 8), draw.integers(0, 4, 12)
        h = np.zeros((9, 13), dtype=int)
        for i in range(1, 9):
            for j in range(1, 13):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b)[0] == h.max()


def test_licence_edges(spark):
    mit = "Released under the MIT License."
    rows = [("r/LICENSE", mit), ("r/a/x.py", "nothing here"), ("r/a/b/y.py", "# Licensed under the Apache License, Version 2.0."), ("r/a/b/z.py", None), ("q/x.py", ""), (None, "no path"), ("LICENSE.txt", "words only"), ("r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("r/a/b/c/d/e.py", "plain")]
    docs = spark.createDataFrame([(*r, "l", 0.0) for r in rows], "path string, text string, licence string, cosine double")
    got = {r.path: (r._licence, r._effective, r._inherited_from) for r in licence_scan.inherit(licence_scan.scan(docs)).collect()}
    assert got["r/LICENSE"] == ("MIT", "MIT", None) and got["r/a/b/y.py"] == ("Apache-2.0", "Apache-2.0", None)
    assert got["r/a/x.py"] == got["r/a/b/z.py"] == got["r/a/b/c/d/e.py"] == (None, "GPL-3.0", "r/a/COPYING")
    assert got["q/x.py"] == got[None] == got["LICENSE.txt"] == (None, None, None)
    assert licence_scan.inherit(licence_scan.scan(docs.limit(0))).count() == 0


def test_licence_notices_among_other_words(spark):
    """Within a line, within a text without line ends, and where only the wording of one licence tells it."""
    mit, other = "Released under the MIT License.", " ".join(f"plain{i}" for i in range(400))
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    rows = [f"one two three {mit} four five six", f"{other} {mit} {other}", f"{other} {gpl.format(2)} {other}", f"x {gpl.format(3)} y", other, "Released under"]
    rows += ["of this and that", "and this of that"] * 50
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in licence_scan.scan(docs).collect()}
    assert [got[i]._licence for i in range(7)] == ["MIT", "MIT", "GPL-2.0", "GPL-3.0", None, None, None]
    assert all(abs(got[i]._cosine - 1) < 1e-9 for i in range(4))


LONG = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
BSD = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
NEITHER = "Neither the name of Example Inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING'
#: Notices of licences that differ from their relatives in few words; None where no such licence is known.
RELATIVES = [
    (LONG.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0"),
    (LONG.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1"),
    (LONG.format("library", ":", "Lesser ", ",", "3"), "LGPL-3.0"),
    (LONG.format("program", ":", "", ",", "3"), "GPL-3.0"),
    (LONG.format("program", ";", "", ";", "2"), "GPL-2.0"),
    (LONG.format("program", ":", "Affero ", ",", "4"), None),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("Licensed under CC BY-NC-ND 4.0.", "CC-BY-NC-ND-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("Licensed under CC BY-NC 2.5.", None),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("All rights reserved.", None),
    (f"{BSD}\n\n{AS_IS}", "BSD-2-Clause"),
    (f"{BSD}\n\n{NEITHER}\n\n{AS_IS}", "BSD-3-Clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
]


def test_licences_are_not_taken_for_their_relatives(spark, documents):
    """Alone, and among other words on one line; other documents are the background."""
    other = " ".join(f"plain{i}" for i in range(30))
    rows = [(-1 - i, text) for i, (notice, _) in enumerate(RELATIVES) for text in (notice, f"{other} {notice} {other}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    got = {}
    for r in licence_scan.scan(docs).filter("doc_id < 0").collect():
        got.setdefault(-1 - r.doc_id, set()).add(r._licence)
    wrong = {notice: (got[i], name) for i, (notice, name) in enumerate(RELATIVES) if got[i] != {name}}
    assert not wrong


def test_licence_weights_of_other_words(spark):
    """Words that no template holds weigh by the documents that hold them."""
    import pyarrow as pa

    docs = spark.createDataFrame([(f"often w{i} w{i}",) for i in range(50)], "text string")
    templates = licence_scan.Templates.of({"a": ["some notice"]})
    found, sketch, n = licence_scan.word_counts(docs, templates)
    templates.weigh(found, sketch, n, 0.7)
    hashed = decontam.plain_words(*next(W.blocks(pa.array(["often w7 never"])))[2:]).hash
    often, once, never = templates.weights(hashed, templates.places(hashed))
    assert n == 50 and not found.any() and np.allclose([often, once, never], [1, np.log(51 / 2) + 1, np.log(51) + 1])


def test_extraction_edges(spark):
    pages = [
        (1, "<nav><a href='/'>Home</a></nav><article><h1>T &amp; t</h1><p>One  two\n three &eacute; &lt;b&gt;.</p><p>Four.<div class='ad'>Buy now</div><p>Five six.</article><section id=comments><p>I think so too, very much indeed.</p></section>"),
        (2, None),
        (3, ""),
        (4, "<script>var a = '<p>no</p>'"),
        (5, "<p>Only one paragraph of plain text in this page, without any other markup around it.</p>"),
        (6, "<div>" * 3000 + "<p>deep text that stands far down in the tree of this page</p>"),
        (7, "<article><p>cut in the mid"),
        (8, "<article><p>" + "long text here " * 50_000 + "</p></article>"),
    ]
    table = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, html string, text string")
    got = {r.page_id: r._text for r in html_extract.extract(table).collect()}
    assert got[1] == "T & t\n\nOne two three é <b>.\n\nFour.\n\nFive six."
    assert got[2] == got[3] == got[4] == "" and got[5].startswith("Only one") and got[7] == "cut in the mid"
    assert len(got[8]) == 15 * 50_000 - 1
    assert html_extract.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("inner", ["<svg-icon name=x></svg-icon>", "<video-player src='a>b'/>", "<select-menu>", "<title-bar>", "<svg width='1'/>", "<MATH />", "<svg/>", "<svg><path d='x'/>no</svg>", "<svg a='/'>no</svg >", "<script>'<p>no</p>'</script>"])
def test_text_after_custom_and_self_closed_elements(inner):
    page = html_extract.parse(f"<p>a</p>{inner}<p>b</p><p>c</p>")
    assert [b.text for b in page.blocks] == ["a", "b", "c"]


def test_marginals_are_exact():
    """Against the sum over all states of a small tree."""
    from itertools import product

    model = html_extract.train()
    page = html_extract.parse("<div class=post><p>A few words here.</p><ul><li><a>x</a></li></ul></div><footer>end</footer>")
    parent, group = [*page.parent, *(b.node for b in page.blocks)], [*page.group, *["run"] * len(page.blocks)]
    own = [model.seen.get(("hint", h), (1, 1)) for h in page.hint]
    for b in page.blocks:
        seen = [model.seen.get(f, (1.0, 1.0)) for f in html_extract.seen_of(b)]
        own.append(tuple(float(np.prod([f[s] ** html_extract.TEXT_WEIGHT for f in seen])) for s in (0, 1)))
    total, kept = 0.0, np.zeros(len(page.blocks))
    for states in product((0, 1), repeat=len(parent)):
        p = 1.0
        for i, s in enumerate(states):
            p *= own[i][s] * model.edge[group[i]][states[parent[i]] if parent[i] >= 0 else html_extract.PAGE][s]
        total += p
        kept += p * np.array(states[len(page.parent) :])
    assert np.allclose(kept / total, html_extract.marginals(page, model))


def test_warc_round_trip_and_revisits(spark):
    big = "ä" * 700_000
    rows = [("a", "http://x/ ü\r\n", big), ("b", None, big), ("c", "u", None), ("d", "u", ""), ("e", "u", "tail\r\n\r\nWARC/1.1\r\n"), ("f", "u", "tiny")]
    table = spark.createDataFrame(rows, "id string, uri string, body string")
    folder = shared_folder(spark)
    files = warc.archive(table, F.col("id"), F.col("record_id"), F.col("uri"), F.col("body"), folder, least_bytes=1, chunk_bytes=100_000)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    chunks = warc.read_archives(spark, files, chunk_bytes=65_536).collect()
    got = {}
    for r in sorted(chunks, key=lambda r: (r.record_id, r.chunk_no)):
        got.setdefault(r.record_id, []).append(r)
    assert all(len(r.data or b"") <= 65_536 for r in chunks) and len(got["a"]) > 20
    for name, _, body in rows:
        raw, last = (body or "").encode(), got[name][-1]
        assert last.last and last.payload_bytes == len(raw)
        if last.record_type == "response":
            assert b"".join(bytes(r.data) for r in got[name]) == raw and last.payload_digest == last.stated_digest
            assert last.payload_digest == warc.base32_of(hashlib.sha1(raw))
    assert [got[k][-1].record_type for k in "abcdef"] == ["response", "revisit", "response", "response", "response", "response"]
    assert got["b"][0].refers_to == "a" and got["b"][0].payload_digest == got["a"][-1].payload_digest
    light = warc.read_archives(spark, files, with_data=False).select("record_id", "payload_digest")
    assert light.count() == len(rows)
    empty = warc.archive(table.limit(0), F.col("id"), F.col("record_id"), F.col("uri"), F.col("body"), shared_folder(spark))
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_reads_plain_and_cut_streams():
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    rows = list(warc.records_of(io.BytesIO(record * 2), 3))
    assert [bytes(r["data"]) for r in rows] == [b"hel", b"lo"] * 2 and rows[1]["last"] and rows[1]["payload_bytes"] == 5
    cut = list(warc.records_of(io.BytesIO(record[:-7]), 3))
    assert not cut[-1]["last"]
