"""Every query of the training-data operators over the small tables, against SQL or a brute-force form."""

import math
import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest

import __spark_entry__ as driver
from corpus_engine.llm import queries
from tests.conftest import SMALL
from tests.harness import differences


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert not differences(queries.QUERIES[name](spark, SMALL), con, queries.ORACLES[name])


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) <= set(driver.queries()) and "pipeline" in driver.queries()


def components_by_brute_force(texts, words=5, percent=75):
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op3_components(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_jaccard(spark, SMALL).collect()}
    assert got == components_by_brute_force(texts)


def test_op2_text_of_articles(spark):
    rows = queries.op2_html(spark, SMALL).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        assert r.n_chars == len(r.text) and "track(" not in r.text and "&middot;" not in r.text
        title = re.search("<h1>(.*?)<", html[r.page_id], re.S)
        assert r.text.split("\n\n")[0] == " ".join(unescape(title[1]).split())


def test_op4_ranks_labels(spark):
    out = queries.op4_quality(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").toPandas()
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert good.median() > bad.median()


def test_op5_finds_licence_lines(spark, texts):
    out = {r.doc_id: r for r in queries.op5_licences(spark, SMALL).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    held = {(i, name) for i, t in texts.items() for line, name in lines.items() if line in t.split("\n")}
    assert held and all(out[i].licence == name and out[i].effective == name for i, name in held)
    assert len(out) == len(texts)


def test_op6_finds_every_whole_copy(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.score for r in queries.op6_decontam(spark, SMALL).collect()}
    held = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t}
    assert held <= set(got) and all(got[k] == 1.0 for k in held)
    assert len(got) < 2 * len(held) + 10


def test_op7_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    out = queries.op7_language(spark, SMALL).join(lang, "doc_id").toPandas()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.9


def test_op8_recall(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    unit, ids = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in queries.op8_nearest(spark, SMALL).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    found = wanted = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        score[i] = -9
        best = set(ids[np.lexsort((ids, -score))[:5]])
        found, wanted = found + len(best & {v for v, _ in got[ids[i]]}), wanted + 5
        assert len(got[ids[i]]) == 5 and all(abs(score[list(ids).index(v)] - s) < 1e-12 for v, s in got[ids[i]])
    assert found >= 0.9 * wanted


def test_op10_targets_and_bounds(spark, texts):
    out = queries.op10_mixing(spark, SMALL).toPandas()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out["source"] = out.doc_id.map(source)
    assert len(out) == len(texts) and all(len(t.split()) == s for t, s in ((texts[i], s) for i, s in zip(out.doc_id, out["size"])))
    size = out.groupby("source")["size"].sum().to_dict()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    target, open_ = {}, set(size)
    while open_:
        rest = 1.5 * sum(size.values()) - sum(target.values())
        full = {s for s in open_ if rest * weight[s] / sum(weight[t] for t in open_) > 2 * size[s]}
        if not full:
            target |= {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    for s, part in out.groupby("source"):
        assert math.isclose(part.target.iloc[0], target[s], rel_tol=1e-9) and (part.source_size == size[s]).all()
        assert abs(part.taken.sum() - target[s]) <= part["size"].max()
    assert (out.taken <= 2 * out["size"]).all()
    again = queries.op10_mixing(spark, SMALL).toPandas()
    assert Counter(zip(out.doc_id, out.taken)) == Counter(zip(again.doc_id, again.taken))
