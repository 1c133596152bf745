"""Collocations against a plain count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_engine.llm import phrases

SCHEMA = "text string, lang string, n long, phrase string"


def plain(rows, least=10, share=50, limit=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        held = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang if lang is not None else "und"] += len(words)
            for size in (1, 2, 3):
                held.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [q for q in f if len(q) == 3 and f[q] >= least and len(p) == 2 and p in (q[:2], q[1:])]
            if any(100 * f[q] >= share * a for q in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def drawn(seed, n=260):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ñu", "É", "x" * 90, "\x00"]
    fixed = ["alpha beta gamma", "New York", "new york CITY", "rara avis"]
    rows = []
    for _ in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice(words[: draw.choice([4, 34])]) for _ in range(draw.randrange(0, 25))]
        rows.append((draw.choice([" ", "  ", "\t"]).join(parts).replace("w3", "w3,").replace("w5", "w5\n"), draw.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), (" .,; ", "fr")]


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 3, "p") for r in rows], SCHEMA)
    return sorted(map(tuple, phrases.mine(frame, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"limit": 7, "first_nodes": 1}, {"limit": 30, "first_nodes": 1, "least": 4, "share": 90}])
def test_equals_a_plain_count(spark, options):
    rows = drawn(8)
    want = plain(rows, **{k: v for k, v in options.items() if k != "first_nodes"})
    assert want and mined(spark, rows, **options) == want


def test_repeated_rows_ties_and_one_language(spark):
    rows = [("a b c. d e", "en")] * 10 + [("f g", "en")] * 9
    assert mined(spark, rows) == plain(rows) and {r[2] for r in mined(spark, rows)} == {"a b c", "d e"}


def test_empty_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("", "en")]) == []


def test_small_steps_and_another_hash(spark, monkeypatch):
    rows = drawn(9, 80)
    monkeypatch.setattr(phrases, "MOST_HELD", 16)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    assert mined(spark, rows, least=3) == plain(rows, least=3)
    one, two = (next(phrases.tokens(pa.array(["One two, one"]), k))[0] for k in (0, 1))
    assert one.hash[0] == one.hash[3] and two.hash[0] == two.hash[3] and one.hash[0] != two.hash[0]
    assert phrases.spelled(two, np.array([0, 1]), 1).to_pylist() == [b"one", b"two"]


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).select(phrases.cut_score(F.lit(3_000_000_000_000), F.lit(4_000_000_000_000), F.lit(5_000_000_000_001)).alias("s")).first()
    assert row.s == 1_000_000 * 3_000_000_000_000**2 // (4_000_000_000_000 * 5_000_000_000_001)


def test_bounds_are_admissible(spark):
    """No phrase of three words scores more than the bound of the pair it begins with."""
    rows = drawn(10)
    texts = spark.createDataFrame([(t or "", x or "und") for t, x in rows], "text string, lang string")
    words, attempt = phrases.count_words(texts)
    full = phrases.Filter(8, np.full(1, 255, np.uint8))
    pairs = phrases.score_pairs(phrases.count(texts, 2, attempt, (full,)).groupBy("lang", "h1", "h2").agg(F.sum("n").alias("n")), words)
    triples = phrases.count(texts, 3, attempt, (full, full)).groupBy("lang", "h1", "h2", "h3").agg(F.sum("n").alias("n"))
    scored = phrases.score_triples(triples, pairs).join(pairs.select("lang", "h1", "h2", "bound"), ["lang", "h1", "h2"])
    assert scored.count() > 100 and scored.filter("score > bound").count() == 0
