"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a logistic model over hashed byte n-grams of the whole text tells
on which side of it the text's language lies. Decoding weighs the loss of each bit by how often that bit was right
for that language on rows kept from fitting, and takes the codeword with the smallest weighted loss. A text whose two
nearest codewords lie close together is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.frames import extended
from corpus_engine.llm.sampling import bounded_sample, fit_shards
from corpus_engine.llm.words import LOWER, blocks

UNDETERMINED = "und"
FEATURE_BITS = 12
PER_LANGUAGE = 1500
ROUNDS = 80
BLOCK_ROWS = 256
AMBIGUOUS = 0.1


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """One row of +1 and -1 per class: every split of up to five classes, else the best of many random codes."""
    if n <= 5:
        columns = [[1 if c == 0 or (b >> (c - 1)) & 1 else -1 for c in range(n)] for b in range(2 ** max(n - 1, 0) - 1)]
        return np.array(columns, dtype=np.float64).reshape(2 ** max(n - 1, 0) - 1, n).T
    draw, best, apart = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], size=(n, bits))
        near = (code @ code.T)[~np.eye(n, dtype=bool)].max()
        balanced = np.abs(code.sum(axis=0)).max() < n
        if balanced and (bits - near) / 2 > apart:
            best, apart = code, (bits - near) / 2
    return best


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of square-rooted counts of hashed byte bigrams and trigrams, A-Z in lower case."""
    n, size = len(offsets) - 1, 1 << FEATURE_BITS
    text = LOWER[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * size, np.diff(offsets))
    out = np.zeros(n * size)
    for length, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(text) < length:
            continue
        code = text[: len(text) - length + 1].copy()
        for k in range(1, length):
            code |= text[k : len(text) - length + 1 + k] << np.uint32(8 * k)
        code = ((code ^ (code >> np.uint32(13))) * np.uint32(salt)) >> np.uint32(32 - FEATURE_BITS)
        own = row[: len(code)] == row[length - 1 :]
        out += np.bincount((row[: len(code)] + code)[own], minlength=n * size)
    out = np.sqrt(out.reshape(n, size))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offsets in blocks(column, block_rows=BLOCK_ROWS):
        yield ngram_features(data, offsets)


def fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, decay: float = 1e-4) -> np.ndarray:
    """Weights (last row: intercept) of one logistic model per column of ``y``, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = ahead = np.zeros((x.shape[1], y.shape[1]))
    step, t = 2.0, 1.0
    for _ in range(rounds):
        grad = x.T @ (-y / (1 + np.exp(np.clip(y * (x @ ahead), -50, 50)))) / len(x) + decay * ahead
        new, t_new = ahead - step * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, ahead, t = new, new + (t - 1) / t_new * (new - w), t_new
    return w


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest codeword, its score, and the lead over the second in score."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        bits = np.logaddexp(0, -self.code[None, :, :] * margin[:, None, :])
        loss = (bits * self.trust[None, :, :]).sum(axis=2) * self.code.shape[1]
        score = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score /= score.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        own = score[np.arange(len(x)), best]
        score[np.arange(len(x)), best] = -1
        return best, own, own - np.maximum(score.max(axis=1), 0)


def train(labelled: DataFrame, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE, seed: int = 23) -> Model:
    """Fits on a sample of about ``per_language`` rows of each language; rows without id or language take no part."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.length("text") > 0)
    sample = bounded_sample(rows, "doc_id", "lang", per_language, seed)
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    code = codewords(len(languages))
    if code.shape[1] == 0:
        return Model(languages, code, np.zeros(((1 << FEATURE_BITS) + 1, 0)), np.zeros(code.shape))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(list(features(pa.array(rows.text, pa.string()))))
        y = code[[languages.index(v) for v in rows.lang]]
        test = np.arange(len(x)) % 4 == 3
        w = fit_bits(x[~test], y[~test])
        right = np.sign(x[test] @ w[:-1] + w[-1]) == y[test]
        which = np.array([languages.index(v) for v in rows.lang])[test]
        hits = np.array([right[which == c].sum(axis=0) for c in range(len(languages))], dtype=np.float64)
        seen = np.array([(which == c).sum() for c in range(len(languages))], dtype=np.float64)
        return pd.DataFrame({"w": [w.tobytes()], "hits": [hits.tobytes()], "seen": [seen.tobytes()], "rows": [len(x)]})

    got = fit_shards(sample, "doc_id", fit, "w binary, hits binary, seen binary, rows long", seed)
    got.sort(key=lambda r: (r.rows, bytes(r.w)))
    shape = ((1 << FEATURE_BITS) + 1, code.shape[1])
    weights = sum(np.frombuffer(r.w).reshape(shape) * r.rows for r in got) / sum(r.rows for r in got)
    hits = sum(np.frombuffer(r.hits).reshape(code.shape) for r in got)
    seen = sum(np.frombuffer(r.seen) for r in got)
    trust = (hits + 1) / (seen[:, None] + 2)
    return Model(languages, code, weights, trust / trust.sum(axis=1, keepdims=True))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_lang``, ``_score`` (0 to 1), ``_ambiguous``.

    Texts that are null, empty or without a letter are ``und`` with score 0, and so is every text if nothing was
    learned. Ties go to the first language by code point. An empty table gives an empty result.
    """
    at = docs.columns.index(text)
    rows = docs.withColumn("_letters", has_letter(F.col(text)))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # (2**FEATURE_BITS + 1) x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            found = [held.decode(x) for x in features(batch.column(at))] if held.languages else []
            best, score, lead = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.ones(batch.num_rows))
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & bool(held.languages)
            names = np.array([*held.languages, UNDETERMINED], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(names[np.where(known, best, len(held.languages))], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(known & (lead < AMBIGUOUS)),
                ],
                names=[*batch.schema.names[:-1], "_lang", "_score", "_ambiguous"],
            )

    schema = extended(docs, _lang="string", _score="double", _ambiguous="boolean")
    return rows.mapInArrow(run, schema)
