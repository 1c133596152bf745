"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader steps.

Words are runs of letters and digits, runs of other marks are words of their own, and a word equal to the one before
it is written as one fixed sign, so that repetition is an n-gram like any other. A text's score is the sparse dot
product of its hashed unigram and bigram counts, divided by the root of their number, with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.frames import extended
from corpus_engine.llm.sampling import bounded_sample, fit_shards
from corpus_engine.llm.words import BY_KIND, blocks, mix, words_of

FEATURE_BITS = 18
PER_LABEL = 4000
EPOCHS = 4
#: Steps of follow-the-regularised-leader: learning rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.5
AGAIN = np.uint64(0x5851F42D4C957F2D)
ROOM = 1 << FEATURE_BITS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and the number of the text of each; position ``ROOM`` is the intercept."""
    words = words_of(data, offsets, BY_KIND, lower=False)
    hashed, text = words.hash.copy(), words.text_of()
    same = np.zeros(len(hashed), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    hashed[same] = AGAIN
    pairs = text[1:] == text[:-1]
    both = mix(hashed[:-1] * np.uint64(3) ^ (hashed[1:] << np.uint64(1)))[pairs]
    shift = np.uint64(64 - FEATURE_BITS)
    return np.concatenate([hashed >> shift, both >> shift]).astype(np.int64), np.concatenate([text, text[1:][pairs]])


def dots(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of each text."""
    at, text = features(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    return np.bincount(text, weights[at], minlength=n) / np.sqrt(np.maximum(count, 1)) + weights[ROOM]


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the regularised leader at some positions."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_ftrl(texts: list[str], labels: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    rows = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        at, text = features(data, offsets)
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            own, count = np.unique(at[order[cuts[i] : cuts[i + 1]]], return_counts=True)
            rows.append((np.append(own, ROOM), np.append(count / np.sqrt(max(count.sum(), 1)), 1.0)))
    z, n = np.zeros(ROOM + 1), np.zeros(ROOM + 1)
    share = np.array([max((labels == v).sum(), 1) for v in (0, 1)]) / max(len(labels), 1)
    weight = 0.5 / share[labels.astype(int)]  # both labels weigh alike, however rare one is
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, x = rows[i]
            w = leader(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weight[i] * (p - labels[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return leader(z, n)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL, epochs: int = EPOCHS, seed: int = 29) -> np.ndarray:
    """Weights, the mean of those of the shards of a sample of about ``per_label`` rows of each label.

    Rows without id or label take no part; of several labels of one document the smallest counts. Without any rows
    all weights are 0, and every score is 0.5. The sample is sent to the scan of the documents: it holds at most
    about ``2 * per_label`` ids.
    """
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = bounded_sample(marked, "doc_id", "label", per_label, seed)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        w = fit_ftrl(rows.text.fillna("").tolist(), rows.label.to_numpy(dtype=np.float64), epochs, seed)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "w": [w[at].tobytes()], "rows": [len(rows)]})

    total, rows = np.zeros(ROOM + 1), 0
    for r in sorted(fit_shards(sample, "doc_id", fit, "at binary, w binary, rows long", seed), key=lambda r: (r.rows, bytes(r.w))):
        total[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.w) * r.rows
        rows += r.rows
    return total / max(rows, 1)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_score`` (0 to 1). A null or empty text has the score of the intercept alone."""
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))  # 2**FEATURE_BITS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            odds = [dots(data, offsets, held) for _, _, data, offsets in blocks(batch.column(at))]
            odds = np.clip(np.concatenate(odds) if odds else np.empty(0), -35, 35)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-odds)))], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, extended(docs, _score="double"))
