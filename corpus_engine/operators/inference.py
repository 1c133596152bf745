"""Hooks for a caller's embedding and answering functions, run in batches inside the tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 150


def hashed_words(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Word counts hashed into ``size`` places and scaled to length one: a stand-in for a model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                row[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % size] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(
    df: DataFrame,
    text: str,
    fn: Callable[[list[str]], np.ndarray],
    size: int = 768,
    attempts: int = 2,
    batch: int = BATCH,
    most_chars: int | None = None,
) -> DataFrame:
    """Adds ``embedding``: each distinct text is embedded once and joined back by md5.

    A batch that fails is tried again text by text; a text without a usable vector gets zeros. Whole texts are
    embedded; with ``most_chars`` longer ones have no vector, to be cut into chunks first. Null texts have none
    and are not joined.
    """

    def one(value: str) -> np.ndarray:
        for _ in range(attempts):
            try:
                vector = np.asarray(fn([value])[0], dtype=np.float32)
                if vector.size and vector.any():
                    return vector
            except Exception:
                continue
        return np.zeros(size, dtype=np.float32)

    def make_predict():
        def predict(texts: np.ndarray) -> np.ndarray:
            try:
                vectors = np.asarray(fn(list(texts)), dtype=np.float32)
                if vectors.shape == (len(texts), size) and vectors.any(axis=1).all():
                    return vectors
            except Exception:
                pass
            return np.stack([one(t) for t in texts])

        return predict

    vector = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    given = F.col(text) if most_chars is None else F.when(F.length(text) <= most_chars, F.col(text))
    distinct = df.select(given.alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    vectors = distinct.select(F.md5("_text").alias("_md5"), vector("_text").alias("embedding"))
    return df.withColumn("_md5", F.md5(given)).join(vectors, "_md5", "left").drop("_md5")


def respond(df: DataFrame, prompt: str, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds ``response`` and ``error``; a prompt that fails has no response, the others keep theirs."""
    schema = T.StructType([*df.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def answer(value: str) -> tuple[str | None, str | None]:
        try:
            return fn([value])[0], None
        except Exception as exc:
            return None, str(exc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            try:
                rows = [(r, None) for r in fn(prompts)]
            except Exception:
                rows = [answer(p) for p in prompts]
            yield pdf.assign(response=[r for r, _ in rows], error=[e for _, e in rows])

    return df.mapInPandas(run, schema)
