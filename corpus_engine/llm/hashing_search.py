"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample turn vectors into binary codes. A code is cut into substrings, and the rows are
dealt by hash into segments of bounded size that index each substring. By the pigeonhole principle a code within
``radius`` of a query's has a substring within ``radius // substrings`` of the query's substring: probing the buckets
that near retrieves every such code of the segment. Codes within the radius are reranked by the cosine of the
original vectors. The radius is learned on the sample as well; queries that find too few codes are asked again with
twice the radius, in the end with one that holds every code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.frames import stored

BITS = 128
SUBSTRINGS = 8
SAMPLE_ROWS = 4096
SEGMENT_ROWS = 2048
QUERY_ROWS = 4096
ROTATION_ROUNDS = 15
REACH = 0.99
HIT = "query_id long, vec_id long, score double"
POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


@dataclass
class Codes:
    """``project`` maps vectors to values whose signs are the bits; ``radius`` holds most nearest neighbours."""

    project: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.project.shape[1]

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """The 16-bit substrings of the code of each vector."""
        packed = np.packbits(unit @ self.project > 0, axis=1)
        return packed.view(np.uint16).reshape(len(unit), -1)


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector takes part: not null, neither empty nor zero, all components finite, of the table's size."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.size(vector) == size if size else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & fits & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    out = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    most = np.abs(out).max(axis=1, keepdims=True) if len(out) else out
    odd = (most < 1e-100) | (most > 1e100)  # whose squares would leave the range of a double
    return np.where(odd, out / np.where(most > 0, most, 1), out) if odd.any() else out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learn_codes(sample: np.ndarray, k: int, bits: int = BITS, seed: int = 3) -> Codes:
    """Rotations of the principal axes that bring the sample's values near to signs, and the radius that reaches
    the ``k`` nearest of the sample's own rows in ``REACH`` of the cases."""
    x, draw = unit(sample), np.random.default_rng(seed)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(bits, x.shape[1])]
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        v = x @ axes
        rotation = np.linalg.qr(draw.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(ROTATION_ROUNDS):
            left, _, right = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
            rotation = (left @ right).T
        parts.append(axes @ rotation)
    codes = Codes(np.hstack(parts)[:, :bits], bits)
    asked = x[:: max(1, len(x) // 256)][:256]
    near = asked @ x.T
    near[near > 1 - 1e-9] = -2  # itself and its copies, which any radius finds
    best = np.argsort(-near, axis=1)[:, :k]
    apart = POPCOUNT[codes.encode(asked)[:, None, :] ^ codes.encode(x)[best]].sum(axis=2)
    codes.radius = int(np.quantile(apart, REACH)) if apart.size else bits
    return codes


def search_segment(base: np.ndarray, base_ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, codes: Codes, radius: int, k: int):
    """The ``k`` best rows within the radius of each query, as (query, row, score) arrays."""
    base_code, asked_code = codes.encode(unit(base)), codes.encode(unit(asked))
    subs = base_code.shape[1]
    index = [np.unique(base_code[:, s], return_inverse=True) for s in range(subs)]
    base_norm, asked_norm = np.linalg.norm(base, axis=1), np.linalg.norm(asked, axis=1)
    within, out = radius // subs, []
    for q in range(len(asked)):
        found = np.zeros(len(base), dtype=bool)
        for s, (values, bucket_of) in enumerate(index):
            found |= (POPCOUNT[values ^ asked_code[q, s]] <= within)[bucket_of]
        found &= base_ids != asked_ids[q]
        rows = np.flatnonzero(found)
        rows = rows[POPCOUNT[base_code[rows] ^ asked_code[q]].sum(axis=1) <= radius]
        if len(rows):
            score = (base[rows] * asked[q]).sum(axis=1) / (base_norm[rows] * asked_norm[q])
            best = np.lexsort((base_ids[rows], -score))[:k]
            out.append((np.full(len(best), asked_ids[q]), base_ids[rows[best]], score[best]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def probe(base: DataFrame, asked: DataFrame, codes: Codes, radius: int, k: int, segments: int, batches: int, schema: str = HIT) -> DataFrame:
    """What each segment finds for each query; base and asked: vec_id, vector. Neither pairs nor groups grow with
    the table: a task meets one segment with one batch of queries, both of bounded size."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("segment", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(segments)).cast("int")).withColumn("batch", every(batches))
    right = asked.withColumn("batch", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(batches)).cast("int")).withColumn("segment", every(segments))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        else:
            found = search_segment(
                matrix(rows["vector"]), rows["vec_id"].to_numpy(), matrix(queries["vector"]), queries["vec_id"].to_numpy(), codes, radius, k
            )
        return pa.table(found, names=["query_id", "vec_id", "score"])

    return left.groupBy("segment", "batch").cogroup(right.groupBy("segment", "batch")).applyInArrow(run, schema)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", bits: int = BITS, sample_rows: int = SAMPLE_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query row its ``k`` nearest found among all other rows, by cosine.

    Rows without an id, and vectors that are null, zero, hold a null or non-finite component or differ in length from
    the most frequent length (ties: the longer) take no part. Of several rows with one id the smallest vector counts.
    Ties go to the smaller id. An empty table, or one without queries, gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == sizes["size"])
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    n, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    luck = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(luck < min(1.0, sample_rows / max(n, 1))).select("vec_id", "vector").toArrow().sort_by("vec_id")
    if not asking or not sample.num_rows:
        sample = rows.orderBy("vec_id").limit(sample_rows).select("vec_id", "vector").toArrow()
    codes = learn_codes(matrix(sample["vector"]), k, bits)
    base, asked = rows.select("vec_id", "vector"), rows.filter("asks").select("vec_id", "vector")
    segments, batches = max(1, -(-n // segment_rows)), max(1, -(-asking // QUERY_ROWS))
    wanted, radius, found = min(k, n - 1), codes.radius, None
    while True:
        hits = stored(probe(base, asked, codes, radius, k, segments, batches))
        if radius >= codes.bits:
            full = hits
            found = full if found is None else found.unionByName(full)
            break
        enough = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= wanted).select("query_id")
        full = hits.join(enough, "query_id", "left_semi")
        found = full if found is None else found.unionByName(full)
        asked = asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti")
        left = asked.count()
        if not left:
            break
        radius, batches = min(2 * radius + 1, codes.bits), max(1, -(-left // QUERY_ROWS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
