"""Bounded samples of labelled rows, and models fitted on shards of them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sample is dealt to as many shards of about so many rows as it fills, up to the most.
SHARD_ROWS = 400
MOST_SHARDS = 16


def bounded_sample(rows: DataFrame, key: str, label: str, per_label: int, seed: int) -> DataFrame:
    """About ``per_label`` rows of each value of ``label``, chosen by hash of ``key``; rows without either take no part.

    Only the counts of the labels come to the driver; a label with fewer rows is taken whole.
    """
    rows = rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    luck = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(rate)
    return rows.filter(luck < rate)


def fit_shards(sample: DataFrame, key: str, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str, seed: int) -> list:
    """``fit`` on each shard, its rows sorted by ``key``; what the shards return comes to the driver."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return fit(rows.sort_values(key, kind="stable").reset_index(drop=True))

    shards = max(1, min(sample.count() // SHARD_ROWS, MOST_SHARDS))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(shards))
    return sample.withColumn("_shard", shard).groupBy("_shard").applyInPandas(run, schema).collect()
