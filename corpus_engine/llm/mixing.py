"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken ``target / source size`` times. The whole part is taken outright; the
fraction is rounded so that the words of the source stay near the target: two fractional documents meet, words
move at random from one to the other until one of the two is settled, and the other goes on. What moves is
counted in words, so a pair keeps its expected words exactly, and each document keeps its own expectation.

The documents of a source are dealt by hash into groups of bounded size, so a hot source is split. Each group
leaves at most one fractional document; these meet in the next level of a reduction tree, until one is left for
each source, which is rounded by its own probability. A source therefore misses its target by one document at most.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.llm.frames import stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SETTLED = 1e-9
ROWS = "row_id long, doc_id long, size long, source_no long, bucket long, base long, p double, source_size long, target double"


def numbered(sources: DataFrame, name: str) -> DataFrame:
    """``source_no``: position from 0 by code point, null last, without bringing all sources to one task."""
    place = F.monotonically_increasing_id()
    sorted_ = stored(
        sources.repartitionByRange(F.col(name).asc_nulls_last())
        .sortWithinPartitions(F.col(name).asc_nulls_last())
        .withColumns({"part": F.shiftright(place, 33), "at": place.bitwiseAND((1 << 33) - 1)})
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    return sorted_.join(F.broadcast(parts), "part").withColumn("source_no", F.col("ahead") + F.col("at")).drop("part", "ahead", "at")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES
) -> DataFrame:
    """Of each source: ``source, source_no, source_size, held, weight, target``.

    The targets share ``share`` times all words by weight; one that reaches ``most_copies`` times its source stops
    there and the rest is shared anew. Only sums come to the driver, one pair for each round of sharing.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("held"))
    totals = numbered(totals, "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    totals = stored(totals.withColumn("weight", weight))
    cap = F.col("source_size") * F.lit(most_copies)
    words = totals.agg(F.sum("source_size")).first()[0] or 0
    share_of_weight, full = 0.0, -1
    while True:
        below = F.col("weight") * F.lit(share_of_weight) < cap
        got = totals.agg(
            F.sum(F.when(below, F.col("weight"))).alias("weight"),
            F.sum(F.when(~below, F.col("source_size"))).alias("words"),
            F.count(F.when(~below, 1)).alias("full"),
        ).first()
        if not got.weight or got.full == full:
            break
        full = got.full
        share_of_weight = (share * words - most_copies * (got.words or 0)) / got.weight
    return totals.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(share_of_weight))))


def settle(rows: pd.DataFrame, last: bool, seed: int) -> pd.DataFrame:
    """Rounds the fractions of one group; at most one stays open, none in the ``last`` level."""
    # Large documents first: what stays open at the end is then a small one.
    rows = rows.sort_values(["size", "row_id", "doc_id"], ascending=[False, True, True], na_position="first").reset_index(drop=True)
    draw = np.random.default_rng([seed, int(rows.source_no.iloc[0]), int(rows.bucket.iloc[0]), len(rows)])
    luck, p, size = draw.random(len(rows) + 1).tolist(), rows.p.tolist(), rows["size"].tolist()
    open_ = -1
    for i in range(len(p)):
        if not SETTLED < p[i] < 1 - SETTLED:
            p[i] = float(round(p[i]))
        elif open_ < 0:
            open_ = i
        else:
            j, a, b = open_, size[i], size[open_]
            up, down = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
            moved = up if luck[i] * (up + down) < down else -down
            p[i], p[j] = p[i] + moved / a, p[j] - moved / b
            for k in (i, j):
                if not SETTLED < p[k] < 1 - SETTLED:
                    p[k] = float(round(p[k]))
            open_ = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    if last and open_ >= 0:
        p[open_] = float(luck[-1] < p[open_])
    return rows.assign(p=p)


def level(last: bool, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: settle(rows, last, seed)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: float = MOST_COPIES,
    group_rows: int = 2048,
    fan_in: int = 1024,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row of ``docs``.

    A null text has no words and is taken 0 words; a null source is a source, the last one; null ids are rows like
    others. Repeated rows are rounded each for itself. A source without words has target 0. An empty table gives an
    empty result. Other columns of ``docs`` play no part. The same rows give the same result in any order.
    """
    sized = stored(
        docs.select(
            F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("row_id"),
            F.col(doc_id).cast("long").alias("doc_id"),
            word_count(F.col(text)).alias("size"),
            F.col(source).cast("string").alias("source"),
        )
    )
    targets = source_targets(sized, weights, share, most_copies).select(
        F.col("source").alias("name"), "source_no", "source_size", "target", "held"
    )
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups: Column = F.ceil(F.col("held") / group_rows)
    rows = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("name")))
        .withColumns({"base": F.floor(times + SETTLED), "bucket": F.pmod(F.shiftright("row_id", 8), groups)})
        .withColumn("p", F.greatest(times - F.col("base"), F.lit(0.0)))
    )
    columns = [c.split()[0] for c in ROWS.split(", ")]
    idle = (F.col("size") == 0) | (F.col("p") <= SETTLED)
    done = [rows.filter(idle).withColumn("p", F.lit(0.0)).select(columns)]
    most = targets.agg(F.max(groups)).first()[0] or 0
    open_ = rows.filter(~idle).select(columns)
    while most:
        last = most == 1
        out = stored(open_.groupBy("source_no", "bucket").applyInPandas(level(last, seed), ROWS))
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.filter(~is_open))
        open_ = out.filter(is_open).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        most = 0 if last else -(-most // fan_in)
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    copies = (F.col("base") + F.col("p")).cast("long")
    return settled.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def materialise(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; ids must be unique."""
    taken = mixed.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    return (
        docs.join(taken, F.col(doc_id) == F.col("_id"))
        .withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
        .drop("_id", "_copies", "_copy")
    )
