"""Joins that move little: one whose frequent keys are split over many tasks, one in which parts bring along what they meet."""

from __future__ import annotations

from functools import cache
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.session import cut_lineage

#: A part of a key holds about so many rows of each side, and so at most about their square of pairs.
PART_ROWS = 5_000
#: Frequent keys are sent to all tasks up to this number, and joined like any other table beyond.
MOST_SENT = 10_000


def frequent_keys(left: DataFrame, right: DataFrame, on: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Keys with more than ``part_rows`` rows on a side, and in how many parts each side is dealt.

    Counts are summed by task before they meet, so that a frequent key is a row per task.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = left.select(*on, one.alias("_l"), none.alias("_r")).unionByName(right.select(*on, none.alias("_l"), one.alias("_r")))
    counted = sides.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    met = counted.filter((F.greatest("_l", "_r") > part_rows) & (F.least("_l", "_r") > 0))
    parts = lambda n: F.ceil(F.col(n) / part_rows).cast("int")
    return met.select(*on, parts("_l").alias("_left_parts"), parts("_r").alias("_right_parts"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Inner join on equal keys in which no task meets more than a part of a frequent key.

    The rows of a frequent key are dealt to parts on both sides, by a hash of the row, and each part of one side is copied
    for every part of the other, so that every pair meets once. Keys that are not frequent are joined as they are.
    Null keys meet nothing. Columns that both sides have besides the keys are kept apart by their frames, as in a join.
    """
    left = left.dropna(subset=on)
    frequent = frequent_keys(left, right, on, part_rows)
    first = frequent.take(MOST_SENT + 1)
    if not first:
        return left.join(right, on)
    if len(first) <= MOST_SENT:
        frequent = F.broadcast(left.sparkSession.createDataFrame(first, frequent.schema))
    else:
        frequent = cut_lineage(frequent)

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        number = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(own)), F.lit(0)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        marked = rows.join(frequent, on, "left")
        return marked.select(*rows.columns, number.alias(mine), copies.alias(theirs))

    one = dealt(left, "_left_parts", "_right_parts", "_i", "_j")
    two = dealt(right, "_right_parts", "_left_parts", "_j", "_i")
    return one.join(two, [*on, "_i", "_j"]).drop("_i", "_j")


#: Name of the column that tells a row's part; the number of parts follows.
PART = "_part_of_"


def murmur(number: int) -> int:
    """Spark's hash of a non-negative long, by which it deals rows out."""
    word = 0xFFFFFFFF
    turned = lambda x, by: (x << by | x >> 32 - by) & word
    out = 42
    for half in (number & word, number >> 32 & word):
        out ^= turned(half * 0xCC9E2D51 & word, 15) * 0x1B873593 & word
        out = (turned(out, 13) * 5 + 0xE6546B64) & word
    out ^= 8
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        out = (out ^ out >> by) * factor & word
    out ^= out >> 16
    return out - (1 << 32) if out >> 31 else out


@cache
def part_names(parts: int) -> list[int]:
    """A number for each part that Spark deals to the task of that place, so that no task gets two parts while others get none."""
    names: dict[int, int] = {}
    for number in count():
        names.setdefault(murmur(number) % parts, number)
        if len(names) == parts:
            return [names[i] for i in range(parts)]


def part_column(df: DataFrame) -> str | None:
    """The column that tells the part of a frame's rows."""
    return next((c for c in df.columns if c.startswith(PART)), None)


def parts_worth(rows: DataFrame, others: DataFrame, part_rows: int) -> int:
    """Number of parts of about ``part_rows`` rows, as many as there are cores at least; 0 where ``others`` in every part are more than the rows."""
    n = rows.count()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // part_rows))
    return parts if parts * others.count() < n else 0


def part_of(key: str, parts: int) -> Column:
    """The part of a key, the same for every type that has the same text."""
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)) + 1
    return F.element_at(F.lit(part_names(parts)).cast("array<long>"), place.cast("int")).alias(f"{PART}{parts}")


def in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows moved to their part. Windows and groups by the part and more keys move them no further; a join would, by all its keys."""
    return rows.repartition(parts, f"{PART}{parts}")


def needed_by_parts(rows: DataFrame, others: DataFrame, key: str, on: list[str], parts: int) -> DataFrame:
    """The rows of ``others`` once for every part of ``rows`` that holds one of theirs."""
    return rows.select(part_of(key, parts), *on).dropna(subset=on).distinct().join(others, on)


def part_join(rows: DataFrame, others: DataFrame, key: str, on: list[str], parts: int) -> DataFrame:
    """Inner join of ``rows``, dealt to parts by ``key``, with ``others``, whose rows come once to each part that needs them.

    It moves less than a join by ``on`` where many rows meet few others that are large, and the rows stay with those of their
    key. Both sides are moved as one and meet in a window; the others of one key are a list. ``rows`` are read twice.
    """
    part, other = f"{PART}{parts}", [c for c in others.columns if c not in on]
    brought = needed_by_parts(rows, others, key, on, parts).select(part, *on, F.struct(*other).alias("_other"))
    both = rows.dropna(subset=on).select("*", part_of(key, parts)).unionByName(brought, allowMissingColumns=True)
    met = in_parts(both, parts).withColumn("_others", F.collect_list("_other").over(Window.partitionBy(part, *on)))
    return met.filter(F.col("_other").isNull()).select(part, *rows.columns, F.inline("_others"))


def left_lists(every: DataFrame, lists: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``every`` with the list (``column``) of their key, null where it has none; ``lists`` has one row per key.

    Lists in parts stay where they are, and ``every`` is moved there.
    """
    part = part_column(lists)
    if part is None:
        return every.join(lists, key, "left")
    parts = int(part.removeprefix(PART))
    told = in_parts(every.select(part_of(key, parts), key, F.struct(*every.columns).alias("_row")), parts)
    both = told.unionByName(lists.select(part, key, column), allowMissingColumns=True)
    own = F.first(column, ignorenulls=True).over(Window.partitionBy(part, key))
    return both.withColumn(column, own).filter(F.col("_row").isNotNull()).select("_row.*", column)
