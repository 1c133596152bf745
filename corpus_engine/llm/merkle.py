"""A Merkle manifest of a dataset: a tree per group, a root over the trees, and proofs by descent through records.

Leaves are digests of rows in order of their key; every ``FAN_OUT`` consecutive nodes become one, until one is left
per group (its subroot); subroots are joined in the same way. What is stored is content-addressed: records of a node's
digest and its children's, by height. A request for a leaf descends from the root: the digits of its rank, to the
base of the fan-out, choose a child at each record, the children not chosen are collected, and the path is reversed
at the end. Requests that share leading digits are one row until they part, so the root's record meets one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.frames import stored
from corpus_engine.llm.ranking import ranked

FAN_OUT = 8
PATH = "array<struct<left: binary, right: binary>>"


def digest(text: Column) -> Column:
    """SHA-256 of a text, as bytes."""
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def joined(digests: Column) -> Column:
    """Digests as hex text, one after the other."""
    return F.array_join(F.transform(digests, hexed), "")


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: of each value ``-`` if it is null, else its length in UTF-8 bytes, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


@dataclass
class Tree:
    """Nodes above the leaves of all groups.

    ``records[h - 1]`` maps the digests at height ``h`` to their children; ``tops`` holds (group, height, digest), the
    one node that is left of each group.
    """

    records: list[DataFrame]
    tops: DataFrame


def grow(leaves: DataFrame) -> Tree:
    """Trees over leaves of (group, rank, last, digest): ranks from 0 without gaps, ``last`` the last of the group."""
    longest = leaves.agg(F.max("last")).first()[0] or 0
    records, level = [], leaves
    tops = leaves.filter("last = 0").select("group", F.lit(0).alias("height"), "digest")
    while longest > 0:
        child = F.struct((F.col("rank") % FAN_OUT).alias("at"), "digest")
        runs = level.filter("last > 0").groupBy("group", F.shiftright("rank", 3).alias("rank"))
        runs = runs.agg(F.shiftright(F.max("last"), 3).alias("last"), F.array_sort(F.collect_list(child)).alias("run"))
        runs = runs.select("group", "rank", "last", F.transform("run", lambda c: c.digest).alias("children"))
        level = stored(runs.withColumn("digest", digest(joined(F.col("children")))))
        records.append(level.select("digest", "children"))
        tops = tops.unionByName(level.filter("last = 0").select("group", F.lit(len(records)).alias("height"), "digest"))
        longest >>= 3
    return Tree(records, stored(tops))


def chosen(path: Column, children: Column, at: Column) -> Column:
    """``path`` with what is left and right of child ``at``."""
    left = F.unhex(joined(F.slice(children, F.lit(1), at)))
    right = F.unhex(joined(F.slice(children, at + 2, F.lit(FAN_OUT))))
    return F.concat(path, F.array(F.struct(left.alias("left"), right.alias("right"))))


def descend(tree: Tree, start: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``path``, from the root down to their leaf, and ``found``, the digest that stands there.

    ``start`` holds (group, height, digest, path) of the groups' tops, ``requests`` the columns group and rank; requests
    beyond a group's last rank find nothing.
    """
    height = len(tree.records)
    digit = F.col("rank").bitwiseAND(FAN_OUT - 1).cast("int")
    prefixes, last = [], requests.select("group", "rank")
    for _ in range(height):
        last = last.select("group", F.shiftright("rank", 3).alias("rank")).distinct()
        prefixes.append(last)

    def at_height(h: int) -> DataFrame:
        return start.filter(F.col("height") == h).select("group", F.lit(0).cast("long").alias("prefix"), "digest", "path")

    def opened(frontier: DataFrame, h: int) -> DataFrame:
        # Equal subtrees have one digest and one record.
        records = tree.records[h - 1].groupBy("digest").agg(F.first("children").alias("children"))
        return frontier.join(records, "digest").drop("digest")

    frontier = at_height(height)
    for h in range(height, 1, -1):
        wanted = prefixes[h - 2].select(F.col("group").alias("g"), "rank")
        met = opened(frontier, h).join(wanted, (F.col("g") == F.col("group")) & (F.shiftright("rank", 3) == F.col("prefix")))
        met = met.filter(digit < F.size("children"))
        below = met.select("group", F.col("rank").alias("prefix"), F.col("children")[digit].alias("digest"), chosen(F.col("path"), F.col("children"), digit).alias("path"))
        frontier = below.unionByName(at_height(h - 1))
    # Where a group is one leaf, its top is the leaf: one child, and nothing beside it.
    alone = at_height(0).select("group", "prefix", "path", F.array("digest").alias("children"), F.lit(True).alias("alone"))
    if height:
        alone = alone.unionByName(opened(frontier, 1).withColumn("alone", F.lit(False)))
    nodes = alone.select(F.col("group").alias("g"), "prefix", F.col("path").alias("above"), "children", "alone")
    met = requests.join(nodes, (F.col("g") == F.col("group")) & (F.shiftright("rank", 3) == F.col("prefix"))).filter(digit < F.size("children"))
    path = F.when(F.col("alone"), F.col("above")).otherwise(chosen(F.col("above"), F.col("children"), digit))
    return met.withColumn("path", path).withColumn("found", F.col("children")[digit]).drop("g", "prefix", "above", "children", "alone")


@dataclass
class Manifest:
    """``rows`` holds (row, leaf, group, rank, last): the dataset's rows as structs, their digests and places.

    ``subroots`` holds (of, height, digest, group, rank, last): the subroot of group ``of`` and its place as a leaf of the
    ``upper`` tree. ``root`` is None where there are no rows.
    """

    rows: DataFrame
    lower: Tree
    upper: Tree
    subroots: DataFrame
    root: str | None


def build(rows: DataFrame, leaf: Column, group: Column, order: Column) -> Manifest:
    """The manifest of ``rows``: leaves ascend by ``order`` (null first, then by digest) within ``group``, groups by value.

    Repeated rows are leaves of their own. A null group comes before the others; text is ordered by its UTF-8 bytes.
    All columns travel with the leaves, under any names, so leave out those that no proof needs. An empty table has
    no root and no proofs.
    """
    packed = rows.select(F.struct(*rows.columns).alias("row"), leaf.alias("leaf"), group.alias("of"), order.alias("at"))
    placed = ranked(packed, F.col("of"), [F.col("at").asc_nulls_first(), F.col("leaf")])
    placed = placed.select("row", "leaf", F.col("_group").alias("group"), F.col("_rank").alias("rank"), F.col("_last").alias("last"))
    lower = grow(placed.select("group", "rank", "last", F.col("leaf").alias("digest")))
    subroots = ranked(lower.tops.withColumnRenamed("group", "of"), F.lit(0), [F.col("of")])
    subroots = stored(subroots.select("of", "height", "digest", F.col("_group").alias("group"), F.col("_rank").alias("rank"), F.col("_last").alias("last")))
    upper = grow(subroots.select("group", "rank", "last", "digest"))
    top = upper.tops.select(hexed(F.col("digest"))).first()
    return Manifest(placed, lower, upper, subroots, top[0] if top else None)


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``requests`` (some of ``manifest.rows``; all by default) with ``subroot``, ``path`` and ``found``.

    ``path`` holds what stands left and right of the node at each level, from the leaf to the root; ``found`` is the
    digest that the descent came to.
    """
    requests = manifest.rows if requests is None else requests
    root = manifest.upper.tops.withColumn("path", F.array().cast(PATH))
    groups = requests.select(F.col("group").alias("of")).distinct()
    above = descend(manifest.upper, root, manifest.subroots.join(groups, "of", "left_semi"))
    start = stored(above.select(F.col("of").alias("group"), "height", "digest", "path"))
    found = descend(manifest.lower, start, requests)
    tops = start.select(F.col("group").alias("of"), F.col("digest").alias("subroot"))
    return found.join(tops, F.col("of") == F.col("group")).drop("of").withColumn("path", F.reverse("path"))


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings as hex text, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s.left), hexed(s.right))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, hexed(leaf), lambda node, s: F.sha2(F.concat(hexed(s.left), node, hexed(s.right)), 256))
