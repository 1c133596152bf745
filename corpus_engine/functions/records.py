"""Nested records: leaves in record order, variant nodes and their types."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_engine.functions.chunking import parts_of
from corpus_engine.functions.text import NO_VALUE, bind, clean_value, label

LEAF = "struct<path: string, key: string, type: string, value: string>"


def leaf_type(dtype: T.DataType, legacy: bool) -> str:
    """Type name of a leaf; ``legacy`` calls booleans integers and fractions unknown."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "integer" if legacy else "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    return "unknown" if legacy else "number"


class Path(NamedTuple):
    """Where a leaf is: with positions, with ``array`` in their place, and as a label."""

    path: Column
    key: Column
    label: Column


def member(at: Path | None, name: str) -> Path:
    spaced = name.replace("_", " ")
    if at is None:
        return Path(F.lit(name), F.lit(name), F.lit(spaced.capitalize()))
    tail = F.lit(f".{name}")
    return Path(F.concat(at.path, tail), F.concat(at.key, tail), F.concat(at.label, F.lit(f".{spaced.lower()}")))


def element(at: Path, i: Column) -> Path:
    place = F.concat(F.lit("."), i.cast("string"))
    return Path(F.concat(at.path, place), F.concat(at.key, F.lit(".array")), F.concat(at.label, place))


def each_leaf(
    record: Column,
    schema: T.StructType | str,
    make: Callable[[Path, T.DataType, Column], Column],
    kind: str,
) -> Column:
    """``make`` applied to every leaf of a record of known schema, in record order, as ``array<kind>``."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    empty = F.array().cast(f"array<{kind}>")

    def visit(value: Column, dtype: T.DataType, at: Path | None) -> Column:
        if isinstance(dtype, T.StructType):
            below = [visit(value.getField(f.name), f.dataType, member(at, f.name)) for f in dtype.fields]
            return F.concat(*below)
        if isinstance(dtype, T.ArrayType):
            inner = F.transform(value, lambda x, i: visit(x, dtype.elementType, element(at, i)))
            return F.coalesce(F.flatten(inner), empty)
        return F.array(make(at, dtype, value))

    return visit(record, schema, None)


def leaf_text_value(value: Column, dtype: T.DataType) -> Column:
    """Text of a leaf: booleans as ``True``, fractions with all their digits and no exponent."""
    text = value.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.initcap(text)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        digits = F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
        return F.when(F.abs(value).between(1e7, 1e18), digits).otherwise(text)
    return text


def leaves(record: Column, schema: T.StructType | str, legacy: bool = False) -> Column:
    """Leaves of a record of known schema, in record order.

    ``path`` has list positions as segments, ``key`` has ``array`` in their place. Empty lists and
    records give nothing; a missing value keeps its leaf, of type ``null`` (``unknown`` in legacy).
    """
    missing = "unknown" if legacy else "null"

    def make(at: Path, dtype: T.DataType, value: Column) -> Column:
        kind = F.when(value.isNull(), missing).otherwise(leaf_type(dtype, legacy))
        text = leaf_text_value(value, dtype)
        return F.struct(at.path.alias("path"), at.key.alias("key"), kind.alias("type"), text.alias("value"))

    return each_leaf(record, schema, make, LEAF)


class Written(str):
    """A number as the JSON text writes it."""


def found_leaves(text: str | None) -> list[tuple[str, str, str, str | None]] | None:
    """Path, key, type and value of every leaf of a JSON text, in its order; None if it is no JSON."""
    try:
        root = json.loads(text or "", parse_int=Written, parse_float=Written)
    except (ValueError, RecursionError):
        return None
    out, open_ = [], [("", "", root)]
    while open_:
        path, key, value = open_.pop()
        if isinstance(value, dict):
            inside = [(f"{path}.{k}" if path else k, f"{key}.{k}" if key else k, v) for k, v in value.items()]
            open_ += reversed(inside)
        elif isinstance(value, list):
            inside = [(f"{path}.{i}" if path else str(i), f"{key}.array" if key else "array", v) for i, v in enumerate(value)]
            open_ += reversed(inside)
        elif isinstance(value, Written):
            out.append((path, key, "integer" if re.fullmatch(r"-?\d+", value) else "number", str(value)))
        elif isinstance(value, str):
            out.append((path, key, "string", value))
        else:
            out.append((path, key, "null" if value is None else "boolean", None if value is None else str(value)))
    return out


def text_leaves(text: Column) -> Column:
    """Leaves of a JSON text of any shape, in the order of its keys, numbers as written; null if it is no JSON.

    Leaves are handed on by a part of an Arrow batch, so that Python never holds those of a whole one.
    """

    @F.pandas_udf(f"array<{LEAF}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("path", "key", "type", "value")
        for texts in batches:
            for part in parts_of(texts):
                rows = (found_leaves(t) for t in texts.iloc[part])
                yield pd.Series([None if r is None else [dict(zip(names, x)) for x in r] for r in rows], dtype=object)

    return run(text)


def leaves_text(leaf: Column) -> Column:
    """``Label: value`` lines of leaves, without those that mean nothing."""

    def line(e: Column) -> Column:
        return F.concat(label(e["path"]), F.lit(": "), e["value"])

    return F.array_join(F.transform(clean_leaves(leaf), line), "\n")


def keys_and_types(leaf: Column) -> Column:
    """Distinct keys with their type; the first leaf of a key decides."""
    pairs = F.array_distinct(
        F.transform(leaf, lambda e: F.struct(e["key"].alias("key"), e["type"].alias("type")))
    )

    def first_of_key(found: Column) -> Column:
        return bind(
            F.transform(found, lambda e: e["key"]),
            lambda keys: F.filter(found, lambda e, i: F.array_position(keys, e["key"]) == i + 1),
        )

    return bind(pairs, first_of_key)


def clean_leaves(leaf: Column) -> Column:
    """Leaves whose cleaned value means something, with that value."""
    cleaned = F.transform(leaf, lambda e: F.struct(e["path"].alias("path"), clean_value(e["value"]).alias("value")))
    return F.filter(cleaned, lambda e: e["value"] != NO_VALUE)


def record_text(record: Column, schema: T.StructType | str) -> Column:
    """``Label: value`` lines of a record, empty leaves left out.

    Labels come from the schema; only texts need cleaning, numbers are written as they are.
    """

    def make(at: Path, dtype: T.DataType, value: Column) -> Column:
        text = leaf_text_value(value, dtype)
        if isinstance(dtype, T.StringType):
            text = F.nullif(clean_value(value), F.lit(NO_VALUE))
        return F.concat(at.label, F.lit(": "), text)

    lines = each_leaf(record, schema, make, "string")
    return F.array_join(F.array_compact(lines), "\n")


def row_text(columns: list[str]) -> Column:
    """``Label: value`` lines of a flat row, every column kept."""
    lines = [F.concat(label(F.lit(c)), F.lit(": "), clean_value(F.col(c))) for c in columns]
    return F.array_join(F.array(*lines), "\n")


# JSON type names by the start of a variant's schema; every other schema is a number.
JSON_TYPES = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def variant_type(v: Column) -> Column:
    """One of string, number, boolean, array, object, null; no type where there is no value at all."""
    names = F.create_map(*[F.lit(x) for pair in JSON_TYPES.items() for x in pair])
    named = F.coalesce(F.element_at(names, F.substring_index(F.schema_of_variant(v), "<", 1)), F.lit("number"))
    return F.when(v.isNotNull(), named)


def members(v: Column) -> Column:
    """Key to value map of an object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def elements(v: Column) -> Column:
    """Elements of an array, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def object_entries(df: DataFrame, record: str, keep: list[str]) -> DataFrame:
    """One row per key of a JSON object, with the type of its value."""
    out = df.select(*keep, F.explode(members(F.col(record))).alias("key", "value"))
    return out.withColumn("type", variant_type(F.col("value")))


NODE_COLUMNS = "keys array<string>, type string, text string, unopened boolean, times long"


#: Compact JSON of values without ``Written`` numbers.
compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def as_written(value: object) -> str:
    """Compact JSON of a value whose ``Written`` numbers are as they were written."""
    if isinstance(value, dict):
        return "{" + ",".join([f"{compact(k)}:{as_written(v)}" for k, v in value.items()]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([as_written(v) for v in value]) + "]"
    return str(value) if isinstance(value, Written) else compact(value)


def json_nodes(text: str, keys: dict, max_depth: int | None, of_lists: bool, whole: bool) -> list[tuple]:
    """``(number of its keys, type, text, unopened)`` of every node below the root of a JSON text.

    ``keys`` numbers lists of keys as (number of the list before, last key). The root counts if it is an object, or a list
    where ``of_lists`` says so. Strings have their bare text, other nodes that of the JSON, containers only if ``whole``.
    """
    odd = []

    def fraction(digits: str) -> float | Written:
        number = float(digits)
        if repr(number) == digits:
            return number
        odd.append(digits)
        return Written(digits)

    root = json.loads(text, parse_float=fraction)
    whole_text = as_written if odd else compact
    out, open_ = [], [(root, 0, 1)] if isinstance(root, (dict, list) if of_lists else dict) else []
    while open_:
        value, under, depth = open_.pop()
        if type(value) is dict:
            inside = [(keys.setdefault((under, k), len(keys)), v) for k, v in value.items()]
        else:
            inside = [(under, v) for v in value]
        for key, v in inside:
            kind = type(v)
            if kind is str:
                out.append((key, "string", v, False))
            elif kind is int or kind is float or kind is Written:
                out.append((key, "number", str(v), False))
            elif kind is dict or kind is list:
                stopped = depth == max_depth
                out.append((key, "object" if kind is dict else "array", whole_text(v) if whole else None, stopped and bool(v)))
                if not stopped:
                    open_.append((v, key, depth + 1))
            elif v is None:
                out.append((key, "null", "null", False))
            else:
                out.append((key, "boolean", "true" if v else "false", False))
    return out


def nodes_table(texts: list[str | None], max_depth: int | None, of_lists: bool, whole: bool, once: bool) -> tuple[list[int], pa.Table]:
    """The nodes of some records as columns, and which record each is of; equal ones but once if ``once``."""
    keys, rows, nodes = {None: 0}, [], []
    times = Counter()
    for i, text in enumerate(texts):
        found = json_nodes(text, keys, max_depth, of_lists, whole) if text else []
        if once:
            times.update(found)
        else:
            nodes += found
            rows += [i] * len(found)
    nodes = list(times) if once else nodes
    counts = list(times.values()) if once else [1] * len(nodes)
    lists = []
    for at in keys:  # in the order of their numbers, so the list before is there
        lists.append([*lists[at[0]], at[1]] if at else [])
    number, kind, text, unopened = zip(*nodes) if nodes else ((), (), (), ())
    return rows, pa.table({
        "keys": pa.array(lists, pa.list_(pa.string())).take(pa.array(number, pa.int32())),
        "type": pa.array(kind, pa.string()),
        "text": pa.array(text, pa.string()),
        "unopened": pa.array(unopened, pa.bool_()),
        "times": pa.array(counts, pa.int64()),
    })


def walk(
    df: DataFrame,
    record: str,
    keep: list[str],
    max_depth: int | None = 8,
    under: str | None = None,
    whole: bool = True,
    once: bool = False,
) -> DataFrame:
    """Every node below the root of a variant record: ``keys``, ``path``, ``value``, ``type``, ``text``, ``times``.

    An object appends its key to the keys, an array element keeps those of its array; ``path`` is the keys with dots
    between them, to read, while ``keys`` tells a key with a dot from a key inside another. A record is read once, as JSON,
    whatever its depth, and nothing is shuffled. ``text`` is that of a string, and JSON for any other node; ``value`` is read
    from it. A node at
    ``max_depth`` (None: there is none) that could be opened further is handed on whole and marked ``unopened``. ``under``
    names a column of keys to go on from, where ``record`` is such a node. Without ``whole`` containers have no text and no
    value; with ``once``, which keeps no columns, equal nodes of a part of a batch are one row, ``times`` tells of how many.
    """
    carried = [*dict.fromkeys([*keep, *([under] if under else [])])]
    if once and carried:
        raise ValueError("nodes that are handed on once belong to no row")
    of_lists = under is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pd.Series(batch.column(len(carried)).to_pylist(), dtype=object)
            for part in parts_of(texts):
                rows, nodes = nodes_table(list(texts.iloc[part]), max_depth, of_lists, whole, once)
                for i, name in enumerate(carried):
                    own = batch.column(i).slice(part.start, part.stop - part.start)
                    nodes = nodes.add_column(i, name, own.take(pa.array(rows, pa.int64())))
                yield from nodes.combine_chunks().to_batches()

    fields = [df.schema[c] for c in carried]
    schema = T.StructType([*fields, *T._parse_datatype_string(NODE_COLUMNS).fields])
    out = df.select(*carried, F.to_json(F.col(record)).alias("_json")).mapInArrow(run, schema)
    keys = F.col("keys") if under is None else F.concat(F.col(under), F.col("keys"))
    value = F.when(F.col("type") == "string", F.col("text").cast("variant")).otherwise(F.parse_json("text"))
    return out.select(*keep, keys.alias("keys"), F.array_join(keys, ".").alias("path"), value.alias("value"), "type", "text", "unopened", "times")


def walk_whole(df: DataFrame, record: str, keep: list[str], step: int | None = None, whole: bool = True, once: bool = False) -> DataFrame:
    """Every node at any depth: ``keys``, ``path``, ``value``, ``type``, ``text``; see ``walk``.

    Records are read once however deep they are, so ``step``, the levels once opened at a time, no longer matters.
    """
    return walk(df, record, keep, None, None, whole, once).drop("unopened")


def parse_whole(text: Column) -> Column:
    """Variant of a text that is one JSON value; null for any other, also for one with a tail.

    The parser stops at the end of the first value, so the text is read as the only element of a list. A text that
    closes that list itself can't also be the only member of an object.
    """
    listed = elements(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    closed = text.contains("]") & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNull()
    return bind(listed, lambda found: F.when((F.size(found) == 1) & ~closed, F.get(found, F.lit(0))))


def at_path(v: Column, json_path: list[str], dtype: str = "string") -> Column:
    """Value at a key path, null when it is missing or does not fit ``dtype``; keys may hold any character."""
    steps = ""
    for i, key in enumerate(json_path):
        if "'" in key and '"' in key:  # no path can quote it
            inside = F.element_at(members(F.try_variant_get(v, f"${steps}", "variant")), F.lit(key))
            return at_path(inside, json_path[i + 1 :], dtype)
        steps += f'["{key}"]' if "'" in key else f"['{key}']"
    return F.try_variant_get(v, f"${steps}", dtype)


def is_string_at(v: Column, json_path: list[str]) -> Column:
    return F.schema_of_variant(at_path(v, json_path, "variant")) == "STRING"


def canonical_json(c: Column) -> Column:
    """Compact form of a text that holds a JSON object or array; any other text as it is."""
    looks = c.startswith("{") | c.startswith("[")
    return F.coalesce(F.when(looks, F.to_json(parse_whole(c))), c)


def serialized(values: list[Column]) -> Column:
    """Non-null values as text."""
    return F.filter(F.array(*[v.cast("string") for v in values]), lambda v: v.isNotNull())
