"""Nested JSON records as an adjacency table, and entity tables joined back from it.

``shred`` turns each body into its nodes (node, parent, label, ordinal, kind, scalar, path);
``adjacency`` lists them as rows, ``members`` joins object and array nodes with their scalar
children, and ``entities`` pivots those into one row per object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NODE = "array<struct<node:int,parent:int,label:string,ordinal:int,kind:string,scalar:string,path:array<string>>>"

_ARROW_NODE = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("path", pa.list_(pa.string()))])

#: Steps below the root up to which objects and arrays carry their path.
REACH = 16


class _Number(str):
    """A number as written."""


class _Pairs(list):
    """An object's members in order; of repeated keys the last value stands, at the first place."""

    def __init__(self, members: Sequence[tuple[str, object]]):
        super().__init__(dict(members).items())


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is not JSON")


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


def _deep(text: str) -> object:
    """Strict JSON of any depth: an explicit stack instead of recursion."""
    end, at, stack, done = len(text.rstrip(" \t\n\r")), 0, [], None
    expect = "value"  # value | first (value or ]) | name (or }) | next name | colon | comma | end

    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no JSON token")
        at, (mark, string, number, word) = m.end(), m.groups()
        if expect in ("name", "next name"):
            if string is not None:
                stack[-1][1].append(json.loads(string))
                expect = "colon"
                continue
            if mark != "}" or expect == "next name":
                raise ValueError("a name was expected")
        elif expect == "colon":
            if mark != ":":
                raise ValueError("a colon was expected")
            expect = "value"
            continue
        elif expect == "comma":
            if mark == ",":
                expect = "next name" if stack[-1][0] == "{" else "value"
                continue
            if mark not in ("}", "]"):
                raise ValueError("a comma was expected")
        elif expect == "end":
            raise ValueError("text after the value")
        elif mark in ("{", "["):
            stack.append((mark, [], []))
            expect = "name" if mark == "{" else "first"
            continue
        elif mark is not None and not (mark == "]" and expect == "first"):
            raise ValueError("a value was expected")
        if mark is None:
            value: object = json.loads(string) if string is not None else _Number(number) if number is not None else {"true": True, "false": False, "null": None}[word]
        else:
            kind, names, values = stack.pop()
            if (kind == "{") != (mark == "}"):
                raise ValueError("brackets do not match")
            value = _Pairs(list(zip(names, values, strict=True))) if kind == "{" else values
        if stack:
            stack[-1][2].append(value)
            expect = "comma"
        else:
            done, expect = value, "end"
    if expect != "end":
        raise ValueError("the text ends early")
    return done


def parse_strict(text: str) -> object:
    """The value of a strict JSON text; raises ValueError for anything else.

    Numbers stay as written; NaN, comments, trailing commas, single quotes, control
    characters in strings and text after the value are errors; any depth is accepted.
    """
    try:
        return json.loads(text, object_pairs_hook=_Pairs, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
    except RecursionError:
        return _deep(text)


Node = tuple[int, int | None, str | None, int | None, str, str | None, list[str] | None]


def nodes_of(text: str | None, reach: int = REACH) -> list[Node] | None:
    """(node, parent, label, ordinal, kind, scalar, path) in document order; None if the text is no strict JSON.

    ``path``: labels from the root to an object or array at most ``reach`` steps below it, else None.
    """
    if text is None:
        return None
    try:
        root = parse_strict(text)
    except ValueError:
        return None
    out: list[Node] = []
    todo: list[tuple[object, int | None, str | None, int | None, list[str] | None]] = [(root, None, None, None, [])]
    while todo:
        value, parent, label, ordinal, path = todo.pop()
        node = len(out)
        if isinstance(value, (_Pairs, list)):
            named = [(_clean(k), v) for k, v in value] if isinstance(value, _Pairs) else [(str(i), v) for i, v in enumerate(value)]
            out.append((node, parent, label, ordinal, "object" if isinstance(value, _Pairs) else "array", None, path))
            below = path is not None and len(path) < reach
            for i in range(len(named) - 1, -1, -1):
                k, v = named[i]
                todo.append((v, node, k, i, [*path, k] if below and isinstance(v, list) else None))
        elif isinstance(value, _Number):
            out.append((node, parent, label, ordinal, "number", str(value), None))
        elif isinstance(value, str):
            out.append((node, parent, label, ordinal, "string", _clean(value), None))
        else:
            out.append((node, parent, label, ordinal, "null" if value is None else "boolean", None if value is None else str(value).lower(), None))
    return out


def _clean(text: str) -> str:
    """Text that UTF-8 can hold: a lone surrogate escape becomes U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def shred(df: DataFrame, body: str, out: str = "nodes", reach: int = REACH) -> DataFrame:
    """All columns but ``body``, and ``out``: the nodes of the body, null where it is null or no strict JSON.

    Node 0 is the root; ``label`` is the key or the list position, ``ordinal`` the place
    among the siblings, ``path`` that of an object or array at most ``reach`` steps below the
    root. Bodies are parsed in Arrow batches, a row at a time; row count and order stay.
    """
    schema = StructType([f for f in df.schema.fields if f.name != body]).add(StructType.fromDDL(f"`{out}` {NODE}").fields[0])

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != body]
            flat: list[list] = [[] for _ in range(7)]
            starts: list[int | None] = []
            end = 0
            for text in batch.column(batch.schema.get_field_index(body)).to_pylist():
                nodes = nodes_of(text, reach)
                starts.append(None if nodes is None else end)
                if nodes:
                    end += len(nodes)
                    for column, values in zip(flat, zip(*nodes, strict=True), strict=True):
                        column.extend(values)
            starts.append(end)
            fields = list(_ARROW_NODE)
            struct = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, fields, strict=True)], fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), lists], [*names, out])

    return df.mapInArrow(parse, schema)


def adjacency(shredded: DataFrame, nodes: str = "nodes") -> DataFrame:
    """One row per node: the record's own columns, then node, parent, label, ordinal, kind, scalar, path."""
    own = [c for c in shredded.columns if c != nodes]
    return shredded.select(*own, F.inline(nodes))


def _within(record: Sequence[str]) -> Column:
    """Same record, null-safely: its columns against those of the other side, marked with ``__``."""
    same = F.lit(True)
    for c in record:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return same


def members(nodes: DataFrame, record: Sequence[str], owners: Column, scalars: Column) -> DataFrame:
    """``record columns, node, owner_kind, path, label, kind, scalar``: the object and array nodes that meet ``owners``, joined with those of
    their scalar children that meet ``scalars``.

    Records are matched null-safely. An owner is matched with its own children only, so no
    key of the join holds more rows than one object has members.
    """
    objects = nodes.where(F.col("kind").isin("object", "array")).where(owners).select(*[F.col(c).alias(f"__{c}") for c in record], "node", F.col("kind").alias("owner_kind"), "path")
    children = nodes.where(~F.col("kind").isin("object", "array")).where(scalars).select(*record, F.col("parent").alias("owner"), "label", "kind", "scalar")
    return children.join(objects, _within(record) & (F.col("owner") == F.col("node"))).select(*record, "node", "owner_kind", "path", "label", "kind", "scalar")


def entities(nodes: DataFrame, record: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per object node: ``record`` columns, node, parent, label, and its scalar children pivoted into ``fields``.

    A field that is absent, an object or an array is null. Records are matched null-safely.
    """
    scalars = nodes.where(F.col("kind").isin("string", "number", "boolean")).where(F.col("label").isin(*fields))
    rows = scalars.groupBy(*record, F.col("parent").alias("owner")).pivot("label", list(fields)).agg(F.max("scalar"))
    children = rows.select(*[F.col(c).alias(f"__{c}") for c in record], "owner", *fields)
    same = (F.col("node") == F.col("owner")) & _within(record)
    objects = nodes.where(F.col("kind") == "object").select(*record, "node", "parent", "label")
    return objects.join(children, same, "left").select(*record, "node", "parent", "label", *fields)
