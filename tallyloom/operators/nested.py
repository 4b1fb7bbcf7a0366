"""Flat related tables from nested JSON lines.

Every value below the chosen members of a line gets a Dewey label: the ordinals of the members that lead to it, as in
``8/0/2``. The label alone gives place (its last ordinal) and parent (the label cut by one), so children link to
parents without a join. Nodes are grouped into tables by schema path, the path with array places blanked.

Lines are parsed once, in order of writing: member order, repeated members, and the spelling of numbers are kept.

Cases: null, blank or cut-off lines, lines whose value is no object, and lines with NaN or Infinity give no rows; a null
``line_key`` gives none either; absent members give no row; a member that is JSON null is one row of kind ``null``; an
empty object or array is one row; repeated lines give rows of their own; nesting may have any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "line_key long, dewey string, path string, step string, schema_path string, kind string, value string"
MEMBERS = ("state", "questions", "targets")


class Pairs(list):
    """Members of an object as written."""


class Number(str):
    """A number as written."""

    __slots__ = ()


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODE = json.JSONDecoder(object_pairs_hook=Pairs, parse_int=Number, parse_float=Number, parse_constant=_refuse).decode
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))', re.S)
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """Parse with a stack of our own; for nesting beyond the decoder's depth."""
    root: list = []
    stack, at, want = [(root, "value", None)], 0, "value"
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("unexpected text")
            break
        at = m.end()
        mark, string, number, word = m.groups()
        holder, kind, name = stack[-1]
        if mark in ("]", "}"):
            if len(stack) == 1 or kind != {"]": "array", "}": "object"}[mark] or want not in ("first", "next"):
                raise ValueError("unexpected end")
            stack.pop()
            want = "next"
            continue
        if mark == ",":
            if want != "next" or len(stack) == 1:
                raise ValueError("unexpected comma")
            want = "name" if kind == "object" else "value"
            continue
        if mark == ":":
            if want != "colon":
                raise ValueError("unexpected colon")
            want = "value"
            continue
        if kind == "object" and want in ("first", "name"):
            if string is None:
                raise ValueError("a name is missing")
            stack[-1] = (holder, kind, json.loads(string))
            want = "colon"
            continue
        if want not in ("value", "first"):
            raise ValueError("unexpected value")
        new = [] if mark == "[" else Pairs() if mark == "{" else json.loads(string) if string else Number(number) if number else _WORDS[word]
        holder.append((name, new) if kind == "object" else new)
        want = "next"
        if mark:
            stack.append((new, "object" if mark == "{" else "array", None))
            want = "first"
    if len(stack) > 1 or len(root) != 1 or want != "next":
        raise ValueError("cut off")
    return root[0]


def parse_line(body: str | None) -> Pairs | None:
    """The members of a line, or None if it is not one complete JSON object."""
    if not body or body.isspace():
        return None
    try:
        try:
            value = _DECODE(body)
        except RecursionError:
            value = _deep(body)
    except ValueError:
        return None
    return value if isinstance(value, Pairs) else None


def label(line: Pairs, members: Iterable[str] = MEMBERS) -> Iterator[tuple[str, str, str, str, str, str | None]]:
    """Dewey label, path, own step, schema path, kind and scalar value of each node, parents first."""
    wanted = set(members)
    stack = [(str(i), k, k, k, v) for i, (k, v) in enumerate(line) if k in wanted]
    stack.reverse()
    while stack:
        dewey, path, step, schema, v = stack.pop()
        if isinstance(v, Pairs):
            yield dewey, path, step, schema, "object", None
            stack.extend([(f"{dewey}/{i}", f"{path}.{k}", f".{k}", f"{schema}.{k}", x) for i, (k, x) in enumerate(v)][::-1])
        elif isinstance(v, list):
            yield dewey, path, step, schema, "array", None
            stack.extend([(f"{dewey}/{i}", f"{path}[{i}]", f"[{i}]", f"{schema}[*]", x) for i, x in enumerate(v)][::-1])
        elif isinstance(v, Number):
            yield dewey, path, step, schema, "number", str(v)
        elif isinstance(v, str):
            yield dewey, path, step, schema, "string", v
        elif v is None:
            yield dewey, path, step, schema, "null", None
        else:
            yield dewey, path, step, schema, "boolean", "true" if v else "false"


def _clean(s: str | None) -> str | None:
    """Text that UTF-8 can hold: an escaped lone surrogate becomes a question mark."""
    return s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()


def nodes(lines: DataFrame, members: Iterable[str] = MEMBERS, key: str = "line_key", body: str = "body") -> DataFrame:
    """One row for every JSON value inside the members of each line."""
    members = tuple(members)
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                line = parse_line(text)
                if line is None:
                    continue
                for row in label(line, members):
                    for col, x in zip(out, (k, *row), strict=True):
                        col.append(x)
                if len(out[0]) > 50_000:
                    yield _batch(out, names)
                    out = [[] for _ in names]
            yield _batch(out, names)

    def _batch(out, names):
        cols = [pa.array(out[0], pa.int64()), *(pa.array([_clean(x) for x in c], pa.string()) for c in out[1:])]
        return pa.RecordBatch.from_arrays(cols, names=names)

    src = lines.where(F.col(key).isNotNull() & F.col(body).isNotNull()).select(F.col(key).alias("line_key"), F.col(body).alias("body"))
    return linked(src.mapInArrow(run, NODES))


def linked(labelled: DataFrame) -> DataFrame:
    """Parents and places, derived from the labels by truncation."""
    return labelled.withColumns(
        {
            "parent_dewey": F.when(F.col("dewey").contains("/"), F.regexp_replace("dewey", "/[^/]*$", "")).otherwise(F.lit("")),
            "parent_path": F.expr("left(path, length(path) - length(step))"),
            "pos": F.substring_index("dewey", "/", -1).cast("int"),
        }
    )


def schema_tables(nodes: DataFrame) -> DataFrame:
    """One row a table: schema path, the table it hangs from, kinds seen, rows and lines."""
    bare = F.regexp_replace("step", r"^\[[0-9]+\]$", "[*]")
    return (
        nodes.withColumn("parent_schema", F.substring("schema_path", F.lit(1), F.length("schema_path") - F.length(bare)))
        .groupBy("schema_path", "parent_schema")
        .agg(
            F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
            F.count("*").alias("n_rows"),
            F.count_distinct("line_key").alias("n_lines"),
            F.max("pos").alias("last_pos"),
        )
    )


RELATIONS = "table string, line_key long, dewey string, parent_table string, parent_dewey string, pos int, fields map<string,string>"


def relations(lines: DataFrame, members: Iterable[str] = MEMBERS) -> DataFrame:
    """The rows of all tables in one pass: every object, and every scalar or empty value that stands in an array or at the top.

    ``table`` is the schema path, ``fields`` the scalar members by name (``value`` for a bare scalar; of a repeated member
    the last), ``parent_table`` and ``parent_dewey`` name the row it belongs to, '' for the line itself; arrays make no
    rows, so the row behind an array is the object around it.
    """
    members = tuple(members)
    names = [x.split()[0] for x in RELATIONS.split(", ")]
    text = lambda v: v if v is None or isinstance(v, str) else "true" if v else "false"

    def rows(line):
        stack = [(str(i), k, v, "", "", i) for i, (k, v) in enumerate(line) if k in members][::-1]
        while stack:
            dewey, table, v, parent_table, parent, pos = stack.pop()
            if isinstance(v, Pairs):
                scalars = {k: text(x) for k, x in v if not isinstance(x, list)}
                yield table, dewey, parent_table, parent, pos, scalars
                inner = [(f"{dewey}/{i}", f"{table}.{k}", x, table, dewey, i) for i, (k, x) in enumerate(v) if isinstance(x, list)]
            elif isinstance(v, list):
                inner = [(f"{dewey}/{i}", f"{table}[*]", x, parent_table, parent, i) for i, x in enumerate(v)]
            else:
                yield table, dewey, parent_table, parent, pos, {"value": text(v)}
                continue
            stack.extend(inner[::-1])

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                line = parse_line(body)
                for table, dewey, parent_table, parent, pos, fields in rows(line) if line is not None else ():
                    row = (_clean(table), k, dewey, _clean(parent_table), parent, pos, [(_clean(n), _clean(x)) for n, x in fields.items()])
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
                if len(out[0]) > 20_000:
                    yield _batch(out)
                    out = [[] for _ in names]
            yield _batch(out)

    def _batch(out):
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    src = lines.where("line_key is not null and body is not null").select("line_key", "body")
    return src.mapInArrow(run, RELATIONS)


def columns(rows: DataFrame) -> DataFrame:
    """``table``, ``parent_table``, ``rows`` and ``columns`` (names of its fields in order) of every table."""
    named = rows.select("table", "parent_table", F.explode_outer(F.map_keys("fields")).alias("name")).groupBy("table", "parent_table", "name").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("table", "parent_table").agg(F.count("*").alias("rows"))
    names = named.groupBy("table", "parent_table").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("columns"))  # names, not rows
    return sizes.join(names, ["table", "parent_table"])


def one_table(rows: DataFrame, table: str, fields: Iterable[str]) -> DataFrame:
    """One of the tables with its fields as columns; a field that is named like a key gets a ``_`` behind it."""
    keys = ("line_key", "dewey", "parent_dewey", "pos")
    return rows.where(F.col("table") == table).select(*keys, *(F.col("fields")[c].alias(f"{c}_" if c in keys else c) for c in fields))


def write_tables(rows: DataFrame, folder: str) -> None:
    """All tables below a folder, one subfolder a table, written in one pass."""
    rows.write.mode("overwrite").partitionBy("table").option("compression", "zstd").parquet(folder)


def flat_table(nodes: DataFrame, schema_path: str, columns: Iterable[str]) -> DataFrame:
    """The table of one schema path: a row a node, its label, its parent's, and named scalar members as columns."""
    columns = list(columns)
    wanted = {f"{schema_path}.{c}": c for c in columns}
    rows = nodes.where(F.col("schema_path").isin(schema_path, *wanted))
    own = F.col("schema_path") == schema_path
    link = F.when(own, F.col("dewey")).otherwise(F.col("parent_dewey"))
    first = lambda path: F.min_by(F.when(F.col("schema_path") == path, F.col("value")), F.when(F.col("schema_path") == path, F.col("pos")))
    return (
        rows.groupBy("line_key", link.alias("dewey"))
        .agg(F.max(F.when(own, F.col("parent_dewey"))).alias("parent_dewey"), F.max(F.when(own, F.col("pos"))).alias("pos"), *(first(p).alias(c) for p, c in wanted.items()))
        .where("parent_dewey is not null")
    )


def places(lines: DataFrame, members: Iterable[str] = MEMBERS) -> DataFrame:
    """``line_key``, ``path``, ``parent_path``, ``pos`` of every value inside the members, distinct within each line.

    Only members that an object repeats can give a row twice; they are settled while the line is at hand.
    """
    members = tuple(members)
    names = ["line_key", "path", "parent_path", "pos"]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                line = parse_line(text)
                if line is None:
                    continue
                rows = dict.fromkeys((_clean(path), _clean(path[: len(path) - len(step)]), int(dewey[dewey.rfind("/") + 1 :])) for dewey, path, step, _, _, _ in label(line, members))
                out[0].extend([k] * len(rows))
                for col, xs in zip(out[1:], zip(*rows, strict=True), strict=True):
                    col.extend(xs)
                if len(out[0]) > 50_000:
                    yield _batch(out)
                    out = [[] for _ in names]
            yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32())], names=names)

    src = lines.where("line_key is not null and body is not null").select("line_key", "body")
    return src.mapInArrow(run, "line_key long, path string, parent_path string, pos int")


def found(lines: DataFrame) -> DataFrame:
    """``line_key``, ``path``, ``parent_path``, ``pos`` of every value inside state, questions and targets, once each.

    Lines with one key have their rows in common; where there are none, no node goes through an exchange.
    """
    keyed = lines.where("line_key is not null and body is not null")
    repeated = not keyed.groupBy("line_key").count().where("count > 1").isEmpty()
    return places(lines).distinct() if repeated else places(lines)
