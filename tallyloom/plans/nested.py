"""Queries over nested JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import nested
from tallyloom.tables import table


def p3_found(spark, d):
    """Every JSON value inside state, questions and targets of a line."""
    return nested.found(table(spark, d, "raw_records"))


def p3_nodes(spark, d):
    """All nodes with labels, kinds and scalar values."""
    return nested.nodes(table(spark, d, "raw_records"))


def p3_tables(spark, d):
    """The flat tables and what they hang from."""
    return nested.schema_tables(p3_nodes(spark, d))


def p3_messages(spark, d):
    """The table of ticket messages."""
    return nested.flat_table(p3_nodes(spark, d), "state.ticket.messages[*]", ["from", "text", "at"])


def p3_relations(spark, d):
    """Rows of all tables with their parents, fields as one text."""
    r = nested.relations(table(spark, d, "raw_records"))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), "|")
    return r.select("table", "line_key", "dewey", "parent_table", "parent_dewey", "pos", fields.alias("fields"))


def p3_columns(spark, d):
    """The tables, what they hang from, and their columns."""
    return nested.columns(nested.relations(table(spark, d, "raw_records")))


QUERIES = {f.__name__: f for f in (p3_found, p3_nodes, p3_tables, p3_messages, p3_relations, p3_columns)}
# the tree of a line, walked from the root; names are shown in quotes by the key of a path only where they need them
_WALK = """RECURSIVE t AS MATERIALIZED (SELECT line_key, t.id, t.parent, t.key, t.type, t.atom, row_number() OVER (PARTITION BY line_key, t.parent ORDER BY t.id) - 1 AS pos
    FROM raw_records, json_tree(CASE WHEN json_valid(body) THEN body ELSE 'null' END) t WHERE line_key IS NOT NULL),
  w AS (SELECT t.line_key, t.id, CAST(t.pos AS VARCHAR) AS dewey, '' AS parent_dewey, t.key AS path, '' AS parent_path, t.key AS step, t.key AS schema_path, '' AS parent_schema, t.pos, t.type, t.atom
      FROM t JOIN t r ON r.line_key = t.line_key AND r.id = t.parent WHERE r.parent IS NULL AND r.type = 'OBJECT' AND t.key IN ('state', 'questions', 'targets')
    UNION ALL SELECT t.line_key, t.id, w.dewey || '/' || t.pos, w.dewey, w.path || CASE WHEN w.type = 'ARRAY' THEN '[' || t.key || ']' ELSE '.' || t.key END, w.path,
      CASE WHEN w.type = 'ARRAY' THEN '[' || t.key || ']' ELSE '.' || t.key END, w.schema_path || CASE WHEN w.type = 'ARRAY' THEN '[*]' ELSE '.' || t.key END, w.schema_path, t.pos, t.type, t.atom
      FROM w JOIN t ON t.line_key = w.line_key AND t.parent = w.id),
  n AS (SELECT *, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind FROM w)"""
ORACLE_SQL: dict[str, str] = {
    "p3_found": f"WITH {_WALK} SELECT DISTINCT line_key, path, parent_path, CAST(pos AS INT) AS pos FROM w",
    "p3_nodes": f"""WITH {_WALK} SELECT line_key, dewey, parent_dewey, path, parent_path, step, schema_path, kind, CAST(pos AS INT) AS pos,
  CASE WHEN kind = 'string' THEN atom ->> '$' WHEN kind IN ('number', 'boolean') THEN CAST(atom AS VARCHAR) END AS value FROM n""",
    "p3_tables": f"""WITH {_WALK} SELECT schema_path, parent_schema, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, count(*) AS n_rows, count(DISTINCT line_key) AS n_lines, CAST(max(pos) AS INT) AS last_pos
  FROM n GROUP BY 1, 2""",
    "p3_messages": f"""WITH {_WALK}, m AS (SELECT * FROM w WHERE schema_path = 'state.ticket.messages[*]'),
  c AS (SELECT line_key, parent_dewey, step, arg_min(CASE WHEN type = 'VARCHAR' THEN atom ->> '$' ELSE CAST(atom AS VARCHAR) END, pos) AS v FROM w WHERE parent_schema = 'state.ticket.messages[*]' GROUP BY 1, 2, 3)
  SELECT m.line_key, m.dewey, m.parent_dewey, CAST(m.pos AS INT) AS pos, f.v AS "from", t.v AS text, a.v AS at FROM m
  LEFT JOIN c f ON f.line_key = m.line_key AND f.parent_dewey = m.dewey AND f.step = '.from' LEFT JOIN c t ON t.line_key = m.line_key AND t.parent_dewey = m.dewey AND t.step = '.text'
  LEFT JOIN c a ON a.line_key = m.line_key AND a.parent_dewey = m.dewey AND a.step = '.at'""",
}
