"""All registered queries of the core, by name, with SQL for those that SQL can express."""

from __future__ import annotations

from tallyloom.plans import benchmarks, converters, evaluation, extras, io, nested, pipeline, relational, requests, texts

MODULES = (evaluation, benchmarks, converters, extras, nested, pipeline, relational, requests, texts, io)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
