"""Queries over sources, sinks and streams: written, read back and compared with the table they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.rng import unit_sql
from tallyloom.sources import files
from tallyloom.streaming import ingest
from tallyloom.tables import table
from tallyloom.workspace import Workspace


def jsonl_scan(spark, d):
    """Bodies written as lines and read by the JSON-lines source."""
    ws = Workspace(spark)
    at = f"{ws.root}/lines"
    table(spark, d, "raw_records").where("body is not null").select(F.regexp_replace("body", "[\r\n]", " ").alias("value")).write.text(at)
    r = files.read_jsonl(spark, at)
    return r.groupBy(F.coalesce(F.when(F.col("bad"), None).otherwise(F.col("source")), F.lit("unreadable")).alias("source")).agg(F.count("*").alias("n"))


def csv_round_trip(spark, d):
    """Customers written as CSV and read with a declared schema."""
    ws = Workspace(spark)
    c = table(spark, d, "customer")
    c.write.csv(f"{ws.root}/csv", header=True, escape='"')
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema)
    return files.read_csv(spark, f"{ws.root}/csv", schema).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def split_sink(spark, d):
    """Records written by split and read with partition pruning."""
    ws = Workspace(spark)
    files.write_splits(table(spark, d, "records").select("rec_key", "source", "split"), f"{ws.root}/splits")
    return spark.read.parquet(f"{ws.root}/splits").where("split = 'validation'").groupBy("source").agg(F.count("*").alias("n"))


def json_round_trip(spark, d):
    """Orders as JSON lines, read back by schema."""
    ws = Workspace(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    files.write_jsonl(o, f"{ws.root}/json")
    return spark.read.schema(o.schema).json(f"{ws.root}/json").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


def unit_sample(spark, d):
    """Ten rows of each Parquet file by hashed rank, with the columns pruned."""
    return files.read_units(spark, f"{d}/orders.parquet", ["o_orderkey", "o_orderpriority"], per_unit=10).select("o_orderkey", "o_orderpriority")


def hashed_budget(spark, d):
    return files.budgeted(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 25)


def raw_ids(spark, d):
    r = table(spark, d, "raw_records")
    return r.select("line_key", files.raw_id(F.coalesce("bucket", F.lit("none")), F.coalesce("line_no", F.lit(0))).alias("raw_id"))


def previews(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", files.preview(F.col("text"), 60).alias("preview"))


def stream_events(spark, d):
    """Hourly counts of events by a watermarked stream that is run to its end."""
    ws = Workspace(spark)
    s = ingest.windowed_counts(ingest.stream(spark, d, ingest.EVENT, "events.parquet"))
    return ingest.run_to_end(s, f"{ws.root}/events", f"{ws.root}/checkpoint", "complete")


def stream_lines(spark, d):
    """Ids of usable lines, each once, by a stream."""
    ws = Workspace(spark)
    s = ingest.usable_lines(ingest.stream(spark, d, ingest.LINE, "raw_records.parquet"))
    return ingest.run_to_end(s, f"{ws.root}/lines", f"{ws.root}/checkpoint").select("id")


ORACLE_SQL = {
    "unit_sample": f"""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY {unit_sql(0, "'orders.parquet'", 'o_orderkey')}, o_orderkey) AS n FROM orders) WHERE n <= 10""",
    "jsonl_scan": """WITH b AS (SELECT regexp_replace(body, '[\\r\\n]', ' ', 'g') AS b FROM raw_records WHERE body IS NOT NULL), l AS (SELECT b FROM b WHERE trim(b, ' ') <> '')
  SELECT coalesce(CASE WHEN json_valid(b) THEN b::JSON ->> 'source' END, 'unreadable') AS source, count(*) AS n FROM l GROUP BY 1""",
    "csv_round_trip": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
    "split_sink": "SELECT source, count(*) AS n FROM records WHERE split = 'validation' GROUP BY 1",
    "json_round_trip": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
    "hashed_budget": "SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(sha256('0|' || CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT, o_orderkey LIMIT 25",
    "raw_ids": "SELECT line_key, coalesce(bucket, 'none') || '/raw/' || lpad(CAST(coalesce(line_no, 0) AS VARCHAR), 6, '0') AS raw_id FROM raw_records",
    "previews": "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '… (' || CAST(length(text) AS VARCHAR) || ' characters)' ELSE text END AS preview FROM documents WHERE text IS NOT NULL",
    "stream_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "stream_lines": "SELECT DISTINCT body::JSON ->> 'id' AS id FROM raw_records WHERE json_valid(body) AND read_at IS NOT NULL AND body::JSON ->> 'id' IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (jsonl_scan, csv_round_trip, split_sink, json_round_trip, unit_sample, hashed_budget, raw_ids, previews, stream_events, stream_lines)}
