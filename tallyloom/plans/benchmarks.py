"""Queries over converters of evaluation collections, with the same rows in SQL; upstream rows are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import benchmarks as B
from tallyloom.plans.pipeline import ONCE, once
from tallyloom.sources import files
from tallyloom.tables import table

CLASSES = {"ticket": "support", "review": "opinion", "log": "machine", "policy": "rule"}
ENDINGS = (" Issues", " Errors")


def _flat(rows, *more):
    target = F.array_join(F.transform("target", lambda x: x.cast("int").cast("string")), ",")
    return rows.select("key", "skip", "type", F.array_join("labels", "|").alias("labels"), target.alias("target"), *more)


def _questions(spark, d):
    q = once(spark, d).select("rec_key", "license", "lang", F.explode("questions").alias("q")).where("q.target is not null")
    return q.select(F.concat_ws("/", "rec_key", "q.name").alias("id"), "rec_key", "license", "lang", F.col("q.type").alias("type"), F.col("q.instructions").alias("instructions"), "q.criteria", "q.target")


def bench_expected(spark, d):
    """Questions with their most probable answer as the expected one; a level in seven is out of range."""
    best = F.array_position("target", F.array_max("target")).cast("int")
    labels = F.when(F.col("type") == "score", F.transform("criteria", lambda c, i: i.cast("string"))).otherwise(F.transform("criteria", lambda c: c["label"]))
    said = F.when(F.col("type") == "noul", F.element_at(F.array(F.lit("yes"), F.lit("no")), best)).when(F.col("type") == "score", (best - 1 + F.when(F.col("rec_key") % 7 == 0, 100).otherwise(0)).cast("string")).otherwise(F.element_at(F.transform("criteria", lambda c: c["label"]), best))
    up = _questions(spark, d).where("type = 'noul' or size(criteria) = size(target)").select("id", "type", "instructions", labels.alias("labels"), said.alias("expected"), F.col("license").alias("licence"), (F.col("rec_key") % 2).alias("t"))
    rows = B.expected_answers({"even": up.where("t = 0"), "odd": up.where("t = 1")}, {"commercial-ok": "commercial-ok"})
    return _flat(rows, "tier", "license")


def bench_lettered(spark, d):
    """Choices of two to four options as columns A to D; every fifth row is a rotated copy, every third answer is no option."""
    q = _questions(spark, d).where("type = 'choice' and size(criteria) between 2 and 4")
    desc = lambda k: F.try_element_at(F.transform("criteria", lambda c: c["desc"]), F.lit(k))
    up = q.select((F.col("rec_key") + F.when(F.col("rec_key") % 5 == 0, 1_000_000).otherwise(0)).alias("index"), F.col("instructions").alias("question"), F.when(F.col("rec_key") % 2 == 0, F.col("lang")).otherwise("nan").alias("hint"), *(desc(k + 1).alias(x) for k, x in enumerate("ABCD")), F.when(F.col("rec_key") % 3 == 0, "E").otherwise("B").alias("answer"))
    return _flat(B.lettered_columns(up, "Pick one."), "state", F.array_join("texts", "|").alias("texts"))


def bench_presence(spark, d):
    """Documents as questions about an object."""
    thing = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Do you see "), "kind", F.lit("?"))).otherwise(F.concat(F.lit("Is there a "), "kind", F.lit(" in the image?")))
    answer = F.element_at(F.array(F.lit("Yes "), F.lit("no"), F.lit("?")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _flat(B.presence(table(spark, d, "documents").select(F.col("doc_id").alias("id"), thing.alias("question"), answer.alias("answer"))), "instructions", "negated")


def bench_classes(spark, d):
    """Kinds of documents with endings as upstream classes."""
    ending = F.element_at(F.array(F.lit(" Issues "), F.lit(" Errors"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    up = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat("kind", ending).alias("class"), F.col("source").alias("game"))
    return _flat(B.mapped_classes(up, "class", CLASSES, ENDINGS, "What is it?"), "cluster")


def bench_quoted(spark, d):
    """Events as statements about two pictures."""
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 5 == 0, "no statement").otherwise(F.concat(F.lit('Is "user did '), "event_type", F.lit('" right?')))
    images = F.when(F.col("user_id") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array(F.concat(F.lit("dev-"), F.col("user_id").cast("string"), F.lit("-img0")), F.lit("y")))
    up = e.select(F.col("event_id").alias("id"), said.alias("user"), F.when(F.col("event_id") % 2 == 0, "Yes.").otherwise("no").alias("assistant"), images.alias("images"))
    return _flat(B.quoted(up, "Is this true?", 2), "instructions", "pair", "split")


def bench_pairs(spark, d):
    """Orders of a customer on one day as counterfactual pairs, where there are exactly two."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("/", F.col("o_custkey").cast("string"), F.substring(F.col("o_orderdate").cast("string"), 1, 4)).alias("pair"))
    return B.counterfactual_pairs(o, "o_orderkey", "pair").select("o_orderkey", "partner")


def bench_charts(spark, d):
    """Numbers of parts as answers about charts, with options from chart, change and template."""
    p = table(spark, d, "part")
    up = p.select(F.col("p_partkey").alias("qid"), (F.col("p_partkey") % 97).alias("chart"), F.col("p_brand").alias("template"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" by ", (F.col("p_size") % 5 + 1).cast("string"), (F.col("p_size") % 3 + 1).cast("string"))).otherwise(F.col("p_type")).alias("answer"))
    return B.chart_options(up).select("qid", F.size("texts").alias("options"), F.array_position("target", F.lit(1.0)).cast("int").alias("at"))


def file_row_groups(spark, d):
    """Row groups of the folder's tables from their footers: groups and rows by table."""
    at = F.regexp_extract("file", r"/([a-z_]+)\.parquet", 1)
    return files.row_groups(spark, d).where(at.isin("orders", "lineitem", "documents", "records")).groupBy(at.alias("name")).agg(F.sum("n_rows").alias("rows"))


_Q = f"""{ONCE}, q0 AS (SELECT rec_key, license, lang, unnest(questions) AS q FROM once),
  q AS (SELECT rec_key || '/' || q.name AS id, rec_key, license, lang, q.type AS type, q.instructions AS instructions, q.criteria AS criteria, q.target AS target FROM q0 WHERE q.target IS NOT NULL)"""
_HOT = "array_to_string(list_transform({0}, lambda x, i: CAST(CAST(i = {1} AS INT) AS VARCHAR)), ',')"
_SAID = "CASE WHEN lower(trim({0}, ' ')) NOT IN ('', '-', 'nan', 'none') THEN trim({0}, ' ') END"
ORACLE_SQL = {
    "bench_expected": f"""WITH {_Q}, l AS (SELECT *, CASE type WHEN 'noul' THEN ['true', 'false'] WHEN 'score' THEN list_transform(criteria, lambda c, i: CAST(i - 1 AS VARCHAR)) ELSE list_transform(criteria, lambda c: c.label) END AS labels,
    list_position(target, list_max(target)) AS best FROM q WHERE type = 'noul' OR len(criteria) = len(target)),
  a AS (SELECT *, CASE WHEN type = 'choice' THEN list_position(labels, labels[best]) ELSE best END AS place FROM l)
  SELECT id AS key, CASE WHEN type = 'score' AND rec_key % 7 = 0 THEN 'answer_not_in_options' END AS skip, type, array_to_string(labels, '|') AS labels,
  CASE WHEN NOT (type = 'score' AND rec_key % 7 = 0) THEN {_HOT.format('labels', 'place')} END AS target, CASE WHEN rec_key % 2 = 0 THEN 'even' ELSE 'odd' END AS tier, CASE WHEN license = 'commercial-ok' THEN license ELSE 'unknown' END AS license FROM a""",
    "bench_lettered": f"""WITH {_Q}, o AS (SELECT *, list_filter(list_transform(criteria, lambda c, i: {{'l': chr(CAST(64 + i AS INT)), 't': {_SAID.format('c.desc')}}}), lambda o: o.t IS NOT NULL) AS o
    FROM q WHERE type = 'choice' AND len(criteria) BETWEEN 2 AND 4),
  s AS (SELECT *, list_transform(o, lambda x: x.l) AS labels, CASE WHEN rec_key % 5 = 0 THEN 'circular_rotation' WHEN rec_key % 3 = 0 OR len(list_filter(o, lambda x: x.l = 'B')) = 0 THEN 'answer_not_in_options' END AS skip FROM o)
  SELECT rec_key + CASE WHEN rec_key % 5 = 0 THEN 1000000 ELSE 0 END AS key, skip, 'choice' AS type, array_to_string(labels, '|') AS labels, CASE WHEN skip IS NULL THEN {_HOT.format('labels', "list_position(labels, 'B')")} END AS target,
  concat_ws(chr(10) || chr(10), CASE WHEN rec_key % 2 = 0 THEN {_SAID.format('lang')} END, trim(instructions, ' ')) AS state, array_to_string(list_transform(o, lambda x: x.t), '|') AS texts FROM s""",
    "bench_presence": """SELECT doc_id AS key, CASE WHEN doc_id % 3 = 2 THEN 'answer_not_yes_no' END AS skip, 'noul' AS type, 'true|false' AS labels, (['1,0', '0,1', NULL])[doc_id % 3 + 1] AS target,
  CASE WHEN doc_id % 4 = 0 THEN 'Do you see ' || kind || '?' ELSE 'Is there a ' || kind || ' in the image?' END AS instructions, CASE WHEN doc_id % 4 <> 0 AND kind <> '' THEN 'Is there no ' || kind || ' in the image?' END AS negated FROM documents""",
    "bench_classes": f"""WITH c AS (SELECT doc_id, source, list_position({list(CLASSES)}, kind) AS place FROM documents)
  SELECT doc_id AS key, CASE WHEN coalesce(place, 0) = 0 THEN 'unknown_type' END AS skip, 'choice' AS type, '{'|'.join(CLASSES.values())}' AS labels, CASE WHEN coalesce(place, 0) > 0 THEN {_HOT.format(str(list(CLASSES.values())), 'place')} END AS target, coalesce(source, 'N/A') AS cluster FROM c""",
    "bench_quoted": """SELECT event_id AS key, CASE WHEN user_id % 4 = 0 THEN 'images' WHEN event_id % 5 = 0 OR event_type IS NULL THEN 'unparsed' END AS skip, 'noul' AS type, 'true|false' AS labels,
  CASE WHEN user_id % 4 <> 0 AND event_id % 5 <> 0 AND event_type IS NOT NULL THEN CASE WHEN event_id % 2 = 0 THEN '1,0' ELSE '0,1' END END AS target,
  'Is this true? "' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'user did ' || event_type END || '"' AS instructions, CASE WHEN user_id % 4 = 0 THEN 'x' ELSE 'dev-' || user_id END AS pair, CASE WHEN user_id % 4 = 0 THEN 'train' ELSE 'dev' END AS split FROM events""",
    "bench_pairs": """WITH p AS (SELECT o_orderkey, o_custkey || '/' || substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS pair FROM orders)
  SELECT o_orderkey, CASE WHEN count(*) OVER w = 2 THEN CASE WHEN o_orderkey = min(o_orderkey) OVER w THEN max(o_orderkey) OVER w ELSE min(o_orderkey) OVER w END END AS partner FROM p WINDOW w AS (PARTITION BY pair)""",
    "file_row_groups": "SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'records', count(*) FROM records",
}
QUERIES = {f.__name__: f for f in (bench_expected, bench_lettered, bench_presence, bench_classes, bench_quoted, bench_pairs, bench_charts, file_row_groups)}
