"""Queries over converter templates, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.rng import unit_sql
from tallyloom.operators import convert as C
from tallyloom.plans.pipeline import ONCE, once
from tallyloom.tables import table

TOPICS = ["billing", "shipping", "account", "technical", "other"]
STEPS = {"click": "tap", "view": "look", "purchase": "submit"}


def convert_skips(spark, d):
    """Documents as upstream rows: what is converted and why others are not."""
    docs = table(spark, d, "documents")
    skip = F.when(F.col("text").isNull(), "null text").when(F.length(F.trim("text")) == 0, "blank text").when(F.col("lang").isNull() | (F.col("lang") == "und"), "no language").when(F.length("text") < 40, "too short")
    return C.skip_counts(C.converted(docs, skip), "kind")


def convert_topic(spark, d):
    """One-hot targets of a topic choice."""
    docs = table(spark, d, "documents").where("text is not null")
    hit = F.element_at(F.array(*(F.lit(t) for t in TOPICS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select("doc_id", F.array_join(F.transform(C.one_hot(hit, F.array(*(F.lit(t) for t in TOPICS))), lambda x: x.cast("int").cast("string")), ",").alias("target"))


def convert_labels(spark, d):
    return C.sampled_labels(table(spark, d, "documents").select("doc_id"), "doc_id", TOPICS, 2)


def convert_wording(spark, d):
    q = once(spark, d).select("rec_key", F.explode("questions").alias("q"))
    return q.select("rec_key", F.col("q.name").alias("qname"), C.asked_once(F.col("q.instructions")).alias("asked"), C.label_name(F.col("q.type")).alias("label"))


def convert_levels(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg(F.col("l_discount") * 50), 6).alias("m"))
    return li.select("l_partkey", C.half_up_level(F.col("m")).alias("level"), C.bucket_of(F.col("m") * 20).alias("bucket"))


def convert_image_order(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    text = F.concat(F.lit("see <image "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("> and <image "), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(">"))
    return docs.select("doc_id", F.array_join(C.image_order(text, F.array(F.lit(1), F.lit(2), F.lit(3))).cast("array<string>"), ",").alias("images"))


def convert_verdicts(spark, d):
    q = once(spark, d).select(F.explode("questions").alias("q")).select(F.explode("q.criteria").alias("c"))
    return q.groupBy(C.verdict(F.concat_ws(" ", F.lit("answer"), F.col("c.label"), F.lit("is better, or"), F.col("c.desc"))).alias("verdict")).agg(F.count("*").alias("n"))


def convert_captions(spark, d):
    o = table(spark, d, "orders").withColumn("text", F.col("o_orderkey").cast("string"))
    return C.picked_captions(o, "o_custkey", "text", "o_orderstatus", "F", "O")


def convert_steps(spark, d):
    return C.action_steps(table(spark, d, "events").where("ts is not null"), "user_id", STEPS)


def convert_novel(spark, d):
    """Instructions of evaluation records whose plain form no train record uses."""
    q = once(spark, d).select("rec_key", "split", F.explode("questions").alias("q")).select("rec_key", "split", F.col("q.name").alias("qname"), F.col("q.instructions").alias("prompt"))
    return C.novel_prompts(q.where("split = 'test'"), q.where("split = 'train'"), "prompt").select("rec_key", "qname")


def convert_votes(spark, d):
    return C.vote_hardness(table(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag") == "R")


_Q = f"{ONCE}, q AS (SELECT rec_key, split, unnest(questions) AS q FROM once)"
_NEW = "trim(regexp_replace(lower(q.instructions), '[^a-z0-9]+', ' ', 'g'), ' ')"
_VERDICT = "lower(concat_ws(' ', 'answer', c.label, 'is better, or', c.desc))"
ORACLE_SQL = {
    "convert_skips": """SELECT kind, CASE WHEN text IS NULL THEN 'null text' WHEN length(trim(text, ' ')) = 0 THEN 'blank text' WHEN lang IS NULL OR lang = 'und' THEN 'no language'
  WHEN length(text) < 40 THEN 'too short' ELSE 'good' END AS outcome, count(*) AS n FROM documents GROUP BY 1, 2""",
    "convert_topic": "SELECT doc_id, array_to_string(list_transform(range(5), lambda i: CASE WHEN i = doc_id % 5 THEN '1' ELSE '0' END), ',') AS target FROM documents WHERE text IS NOT NULL",
    "convert_labels": f"""WITH l AS (SELECT doc_id, unnest({TOPICS}) AS label FROM documents)
  SELECT doc_id, label FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {unit_sql(0, 'doc_id', 'label')}, label) <= 2""",
    "convert_wording": f"WITH {_Q} SELECT rec_key, q.name AS qname, trim(regexp_replace(trim(q.instructions, ' '), '[?]+$', ''), ' ') || '?' AS asked, lower(q.type) AS label FROM q",
    "convert_levels": """WITH m AS (SELECT l_partkey, round(avg(l_discount * 50), 6) AS m FROM lineitem GROUP BY 1)
  SELECT l_partkey, CAST(least(floor(m + 0.5), 5) AS INT) AS level, CAST(least(floor(m * 20 / 20), 4) AS INT) AS bucket FROM m""",
    "convert_image_order": """WITH n AS (SELECT doc_id, list_filter([doc_id % 3 + 1, doc_id % 4 + 1], lambda x: x <= 3) AS n FROM documents WHERE text IS NOT NULL),
  f AS (SELECT doc_id, CASE WHEN len(n) = 2 AND n[1] = n[2] THEN n[1:1] ELSE n END AS n FROM n)
  SELECT doc_id, array_to_string(list_transform(list_concat(n, list_filter([1, 2, 3]::BIGINT[], lambda x: NOT list_contains(n, x))), lambda x: CAST(x AS VARCHAR)), ',') AS images FROM f""",
    "convert_verdicts": rf"""WITH {_Q}, c AS (SELECT unnest(q.criteria) AS c FROM q) SELECT CASE WHEN regexp_matches({_VERDICT}, '\b(answer|response|draft) a (is|was) (better|best)\b') THEN 1.0::DOUBLE
  WHEN regexp_matches({_VERDICT}, '\b(answer|response|draft) b (is|was) (better|best)\b') THEN 0.0::DOUBLE WHEN regexp_matches({_VERDICT}, '\b(tie|equally good|neither of the two)\b') THEN 0.5::DOUBLE END AS verdict,
  count(*) AS n FROM c GROUP BY 1""",
    "convert_captions": """WITH g AS (SELECT o_custkey, min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus = 'F') AS o, min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus = 'O') AS c,
    ('0x' || substr(sha1(CAST(o_custkey AS VARCHAR)), 1, 2))::INT % 2 AS bit FROM orders GROUP BY 1)
  SELECT o_custkey, CASE WHEN bit = 1 THEN o ELSE c END AS shown, CAST(bit AS DOUBLE) AS target FROM g WHERE o IS NOT NULL AND c IS NOT NULL""",
    "convert_steps": """SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS step, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' WHEN 'purchase' THEN 'submit' ELSE 'other' END AS action,
  CAST(lead(event_id) OVER w IS NULL AS INT) AS done FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "convert_novel": f"WITH {_Q} SELECT rec_key, q.name AS qname FROM q WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {_NEW} AS p FROM q WHERE split = 'train') k WHERE k.p = {_NEW})",
    "convert_votes": """WITH b AS (SELECT l_partkey, count(*) AS votes, count(*) FILTER (l_returnflag = 'R') AS yes FROM lineitem GROUP BY 1)
  SELECT l_partkey, votes, round(yes / votes::DOUBLE, 6) AS share, CASE WHEN yes = 0 OR yes = votes THEN 'hard' ELSE 'soft' END AS kind FROM b""",
}
QUERIES = {
    f.__name__: f
    for f in (
        convert_skips, convert_topic, convert_labels, convert_wording, convert_levels, convert_image_order, convert_verdicts, convert_captions, convert_steps, convert_novel,
        convert_votes,
    )
}
