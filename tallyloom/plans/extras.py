"""Queries over converter templates, request rules and the smaller operators, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions import vectors as V
from tallyloom.functions.rng import unit_sql
from tallyloom.operators import augment as A
from tallyloom.operators import checks as K
from tallyloom.operators import templates as M
from tallyloom.operators.evaluation import once as answers_once
from tallyloom.plans.evaluation import ONCE as ANSWERS_ONCE
from tallyloom.plans.pipeline import ONCE, once
from tallyloom.plans.pipeline import LEAF
from tallyloom.plans.relational import MASKS
from tallyloom.tables import table


def upstream(spark, d):
    """Documents as rows of a classification source."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", F.when(F.col("doc_id") % 11 != 0, F.col("kind")).alias("other"), (F.col("doc_id") % 8 - 1).cast("double").alias("label"))


def template_outcomes(spark, d):
    """Every template over every document: questions made and rows skipped, by reason."""
    r = M.apply_all(upstream(spark, d))
    return r.groupBy("template", "type", F.coalesce("skip", F.lit("good")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.element_at("target", 1)).alias("first_mass"))


def template_besides(spark, d):
    """Yes/no questions asked besides the main one, with the share of yes."""
    r = M.besides(upstream(spark, d), "news_topic").unionByName(M.besides(upstream(spark, d), "shop_stars"))
    return r.groupBy("template", "instructions").agg(F.count("*").alias("n"), F.sum("yes").alias("yes"))


def request_validate(spark, d):
    q = once(spark, d).select("rec_key", F.explode("questions").alias("q"))
    model = F.element_at(F.array(F.lit("nova-s"), F.lit("nova-m"), F.lit("nova-x")), (F.col("rec_key") % 3 + 1).cast("int"))
    r = K.request_errors(q, model, F.col("q.type"), F.coalesce(F.size("q.criteria"), F.lit(0)), F.exists(F.coalesce("q.criteria", F.array()), lambda c: F.coalesce(c["label"], F.lit("")) == ""))
    return r.groupBy(F.coalesce("fault", F.lit("good")).alias("fault")).agg(F.count("*").alias("n"))


def state_strings(spark, d):
    """Length of each state's strings, with and without its numbers."""
    r = once(spark, d)
    return r.select("rec_key", F.length(K.leaf_text(False)("state_json")).alias("strings"), F.length(K.leaf_text(True)("state_json")).alias("with_numbers"))


def greedy_near_dup(spark, d):
    """Sign hashes of each class and planted copies with up to seven other bits, kept in order unless near a kept one."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> shiftleft(CASE WHEN x > 0 THEN 1L ELSE 0L END, i)), 0L, (a, b) -> a | b)")
    e = table(spark, d, "embeddings").select("label", "vec_id", bits.alias("h"))
    mask = F.element_at(F.array(*(F.lit(m) for m in MASKS)), (F.col("vec_id") % 8 + 1).cast("int"))
    copies = e.select("label", (F.col("vec_id") * 3 % 5000 + 10_000_000).alias("vec_id"), F.col("h").bitwiseXOR(mask).alias("h"))
    return K.greedy_distinct(e.unionByName(copies), "label", "vec_id", "h").select("label", "vec_id")


def generic_questions(spark, d):
    return K.generic_variant(A.questions(once(spark, d)))


def latency_curve(spark, d):
    a = answers_once(table(spark, d, "answers"))
    return K.latency_curve(a, ["model", "qtype"], "answer_id", "latency_ms")


def bootstrap_units(spark, d):
    """Clusters, records or questions as units of resampling, by source."""
    q = once(spark, d).select("rec_key", "source", F.when(F.trim("cluster").isin("", "-", "nan", "None"), None).otherwise(F.col("cluster")).alias("cluster"), F.explode("questions").alias("q"))
    return K.bootstrap_clusters(q.withColumn("qname", F.col("q.name")), "cluster", "rec_key", "qname").groupBy("source").agg(F.count_distinct("unit").alias("units"))


def softmax_levels(spark, d):
    """Answer distributions from logits, checked against their logarithms."""
    a = answers_once(table(spark, d, "answers")).where("pred is not null")
    soft = V.softmax(F.transform("pred", lambda p: F.ln(F.greatest(p, F.lit(1e-12)))))
    return a.select("answer_id", F.round(F.element_at(soft, 1), 6).alias("first"))


def step_splits(spark, d):
    """Events with the split of their user; two users in three are listed."""
    e = table(spark, d, "events").select("event_id", "user_id")
    listed = e.select("user_id").distinct().where("user_id % 3 <> 0").withColumn("split", F.when(F.col("user_id") % 3 == 1, "train").otherwise("test"))
    return K.with_split(e, listed, "user_id").groupBy("split").agg(F.count("*").alias("n"))


def comma_options(spark, d):
    q = once(spark, d).select("rec_key", F.explode("questions").alias("q")).where("q.type = 'choice'")
    line = F.concat(F.lit("Pick.\nOptions: "), F.array_join(F.transform("q.criteria", lambda c: F.coalesce(c["label"], F.lit(""))), ", "), F.lit("."))
    return q.select("rec_key", F.col("q.name").alias("name"), F.array_join(K.comma_options(line), "|").alias("options"))


def exponent_repair(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "e+1").otherwise("e+2")).alias("t"))
    return o.select("o_orderkey", T.fix_exponent(F.col("t")).alias("t"))


_Q = f"{ONCE}, q AS (SELECT rec_key, source, cluster, unnest(questions) AS q FROM once)"
_UP = "SELECT doc_id AS key, text, CASE WHEN doc_id % 11 <> 0 THEN kind END AS other, CAST(doc_id % 8 - 1 AS INT) AS label FROM documents"


def _template_sql(name: str) -> str:
    t = M.TEMPLATES[name]
    n = len(t.options) or 2
    label = "least(CAST(floor(label + 0.5) AS INT), 5)" if t.mean else "label"
    first = f"CAST({label} IN ({', '.join(map(str, t.yes))}) AS INT)" if t.kind == "noul" else f"CAST({label} = 0 AS INT)"
    second = "WHEN trim(coalesce(other, ''), ' ') = '' THEN 'no second text'" if t.paired else ""
    return f"""SELECT '{name}' AS template, '{t.kind}' AS type, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'no text' {second} WHEN {label} IS NULL OR {label} < {t.least} THEN 'no label' WHEN NOT {label} < {n} THEN 'unknown label' ELSE 'good' END AS outcome,
    {first} AS hit FROM u"""


ORACLE_SQL = {
    "template_outcomes": f"WITH u AS ({_UP}), r AS (" + " UNION ALL ".join(map(_template_sql, M.TEMPLATES)) + ") SELECT template, type, outcome, count(*) AS n, CASE WHEN outcome = 'good' THEN CAST(sum(hit) AS DOUBLE) END AS first_mass FROM r GROUP BY 1, 2, 3",
    "template_besides": f"""WITH u AS ({_UP}), g AS (SELECT * FROM u WHERE trim(coalesce(text, ''), ' ') <> '' AND label >= 0),
  o AS (SELECT key, label, i, o, {unit_sql('0.news_topic', 'key', 'o')} AS x FROM (SELECT *, unnest(range(4)) AS i, unnest({list(M.TEMPLATES['news_topic'].options)}) AS o FROM g WHERE label < 4)),
  d AS (SELECT 'news_topic' AS template, 'Is this about: ' || o || '?' AS instructions, CAST(label = i AS INT) AS yes FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY x, o) <= 2
    UNION ALL SELECT 'shop_stars', 'Would the writer recommend it?', CAST(label >= 3 AS INT) FROM g WHERE label < 5)
  SELECT template, instructions, count(*) AS n, CAST(sum(yes) AS DOUBLE) AS yes FROM d GROUP BY 1, 2""",
    "state_strings": f"""WITH {ONCE}, {LEAF} SELECT rec_key, CAST(length(CASE WHEN json_valid(state_json) THEN coalesce(strings, '') ELSE state_json END) AS INT) AS strings,
  CAST(length(CASE WHEN json_valid(state_json) THEN coalesce(all_leaves, '') ELSE state_json END) AS INT) AS with_numbers FROM once LEFT JOIN leaf USING (rec_key)""",
    "greedy_near_dup": f"""WITH RECURSIVE e AS (SELECT vec_id, label, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)) AS HUGEINT) AS h FROM embeddings),
  a AS (SELECT * FROM e UNION ALL SELECT vec_id * 3 % 5000 + 10000000, label, xor(h, CAST({MASKS}[vec_id % 8 + 1] AS HUGEINT)) FROM e),
  o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id, h) AS i FROM a),
  r AS (SELECT label, vec_id, i, true AS kept, [h] AS have FROM o WHERE i = 1
    UNION ALL SELECT o.label, o.vec_id, o.i, len(list_filter(have, lambda x: bit_count(xor(x, o.h)) <= 2)) = 0,
      CASE WHEN len(list_filter(have, lambda x: bit_count(xor(x, o.h)) <= 2)) = 0 THEN list_append(have, o.h) ELSE have END FROM r JOIN o ON o.label = r.label AND o.i = r.i + 1)
  SELECT label, vec_id FROM r WHERE kept""",
    "request_validate": f"""WITH {_Q}, m AS (SELECT *, (['nova-s', 'nova-m', 'nova-x'])[rec_key % 3 + 1] AS model, coalesce(len(q.criteria), 0) AS k FROM q)
  SELECT CASE WHEN model NOT IN ('nova-s', 'nova-m') THEN 'unknown model' WHEN q.type IS NULL OR q.type NOT IN ('noul', 'choice', 'score') THEN 'unknown type'
  WHEN q.type = 'choice' AND (k < 1 OR k > 255) THEN '1 to 255 options' WHEN q.type = 'score' AND (k < 1 OR k > 10) THEN '1 to 10 levels'
  WHEN q.type = 'choice' AND len(list_filter(q.criteria, lambda c: coalesce(c.label, '') = '')) > 0 THEN 'empty label' ELSE 'good' END AS fault, count(*) AS n FROM m GROUP BY 1""",
    "generic_questions": f"""WITH {_Q}, u AS (SELECT rec_key, q.name AS name, regexp_matches(coalesce(q.instructions, ''), '[一-鿿]') AS zh, {unit_sql('0.generic', 'rec_key', 'q.name')} AS u FROM q WHERE q.type = 'choice')
  SELECT rec_key, name, CASE WHEN zh THEN ({list(K.GENERIC['zh'])})[CAST(floor(u * 2) AS INT) + 1] ELSE ({list(K.GENERIC['en'])})[CAST(floor(u * 3) AS INT) + 1] END AS instructions FROM u""",
    "latency_curve": f"""WITH {ANSWERS_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY model, qtype ORDER BY answer_id) AS k FROM once WHERE latency_ms IS NOT NULL)
  SELECT model, qtype, max(latency_ms) FILTER (k = 1) AS first_ms, count(*) FILTER (k > 1) AS n, round(quantile_cont(latency_ms, 0.5) FILTER (k > 1), 6) AS p50,
  min(latency_ms) FILTER (k > 1) AS least, max(latency_ms) FILTER (k > 1) AS most FROM r GROUP BY 1, 2""",
    "bootstrap_units": f"""WITH {_Q}, u AS (SELECT source, rec_key, q.name AS name, coalesce(CASE WHEN trim(cluster, ' ') NOT IN ('', '-', 'nan', 'None') THEN cluster END, CAST(rec_key AS VARCHAR)) AS unit FROM q)
  SELECT source, count(DISTINCT CASE WHEN (SELECT count(DISTINCT unit) FROM u) < 20 THEN CAST(rec_key AS VARCHAR) || '/' || name ELSE unit END) AS units FROM u GROUP BY source""",
    "softmax_levels": f"""WITH {ANSWERS_ONCE}, e AS (SELECT answer_id, list_transform(pred, lambda p: greatest(p, 1e-12)) AS e FROM once WHERE pred IS NOT NULL)
  SELECT answer_id, round(e[1] / list_sum(e), 6) AS first FROM e""",
    "step_splits": "SELECT CASE user_id % 3 WHEN 1 THEN 'train' WHEN 2 THEN 'test' ELSE 'unknown' END AS split, count(*) AS n FROM events GROUP BY 1",
    "comma_options": f"""WITH {_Q}, l AS (SELECT rec_key, q.name AS name, list_transform(q.criteria, lambda c: coalesce(c.label, '')) AS l FROM q WHERE q.type = 'choice')
  SELECT rec_key, name, CASE WHEN len(l) = 4 AND len(list_distinct(l)) = 4 AND NOT list_contains(l, '') THEN array_to_string(l, '|') END AS options FROM l""",
    "exponent_repair": "SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 'e+10' ELSE 'e+2' END AS t FROM orders",
}
QUERIES = {
    f.__name__: f
    for f in (
        template_outcomes, template_besides, request_validate, state_strings, greedy_near_dup, generic_questions, latency_curve, bootstrap_units, softmax_levels, step_splits, comma_options,
        exponent_repair,
    )
}
