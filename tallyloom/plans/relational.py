"""Queries that show the joins, windows, samples and set operations on the star schema, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.rng import unit_sql
from tallyloom.operators import relational as R
from tallyloom.tables import table

BOX = "p_partkey % 50 AS screen, p_partkey AS box_id, (p_partkey * 37) % 900 AS x0, (p_partkey * 53) % 900 AS y0, (p_partkey * 37) % 900 + p_size * 3 AS x1, (p_partkey * 53) % 900 + p_size * 2 AS y1"
POINT = "c_custkey % 50 AS screen, c_custkey AS point_id, (c_custkey * 71) % 1000 AS x, (c_custkey * 29) % 1000 AS y"
MASKS = [sum(1 << (9 * j) for j in range(k)) for k in range(8)]


def pair_votes(spark, d):
    v = table(spark, d, "lineitem").selectExpr("l_returnflag AS k", "l_suppkey % 7 AS a0", "l_partkey % 7 AS b0", "CAST(l_quantity AS BIGINT) AS w")
    return R.pooled_votes(v, "k", "a0", "b0", "w")


def rank_pairs(spark, d):
    return R.ranked_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


def vote_histogram(spark, d):
    return R.vote_histogram(table(spark, d, "lineitem"), "l_partkey", F.expr("CAST(l_quantity AS INT) % 7"))


def soft_target(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg(F.col("l_discount") * 50), 6).alias("m"), F.round(F.coalesce(F.stddev_pop(F.col("l_discount") * 50), F.lit(0.0)), 6).alias("s"))
    return by.select("l_partkey", *(c.alias(f"p{k + 1}") for k, c in enumerate(R.soft_levels(F.col("m"), F.col("s")))))


def balanced_swap(spark, d):
    o = table(spark, d, "orders").withColumns({"a": F.col("o_orderstatus"), "b": F.col("o_orderpriority")})
    return R.balanced_swap(o, F.col("o_orderkey").cast("string"), "a", "b").select("o_orderkey", "swapped", "first", "second")


def negatives_topk(spark, d):
    return R.frequent_negatives(table(spark, d, "lineitem").selectExpr("l_orderkey", "l_partkey % 50 AS tag"), "l_orderkey", "tag", 30, 2)


def both_kinds(spark, d):
    return R.both_kinds(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "F", "O", "o_orderkey")


def bbox_target(spark, d):
    return R.boxes_at(table(spark, d, "customer").selectExpr(*POINT.split(", ")), table(spark, d, "part").selectExpr(*BOX.split(", ")), "screen")


def occlusion(spark, d):
    return R.occluded(table(spark, d, "part").selectExpr(*BOX.split(", ")), "screen")


def reservoir(spark, d):
    return R.reservoir(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 5)


def cumulative_limit(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) AS amount")
    return R.until_total(o, "o_custkey", "o_orderkey", "amount", 300_000)


def k_per_group(spark, d):
    return R.distinct_limited(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), "l_orderkey", "l_suppkey", "l_linenumber", 2)


def derangement(spark, d):
    return R.derangement(table(spark, d, "customer"), "c_nationkey", "c_custkey")


def balanced_classes(spark, d):
    return R.balanced(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey")


def tie_rank(spark, d):
    return R.tie_rank(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity")


def first_seen(spark, d):
    return R.first_seen(table(spark, d, "events"), "user_id", "event_type", "event_id")


def dedup_hamming(spark, d):
    """Sign hashes of vectors against planted near copies of every fifth."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> shiftleft(CASE WHEN x > 0 THEN 1L ELSE 0L END, i)), 0L, (a, b) -> a | b)")
    h = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("h"))
    mask = F.element_at(F.array(*(F.lit(m) for m in MASKS)), (F.col("id") % 8 + 1).cast("int"))
    return R.near_hashes(h, h.where("id % 5 = 0").select("id", F.col("h").bitwiseXOR(mask).alias("h")))


def unpivot_pairs(spark, d):
    return R.unpivot_pairs(table(spark, d, "customer"), "c_custkey", "c_name", "c_mktsegment")


def epoch_stripes(spark, d):
    return R.striped(table(spark, d, "orders"), "o_orderkey", 1, 4)


def shared_keys(spark, d):
    """Questions that both models answered."""
    a = table(spark, d, "answers").where("status = 200")
    one = lambda m: a.where(F.col("model") == m).select("rec_key", "qname")
    return one("nova-s").intersect(one("nova-m"))


def unanswered(spark, d):
    """Evaluation records without any answer."""
    r = table(spark, d, "records").where(F.col("split").isin("calibration", "validation", "test")).select("rec_key", "source").distinct()
    return r.join(table(spark, d, "answers").select("rec_key").distinct(), "rec_key", "left_anti")


def unknown_answers(spark, d):
    """Answers to records that do not exist, by model."""
    a = table(spark, d, "answers").join(table(spark, d, "records").select("rec_key").distinct(), "rec_key", "left_anti")
    return a.groupBy("model").agg(F.count_distinct("answer_id").alias("n"))


def numbers_union(spark, d):
    """Distinct image numbers of records and of the licence table."""
    r = table(spark, d, "records").select(F.col("coco_id").alias("image")).union(table(spark, d, "coco_licenses").select("image_id"))
    return r.where("image is not null").distinct()


def top_sources(spark, d):
    """The ten sources with most records, the first by name on ties."""
    return table(spark, d, "records").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


def pricing_summary(spark, d):
    """The classic pricing summary: one scan, map-side sums, six groups."""
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


def segment_revenue(spark, d):
    """Revenue by nation and segment over a join of four tables and a rollup."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    cents = F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long"))
    return j.rollup("n_name", "c_mktsegment").agg(cents.alias("cents"), F.count("*").alias("lines"))


_ERF = "(CASE WHEN {z} >= 0 THEN 1 - ({t}) / 2 ELSE ({t}) / 2 END)"


def _cdf(x: float) -> str:
    z = f"(({x}::DOUBLE - m) / (greatest(s, 0.001::DOUBLE) * {2**0.5!r}::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({z})))"
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{z} * {z})"
    return _ERF.format(z=z, t=poly)


def _soft() -> str:
    edges = ["0.0::DOUBLE", *(_cdf(float(k)) for k in range(1, 5)), "1.0::DOUBLE"]
    return ", ".join(f"round({b} - {a}, 6) AS p{k + 1}" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))


def _hash_rank(cols: str, tab: str, group: str, key: str, cond: str) -> str:
    return f"SELECT * EXCLUDE (u) FROM (SELECT {cols}, {unit_sql(0, key)} AS u, row_number() OVER (PARTITION BY {group} ORDER BY {unit_sql(0, key)}, {key}) AS rank FROM {tab}) WHERE {cond}"


ORACLE_SQL = {
    "pair_votes": """WITH v AS (SELECT l_returnflag AS k, l_suppkey % 7 AS a0, l_partkey % 7 AS b0, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
  p AS (SELECT k, least(a0, b0) AS a, greatest(a0, b0) AS b, CAST(sum(CASE WHEN a0 < b0 THEN w ELSE 0 END) AS BIGINT) AS for_a, CAST(sum(CASE WHEN a0 > b0 THEN w ELSE 0 END) AS BIGINT) AS for_b
    FROM v WHERE a0 <> b0 GROUP BY 1, 2, 3)
  SELECT *, round(for_a / (for_a + for_b)::DOUBLE, 6) AS share_a FROM p WHERE for_a <> for_b""",
    "rank_pairs": """SELECT x.l_linenumber AS a, y.l_linenumber AS b, count(*) AS n, count(*) FILTER (y.l_quantity > x.l_quantity) AS a_first FROM lineitem x JOIN lineitem y
  ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND x.l_quantity <> y.l_quantity GROUP BY 1, 2""",
    "vote_histogram": "WITH r AS (SELECT l_partkey, CAST(floor(l_quantity) AS INT) % 7 AS r FROM lineitem) SELECT l_partkey, count(*) AS votes, "
    + ", ".join(f"round(count(*) FILTER (r = {k}) / count(*)::DOUBLE, 6) AS p{k}" for k in range(1, 6))
    + " FROM r WHERE r BETWEEN 1 AND 5 GROUP BY l_partkey",
    "soft_target": f"""WITH g AS (SELECT l_partkey, round(avg(l_discount * 50), 6) AS m, round(coalesce(stddev_pop(l_discount * 50), 0), 6) AS s FROM lineitem GROUP BY 1)
  SELECT l_partkey, {_soft()} FROM g""",
    "balanced_swap": """WITH b AS (SELECT *, CAST(('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 2))::INT % 2 AS INT) AS swapped FROM orders)
  SELECT o_orderkey, swapped, CASE WHEN swapped = 1 THEN o_orderpriority ELSE o_orderstatus END AS first, CASE WHEN swapped = 1 THEN o_orderstatus ELSE o_orderpriority END AS second FROM b""",
    "negatives_topk": f"""WITH t AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS tag FROM lineitem),
  top AS (SELECT tag FROM t GROUP BY tag ORDER BY count(*) DESC, min(l_orderkey), tag LIMIT 30),
  l AS (SELECT o.l_orderkey, top.tag FROM (SELECT DISTINCT l_orderkey FROM t) o CROSS JOIN top ANTI JOIN t ON t.l_orderkey = o.l_orderkey AND t.tag = top.tag)
  SELECT * FROM (SELECT l_orderkey, tag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {unit_sql(0, 'l_orderkey', 'tag')}, tag) AS rank FROM l) WHERE rank <= 2""",
    "both_kinds": """SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS first_one, min(o_orderkey) FILTER (o_orderstatus = 'O') AS first_other FROM orders
  GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 2 AND count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'O') > 0""",
    "bbox_target": f"""WITH b AS (SELECT {BOX} FROM part), p AS (SELECT {POINT} FROM customer)
  SELECT p.screen, point_id, arg_min(box_id, ((x1 - x0) * (y1 - y0), box_id)) AS box_id, count(*) AS around FROM p JOIN b ON p.screen = b.screen AND x BETWEEN x0 AND x1
  AND y BETWEEN y0 AND y1 GROUP BY 1, 2""",
    "occlusion": f"""WITH b AS (SELECT {BOX} FROM part) SELECT DISTINCT a.screen, a.box_id FROM b a JOIN b c ON a.screen = c.screen AND c.box_id > a.box_id
  WHERE a.x1 > a.x0 AND a.y1 > a.y0 AND greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) >= 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0)""",
    "reservoir": _hash_rank("o_orderpriority, o_orderkey", "orders", "o_orderpriority", "o_orderkey", "rank <= 5"),
    "cumulative_limit": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders),
  r AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM o) SELECT * FROM r WHERE running <= 300000""",
    "k_per_group": """WITH k AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_suppkey) AS r FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem SEMI JOIN (SELECT * FROM k WHERE r <= 2) k USING (l_orderkey, l_suppkey)""",
    "derangement": f"""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {unit_sql(0, 'c_custkey')}, c_custkey) - 1 AS i,
    count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
  SELECT a.c_nationkey, a.c_custkey, b.c_custkey AS donor FROM r a JOIN r b ON a.c_nationkey = b.c_nationkey AND b.i = (a.i + 1) % a.n WHERE a.n >= 2""",
    "balanced_classes": "SELECT c_mktsegment, c_custkey FROM ("
    + _hash_rank("c_mktsegment, c_custkey", "customer", "c_mktsegment", "c_custkey", "rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment))")
    + ")",
    "tie_rank": """SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0::DOUBLE AS tie_rank
  FROM lineitem""",
    "first_seen": "WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY f, event_type) AS seen FROM f GROUP BY 1",
    "dedup_hamming": f"""WITH h AS (SELECT vec_id AS id, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)) AS HUGEINT) AS h FROM embeddings),
  r AS (SELECT id, xor(h, CAST({MASKS}[id % 8 + 1] AS HUGEINT)) AS h FROM h WHERE id % 5 = 0)
  SELECT h.id AS l, r.id AS r, CAST(bit_count(xor(h.h, r.h)) AS INT) AS distance FROM h JOIN r ON bit_count(xor(h.h, r.h)) <= 4""",
    "unpivot_pairs": """SELECT c_custkey, 0 AS side, c_name AS own, c_mktsegment AS partner FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment, c_name FROM customer""",
    "epoch_stripes": f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {unit_sql('0.1', 'o_orderkey')}, o_orderkey) - 1 AS rank FROM orders) SELECT o_orderkey, rank, rank % 4 AS worker FROM r",
    "shared_keys": "SELECT rec_key, qname FROM answers WHERE status = 200 AND model = 'nova-s' INTERSECT SELECT rec_key, qname FROM answers WHERE status = 200 AND model = 'nova-m'",
    "unanswered": "SELECT DISTINCT rec_key, source FROM records WHERE split IN ('calibration', 'validation', 'test') AND rec_key NOT IN (SELECT rec_key FROM answers WHERE rec_key IS NOT NULL)",
    "unknown_answers": "SELECT model, count(DISTINCT answer_id) AS n FROM answers WHERE rec_key NOT IN (SELECT rec_key FROM records WHERE rec_key IS NOT NULL) GROUP BY model",
    "numbers_union": "SELECT coco_id AS image FROM records WHERE coco_id IS NOT NULL UNION SELECT image_id FROM coco_licenses WHERE image_id IS NOT NULL",
    "top_sources": "SELECT source, count(*) AS n FROM records GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem
  WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2""",
    "segment_revenue": """SELECT n_name, c_mktsegment, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS lines FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""",
}
QUERIES = {
    f.__name__: f
    for f in (
        pair_votes, rank_pairs, vote_histogram, soft_target, balanced_swap, negatives_topk, both_kinds, bbox_target, occlusion, reservoir, cumulative_limit, k_per_group,
        derangement, balanced_classes, tie_rank, first_seen, dedup_hamming, unpivot_pairs, epoch_stripes, shared_keys, unanswered, unknown_answers, numbers_union,
        top_sources, pricing_summary, segment_revenue,
    )
}
