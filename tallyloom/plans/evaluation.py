"""Queries over model answers, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.rng import draw_sql, poisson_sql, unit, unit_sql
from tallyloom.operators import evaluation as E
from tallyloom.tables import table

ONCE = """once AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY answered_at ASC NULLS LAST, rec_key ASC NULLS LAST) AS _n
  FROM answers) WHERE _n = 1)"""
ARG = "(list_position({0}, list_max({0})) - 1)"
SCORED = f"""{ONCE}, scored AS (SELECT *,
  CAST({ARG.format('pred')} = {ARG.format('target')} AS INT) AS correct,
  list_sum(list_transform(target, lambda t, i: (coalesce(pred[i], 0) - t) * (coalesce(pred[i], 0) - t))) AS brier,
  -list_sum(list_transform(target, lambda t, i: CASE WHEN t > 0 THEN t * ln(greatest(pred[i], 1e-12)) ELSE 0 END)) AS nll,
  CASE WHEN qtype = 'noul' THEN list_max(pred) WHEN len(pred) = 1 THEN 1.0
    ELSE (list_max(pred) - 1.0::DOUBLE / len(pred)) / (1.0::DOUBLE - 1.0::DOUBLE / len(pred)) END AS conf,
  list_max(pred) AS top
  FROM once WHERE status = 200 AND pred IS NOT NULL AND target IS NOT NULL AND rec_key IN (SELECT rec_key FROM records))"""
BIN = "least(greatest(CAST(floor({0} * 10) AS INT), 0), 9)"


def rows(spark, d):
    """Scored answers of a data folder."""
    return E.scored(table(spark, d, "answers"), table(spark, d, "records"))


def eval_accuracy_by_source(spark, d):
    return E.summary(rows(spark, d), "source")


def eval_by_type(spark, d):
    return E.summary(rows(spark, d), "model", "qtype")


def eval_reliability(spark, d):
    return E.reliability(rows(spark, d), spark)


def eval_ece(spark, d):
    r = rows(spark, d)
    return E.ece(r, "conf", "ece").join(E.ece(r, "top", "ece_max_prob"), "model")


def eval_coverage(spark, d):
    return E.coverage(rows(spark, d))


def eval_auroc(spark, d):
    return E.auroc(rows(spark, d))


def eval_macro_f1(spark, d):
    return E.macro_f1(rows(spark, d))


def eval_stability(spark, d):
    return E.stability(rows(spark, d))


def eval_latency(spark, d):
    return E.latency(table(spark, d, "answers"))


def eval_errors(spark, d):
    return E.errors(table(spark, d, "answers"))


def eval_confidence_buckets(spark, d):
    return E.confidence_buckets(rows(spark, d))


def eval_skill(spark, d):
    return E.skill(rows(spark, d))


def eval_meter(spark, d):
    return E.meter(rows(spark, d))


def eval_row_loss(spark, d):
    return E.row_loss(rows(spark, d))


def eval_divergence(spark, d):
    return E.divergence(rows(spark, d), "nova-s", "nova-m")


def gate_paired(spark, d):
    return E.gate(E.clustered(E.paired(rows(spark, d), "nova-s", "nova-m"), table(spark, d, "records")))


def eval_noise_floor(spark, d):
    return E.noise_floor(rows(spark, d))


def eval_ece_interval(spark, d):
    return E.ece_interval(rows(spark, d))


def flip_probe(spark, d):
    """Flip pairs are mostly train records without answers, so a hash stands in for the model."""
    records = table(spark, d, "records")
    u = unit(7, F.col("rec_key"), F.col("q.name"))
    asked = records.where("flip_group is not null").select("rec_key", F.explode("questions").alias("q")).distinct()
    fake = asked.select("rec_key", F.col("q.name").alias("qname"), F.lit("hash").alias("model"), F.array(u, 1 - u).alias("pred"), F.col("q.target").alias("target"))
    return E.flip_probe(fake, records)


def _summary(keys: str) -> str:
    return f"""WITH {SCORED} SELECT {keys}, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(brier), 6) AS brier, round(avg(nll), 6) AS nll,
  round(avg(conf), 6) AS confidence FROM scored GROUP BY {keys}"""


def _ece(conf: str, name: str) -> str:
    return f"""SELECT model, round(sum(abs(k - c)) / sum(n), 6) AS {name} FROM (SELECT model, {BIN.format(conf)} AS bin, count(*) AS n, sum(correct) AS k,
  sum({conf}) AS c FROM scored GROUP BY ALL) GROUP BY model"""


ORACLE_SQL = {
    "eval_accuracy_by_source": _summary("source"),
    "eval_by_type": _summary("model, qtype"),
    "eval_reliability": f"""WITH {SCORED}, cells AS (SELECT model, {BIN.format('conf')} AS bin, count(*) AS n, avg(correct) AS a, avg(conf) AS c FROM scored GROUP BY ALL)
  SELECT m.model, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n, round(a, 6) AS accuracy, round(c, 6) AS confidence
  FROM (SELECT DISTINCT model FROM scored) m CROSS JOIN range(10) b(bin) LEFT JOIN cells ON cells.model = m.model AND cells.bin = b.bin""",
    "eval_ece": f"WITH {SCORED} SELECT * FROM ({_ece('conf', 'ece')}) JOIN ({_ece('top', 'ece_max_prob')}) USING (model)",
    "eval_coverage": f"""WITH {SCORED}, t AS (SELECT CAST(s AS INT) AS s FROM range(50, 100) r(s)), a AS (SELECT model, count(*) AS total FROM scored GROUP BY 1)
  SELECT a.model, t.s / 100.0::DOUBLE AS threshold, round(count(x.conf) / any_value(total)::DOUBLE, 6) AS coverage, round(avg(x.correct), 6) AS accuracy
  FROM a CROSS JOIN t LEFT JOIN scored x ON x.model = a.model AND round(x.conf * 100, 9) >= t.s GROUP BY a.model, t.s""",
    "eval_auroc": f"""WITH {SCORED}, y AS (SELECT model, round(pred[1], 9) AS s, CAST(target[1] >= 0.5 AS INT) AS y FROM scored WHERE qtype = 'noul'),
  r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0::DOUBLE AS r FROM y)
  SELECT model, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives, round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN
  (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))::DOUBLE) END, 6) AS auroc FROM r GROUP BY model""",
    "eval_macro_f1": f"""WITH {SCORED}, l AS (SELECT model, qtype, labels[{ARG.format('target')} + 1] AS y, labels[{ARG.format('pred')} + 1] AS p FROM scored),
  c AS (SELECT model, qtype, y AS c FROM l UNION SELECT model, qtype, p FROM l),
  f AS (SELECT c.model, c.qtype, c.c, count(*) FILTER (l.y = c.c AND l.p = c.c) AS tp, count(*) FILTER (l.y = c.c) AS t, count(*) FILTER (l.p = c.c) AS f
    FROM c JOIN l ON l.model = c.model AND l.qtype = c.qtype GROUP BY ALL)
  SELECT model, CASE WHEN grouping(qtype) = 1 THEN 'all' ELSE qtype END AS qtype, count(*) AS classes, round(avg(2.0::DOUBLE * tp / (t + f)), 6) AS macro_f1 FROM f GROUP BY GROUPING SETS ((model, qtype), (model))""",
    "eval_stability": f"""WITH {SCORED}, s AS (SELECT *, CASE WHEN qtype IN ('choice', 'score') AND pred_reversed IS NOT NULL THEN
    CAST({ARG.format('pred')} <> {ARG.format('pred_reversed')} AS INT) END AS turned,
    CASE WHEN qtype = 'noul' AND pred_negated IS NOT NULL THEN abs(pred[1] + pred_negated - 1) END AS gap,
    list_max(list_transform(pred, lambda p, i: abs(p - pred_reversed[i]))) AS change FROM scored)
  SELECT model, count(turned) AS order_pairs, round(avg(turned), 6) AS order_flip_rate, round(max(change), 6) AS order_max_change, count(gap) AS negated,
  round(avg(gap), 6) AS negation_gap FROM s GROUP BY model""",
    "eval_latency": f"""WITH {ONCE}, f AS (SELECT model, rec_key, arg_min(latency_ms, (answered_at, answer_id)) FILTER (latency_ms IS NOT NULL) AS ms FROM once GROUP BY 1, 2)
  SELECT model, count(ms) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95::DOUBLE), 6) AS p95, round(avg(ms), 6) AS mean FROM f GROUP BY model""",
    "eval_errors": f"""WITH {ONCE}, b AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY answer_id) AS k FROM once WHERE status <> 200)
  SELECT CAST(status AS VARCHAR) AS status, count(*) AS n, string_agg(CAST(answer_id AS VARCHAR), ',' ORDER BY answer_id) FILTER (k <= 5) AS first_five FROM b GROUP BY status""",
    "eval_confidence_buckets": f"""WITH {SCORED} SELECT model, count(DISTINCT round_even(conf, 12)) AS distinct_conf, count(*) FILTER (conf >= 1 - 1e-9) AS sure,
  count(*) FILTER (conf >= 1 - 1e-9 AND correct = 0) AS sure_wrong FROM scored GROUP BY model""",
    "eval_skill": f"""WITH {SCORED}, b AS (SELECT model, source, count(*) AS n, avg(correct) AS acc, avg(1.0::DOUBLE / len(labels)) AS chance FROM scored GROUP BY 1, 2)
  SELECT model, count(*) AS sources, round(avg((acc - chance) / (1 - chance)), 6) AS skill, round(sum((acc - chance) / (1 - chance) * n) / sum(n), 6) AS weighted_skill
  FROM b GROUP BY model""",
    "eval_meter": f"""WITH {SCORED}, m AS (SELECT *, CAST(CASE WHEN qtype = 'noul' THEN (pred[1] > 0.5) = (target[1] > 0.5) ELSE correct = 1 END AS INT) AS r FROM scored)
  SELECT CASE WHEN grouping(qtype) = 1 THEN 'all' ELSE qtype END AS qtype, count(*) AS n, round(avg(r), 6) AS accuracy, round(avg(brier), 6) AS brier, round(avg(nll), 6) AS nll
  FROM m GROUP BY ROLLUP (qtype)""",
    "eval_row_loss": f"""WITH {SCORED}, e AS (SELECT *, nll + 0.1::DOUBLE * brier + 0.05::DOUBLE * CASE WHEN qtype = 'score' THEN
    ((list_sum(list_transform(pred, lambda p, i: p * (i - 1))) - list_sum(list_transform(target, lambda p, i: p * (i - 1)))) / greatest(len(target) - 1, 1)) ** 2 ELSE 0 END AS loss FROM scored)
  SELECT model, qtype, round(avg(loss), 6) AS loss, round(max(loss), 6) AS worst FROM e GROUP BY 1, 2""",
    "eval_divergence": f"""WITH {SCORED} SELECT a.source, count(*) AS n, round(avg(list_sum(list_transform(a.pred, lambda p, i: CASE WHEN p > 0 THEN
  p * ln(p / greatest(b.pred[i], 1e-12)) ELSE 0 END))), 6) AS kl FROM scored a JOIN scored b ON a.rec_key = b.rec_key AND a.qname = b.qname
  WHERE a.model = 'nova-s' AND b.model = 'nova-m' GROUP BY a.source""",
    "gate_paired": f"""WITH {SCORED}, own AS (SELECT rec_key, min(CASE WHEN trim(cluster, ' ') NOT IN ('', '-', 'nan', 'None') THEN trim(cluster, ' ') END) AS own FROM records WHERE rec_key IS NOT NULL GROUP BY 1),
  j AS (SELECT a.rec_key, a.qname, own, coalesce('c/' || own, 'r/' || a.rec_key) AS unit, a.correct - b.correct AS d, a.brier - b.brier AS e FROM scored a JOIN scored b
    ON a.rec_key = b.rec_key AND a.qname = b.qname LEFT JOIN own ON own.rec_key = a.rec_key WHERE a.model = 'nova-s' AND b.model = 'nova-m'),
  p AS (SELECT d, e, CASE WHEN (SELECT count(own) = 0 OR count(DISTINCT unit) < 20 FROM j) THEN 'q/' || rec_key || '/' || qname ELSE unit END AS cluster FROM j),
  c AS (SELECT cluster, sum(d) AS d, sum(e) AS e, count(*) AS m FROM p GROUP BY 1),
  w AS (SELECT rep, d, e, m, {poisson_sql(draw_sql(0, ['cluster'], 4))} AS w FROM c CROSS JOIN range(4000) r(rep)),
  s AS (SELECT rep, round(sum(w * d) / nullif(sum(w * m), 0)::DOUBLE, 9) AS x, round(sum(w * e) / nullif(sum(w * m), 0)::DOUBLE, 9) AS y FROM w GROUP BY rep),
  b AS (SELECT (list_sort(list(x)))[101] AS lo, (list_sort(list(x)))[3900] AS hi, (list_sort(list(y)))[101] AS blo FROM s),
  t AS (SELECT count(*) AS n, avg(d) AS d, avg(e) AS e FROM p)
  SELECT n, round(d, 6) AS delta_accuracy, round(e, 6) AS delta_brier, round(lo, 6) AS acc_lo, round(hi, 6) AS acc_hi, round(blo, 6) AS brier_lo,
  CASE WHEN n = 0 THEN 'fail: nothing shared' WHEN hi < 0 OR (n >= 600 AND d < -0.03) OR blo > 0 THEN 'fail' WHEN lo > 0 THEN 'better' ELSE 'pass' END AS verdict FROM t, b""",
    "eval_noise_floor": f"""WITH {SCORED}, e AS (SELECT model, top, rep, {ARG.format('pred')} AS best, ('0x' || {draw_sql(0, ['answer_id'], 8)})::UBIGINT::DOUBLE / 4294967296.0 AS u, target FROM scored CROSS JOIN range(200) r(rep)),
  h AS (SELECT model, rep, top, CAST(len(list_filter(range(1, len(target)), lambda i: u >= round(list_sum(target[1:i]), 9))) = best AS INT) AS hit FROM e),
  c AS (SELECT model, rep, {BIN.format('top')} AS bin, count(*) AS n, sum(hit) AS k, sum(top) AS c FROM h GROUP BY ALL)
  SELECT model, round(avg(e), 6) AS noise_floor FROM (SELECT model, rep, sum(abs(k - c)) / sum(n) AS e FROM c GROUP BY 1, 2) GROUP BY model""",
    "eval_ece_interval": f"""WITH {SCORED}, w AS (SELECT model, rep, conf, correct, {poisson_sql(draw_sql(1, ['answer_id'], 4))} AS w FROM scored CROSS JOIN range(1000) r(rep)),
  c AS (SELECT model, rep, {BIN.format('conf')} AS bin, sum(w) AS n, sum(w * correct) AS k, sum(w * conf) AS c FROM w GROUP BY ALL),
  p AS (SELECT model, rep, sum(abs(k - c)) / nullif(sum(n), 0) AS e FROM c GROUP BY 1, 2)
  SELECT model, round(quantile_cont(e, 0.025::DOUBLE), 6) AS lo, round(quantile_cont(e, 0.975::DOUBLE), 6) AS hi FROM p GROUP BY model""",
    "flip_probe": f"""WITH q AS (SELECT DISTINCT rec_key, flip_group AS g, flip_kind AS kind, unnest(questions) AS q FROM records WHERE flip_group IS NOT NULL AND rec_key IS NOT NULL),
  a AS (SELECT rec_key, g, kind, {unit_sql(7, 'rec_key', 'q.name')} AS u, coalesce(q.target[1] > 0.5, false) AS t FROM q WHERE q.name = 'q1' AND q.type = 'noul'),
  r AS (SELECT g, max(rec_key) FILTER (t) AS t, max(rec_key) FILTER (NOT t) AS f, coalesce(arg_max(kind, rec_key), 'all') AS kind FROM a GROUP BY g),
  p AS (SELECT unnest(list_distinct([kind, 'all'])) AS kind, hi.u AS hi, lo.u AS lo FROM r JOIN (SELECT DISTINCT rec_key, u FROM a) hi ON hi.rec_key = r.t JOIN (SELECT DISTINCT rec_key, u FROM a) lo ON lo.rec_key = r.f)
  SELECT kind, count(*) AS n, round(avg(hi - lo), 6) AS margin, round(avg(CAST(hi > lo AS INT)), 6) AS ordered,
  round(avg(CAST(hi > 0.5 AND lo > 0.5 AS INT)), 6) AS both_hi, round(avg(CAST(hi < 0.5 AND lo < 0.5 AS INT)), 6) AS both_lo FROM p GROUP BY kind""",
}
QUERIES = {
    f.__name__: f
    for f in (
        eval_accuracy_by_source, eval_by_type, eval_reliability, eval_ece, eval_coverage, eval_auroc, eval_macro_f1, eval_stability, eval_latency, eval_errors,
        eval_confidence_buckets, eval_skill, eval_meter, eval_row_loss, eval_divergence, gate_paired, eval_noise_floor, eval_ece_interval, flip_probe,
    )
}
