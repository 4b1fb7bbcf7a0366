"""Queries of the operators of this folder, over whole tables."""

from __future__ import annotations

from tallyloom.llm import lookalike, mixture, overlap, spans, splits, tokenize
from tallyloom.plans.pipeline import ONCE, TEXT
from tallyloom.tables import table


def p1_found(spark, d):
    """Records tied to others, with the smallest record of their group."""
    return splits.tied_groups(table(spark, d, "records")).where("tied").select("rec_key", "group_key")


def p1_splits(spark, d):
    """The split of every record."""
    groups = splits.tied_groups(table(spark, d, "records"))
    return splits.assign_splits(groups, table(spark, d, "split_targets"))


def p1_report(spark, d):
    """Target and actual share of every split."""
    return splits.split_report(p1_splits(spark, d), table(spark, d, "split_targets"))


def p2_found(spark, d):
    """Question texts that look like a wording but are written differently."""
    return lookalike.alike(table(spark, d, "records"), table(spark, d, "wordings"))


def p2_forms(spark, d):
    """The one form of every question text."""
    texts = lookalike.record_texts(table(spark, d, "records")).distinct()
    return lookalike.with_form(texts, "text").select("rec_key", "qname", "opt_pos", "form")


def p4_found(spark, d):
    """Train and evaluation records that share an image or a text."""
    return overlap.found(table(spark, d, "records"))


def p4_report(spark, d):
    """Overlaps by split, source and kind."""
    return overlap.report(table(spark, d, "records"))


def p5_ids(spark, d):
    """Token ids of every document."""
    return tokenize.encode(table(spark, d, "documents"))


def p5_sizes(spark, d):
    """Documents and tokens by language."""
    from pyspark.sql import functions as F

    n = tokenize.token_counts(table(spark, d, "documents"), ["doc_id", "lang"])
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))


def p6_mix(spark, d):
    """The mix of all sources, in order."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p6_shares(spark, d):
    """Target and actual share of every source in the mix."""
    return mixture.shares(p6_mix(spark, d), table(spark, d, "mix_targets"))


def p6_full_shares(spark, d):
    """Shares in the largest mix in which every source with documents reaches its target."""
    t = table(spark, d, "mix_targets")
    return mixture.shares(mixture.mix(table(spark, d, "documents"), t, "shares"), t)


def p7_found(spark, d):
    """Runs of characters that stand verbatim in another document."""
    return spans.shared_spans(table(spark, d, "documents"))


def p7_fractions(spark, d):
    """How much of each document stands elsewhere."""
    return spans.shared_fractions(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_report, p2_found, p2_forms, p4_found, p4_report, p5_ids, p5_sizes, p6_mix, p6_shares, p6_full_shares, p7_found, p7_fractions)
}
_USABLE = "CASE WHEN trim({0}, ' ') NOT IN ('', '-', 'nan', 'None') THEN trim({0}, ' ') END"
_TIED = f"""RECURSIVE k AS (SELECT DISTINCT rec_key, source, {_USABLE.format('grid_id')} AS g, {_USABLE.format('cluster')} AS c FROM records WHERE rec_key IS NOT NULL),
  m AS (SELECT rec_key, 'g:' || CASE WHEN contains(g, '/') THEN g ELSE coalesce(source, '') || '/' || g END AS key FROM k WHERE g IS NOT NULL UNION SELECT rec_key, 'c:' || c FROM k WHERE c IS NOT NULL),
  e AS (SELECT DISTINCT a.key AS a, b.key AS b FROM m a JOIN m b USING (rec_key)),
  r AS (SELECT a AS k, a AS t FROM e UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.t),
  s AS (SELECT key, min(rec_key) AS lo, max(rec_key) AS hi FROM m GROUP BY 1),
  g AS (SELECT r.k, min(lo) AS lo, max(hi) AS hi FROM r JOIN s ON s.key = r.t GROUP BY 1)"""
_NUMBER = r"coalesce(nullif(regexp_extract(p, 'COCO_[A-Za-z]+[0-9]{4}_0*([0-9]+)[^/]*$', 1), ''), nullif(regexp_extract(p, '(?:^|/)(?:train|val)[0-9]{4}/0*([0-9]+)[^/]*$', 1), ''))"
_GRAMS = "SELECT text, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 1, 2)), lambda i: substring(text, i, 3)))) AS p FROM {0}"
_CROSS = f"""{ONCE}, {TEXT}, sided AS (SELECT rec_key, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, text FROM text
    WHERE split IN ('train', 'calibration', 'validation', 'test') AND text <> '' AND (NOT pictured OR length(text) >= 200)),
  t0 AS (SELECT DISTINCT text FROM sided WHERE side = 0), t1 AS (SELECT DISTINCT text FROM sided WHERE side = 1),
  p0 AS ({_GRAMS.format('t0')}), p1 AS ({_GRAMS.format('t1')}), n0 AS (SELECT text, count(*) AS n FROM p0 GROUP BY 1), n1 AS (SELECT text, count(*) AS n FROM p1 GROUP BY 1),
  b AS (SELECT p0.text AS x, p1.text AS y, count(*) AS c FROM p0 JOIN p1 USING (p) GROUP BY 1, 2),
  alike AS (SELECT x, y FROM b JOIN n0 ON n0.text = x JOIN n1 ON n1.text = y WHERE c >= 0.8 * (n0.n + n1.n - c)),
  path AS (SELECT rec_key, split, unnest(list_filter(flatten(list_transform(coalesce(images, []), lambda i: [i.path, i.url])), lambda x: x IS NOT NULL)) AS p FROM once),
  num AS (SELECT rec_key, split, TRY_CAST({_NUMBER} AS BIGINT) AS n FROM path UNION SELECT rec_key, split, coco_id FROM once),
  pair AS (SELECT a.rec_key AS x, b.rec_key AS y FROM alike JOIN sided a ON a.side = 0 AND a.text = alike.x JOIN sided b ON b.side = 1 AND b.text = alike.y
    UNION SELECT a.rec_key, b.rec_key FROM num a JOIN num b ON a.n = b.n WHERE a.split = 'train' AND b.split IN ('calibration', 'validation', 'test'))"""
_RUNS = """w AS (SELECT DISTINCT doc_id, i - 1 AS pos, substring(text, i, 120) AS w FROM documents, range(1, greatest(length(text) - 118, 1)) r(i) WHERE doc_id IS NOT NULL AND length(text) >= 120),
  s AS (SELECT doc_id, pos FROM w WHERE w IN (SELECT w FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id))),
  f AS (SELECT *, CAST(pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), pos) + 120 AS INT) AS new FROM s),
  g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM f),
  runs AS (SELECT doc_id, min(pos) AS start_pos, max(pos) - min(pos) + 120 AS span_chars FROM g GROUP BY doc_id, run)"""
# plain definitions without the methods: closure over keys, all pairs of texts with a piece in common, all windows
ORACLE_SQL: dict[str, str] = {
    "p1_found": f"WITH {_TIED} SELECT DISTINCT rec_key, lo AS group_key FROM m JOIN g ON g.k = m.key WHERE lo <> hi",
    "p4_found": f"WITH {_CROSS} SELECT DISTINCT least(x, y) AS rec_a, greatest(x, y) AS rec_b FROM pair WHERE x <> y",
    "p7_found": f"WITH {_RUNS} SELECT doc_id, CAST(start_pos AS BIGINT) AS start_pos, CAST(span_chars AS BIGINT) AS span_chars FROM runs",
    "p7_fractions": f"""WITH {_RUNS}, d AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1), t AS (SELECT doc_id, sum(span_chars) AS s FROM runs GROUP BY 1)
  SELECT doc_id, CAST(n AS BIGINT) AS n_chars, CAST(coalesce(s, 0) AS BIGINT) AS shared_chars, round(CASE WHEN n > 0 THEN coalesce(s, 0) / n::DOUBLE ELSE 0 END, 6) AS shared_fraction FROM d LEFT JOIN t USING (doc_id)""",
}
