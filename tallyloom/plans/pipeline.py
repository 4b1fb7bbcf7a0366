"""Queries over building a training set, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.rng import unit_sql
from tallyloom.operators import pipeline as P
from tallyloom.tables import table
from tallyloom.workspace import Workspace

ONCE = """once AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY rec_key ORDER BY loaded_at ASC NULLS LAST, id ASC NULLS LAST) AS _n
  FROM records WHERE rec_key IS NOT NULL) WHERE _n = 1)"""
BLANK = "(grid_id IS NULL OR trim(grid_id, ' ') IN ('', '-', 'nan', 'None'))"
EXCLUDE, NEED_IMAGE = ("mossforum",), ("harborvqa_mc",)
# strings of a state in written order, what stands under ``image`` left out; with numbers and words for lengths
_OUTSIDE = r"NOT regexp_matches(t.fullkey, '\.image(\.|\[|$)')"
_TREE = "json_tree(CASE WHEN json_valid(state_json) THEN state_json ELSE 'null' END) t"
LEAF = f"""leaf AS (SELECT rec_key, string_agg(t.atom ->> '$', ' ' ORDER BY t.id) FILTER (t.type = 'VARCHAR') AS strings,
    string_agg(CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' ELSE CAST(t.atom AS VARCHAR) END, ' ' ORDER BY t.id) FILTER (t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')) AS all_leaves
    FROM once, {_TREE} WHERE {_OUTSIDE} GROUP BY rec_key)"""
TEXT = f"""{LEAF}, text AS (SELECT r.rec_key, split, coalesce(len(images), 0) > 0 AS pictured, lower(trim(regexp_replace(concat_ws(' ',
    CASE WHEN json_valid(state_json) THEN coalesce(strings, '') ELSE state_json END, array_to_string(list_transform(questions, lambda q: coalesce(q.instructions, '')), ' ')), '{T.BLANKS}+', ' ', 'g'), ' ')) AS text
    FROM once r LEFT JOIN leaf USING (rec_key))"""
HELD = "split IN ('calibration', 'validation', 'test')"
# every pair of texts that have a piece in common, decided by all pieces
NEAR = f"""{TEXT}, mine AS (SELECT DISTINCT text FROM text WHERE split = 'train' AND text <> '' AND (NOT pictured OR length(text) >= 200)),
  theirs AS (SELECT DISTINCT text FROM text WHERE {HELD} AND text <> ''),
  p_mine AS (SELECT text, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 1, 2)), lambda i: substring(text, i, 3)))) AS p FROM mine),
  p_theirs AS (SELECT text, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 1, 2)), lambda i: substring(text, i, 3)))) AS p FROM theirs),
  n_mine AS (SELECT text, count(*) AS n FROM p_mine GROUP BY 1), n_theirs AS (SELECT text, count(*) AS n FROM p_theirs GROUP BY 1),
  both_of AS (SELECT a.text AS x, b.text AS y, count(*) AS c FROM p_mine a JOIN p_theirs b USING (p) GROUP BY 1, 2),
  near_text AS (SELECT DISTINCT x AS text FROM both_of JOIN n_mine a ON a.text = x JOIN n_theirs b ON b.text = y WHERE c >= 0.8 * (a.n + b.n - c))"""
_PATHS = "list_filter(flatten(list_transform(coalesce(images, []), lambda i: [i.path, i.url])), lambda x: x IS NOT NULL)"
_IN_HELD = r"nullif(regexp_extract(p, 'COCO_val20(?:14|17)_0*([0-9]+)', 1), '')"
_IN_ANY = r"coalesce(nullif(regexp_extract(p, 'COCO_(?:train|val|test)20[0-9][0-9]_0*([0-9]+)', 1), ''), nullif(regexp_extract(p, '(?:train|val)20(?:14|17)[/\\]0*([0-9]+)\.', 1), ''))"
NUMBERS = f"""path AS (SELECT rec_key, split, unnest({_PATHS}) AS p FROM once),
  held_number AS (SELECT TRY_CAST({_IN_HELD} AS BIGINT) AS number FROM path WHERE {HELD} UNION SELECT coco_id FROM once WHERE {HELD}),
  my_number AS (SELECT rec_key, TRY_CAST({_IN_ANY} AS BIGINT) AS number FROM path WHERE split = 'train' UNION SELECT rec_key, coco_id FROM once WHERE split = 'train'),
  near_id AS (SELECT DISTINCT rec_key FROM my_number JOIN held_number USING (number))"""
LICENSED = f"""{ONCE}, tier AS (SELECT trim(source, ' ') AS source, max(tier) AS tier FROM license_tiers GROUP BY 1),
  by_id AS (SELECT image_id, min(license_id) AS by_id FROM coco_licenses WHERE image_id IS NOT NULL GROUP BY 1),
  by_name AS (SELECT file_name, min(license_id) AS by_name FROM coco_licenses WHERE file_name IS NOT NULL GROUP BY 1),
  full_r AS (SELECT r.*, CASE WHEN tier = 'copyleft' THEN 'non-commercial' WHEN tier IN ('commercial-ok', 'non-commercial', 'unknown') THEN tier
    ELSE 'unknown' END AS tier_license, coalesce(by_id, by_name) AS image_license
    FROM once r LEFT JOIN tier ON tier.source = r.source LEFT JOIN by_id ON by_id.image_id = r.coco_id LEFT JOIN by_name ON by_name.file_name = CAST(r.coco_id AS VARCHAR))"""
REASON = f"""{LICENSED}, {NEAR}, {NUMBERS},
  reasoned AS (SELECT f.*, CASE WHEN source IN ('mossforum') THEN 'excluded source' WHEN tier_license <> 'commercial-ok' THEN 'license'
    WHEN coco_id IS NOT NULL AND NOT coalesce(image_license IN (4, 5, 6, 7, 8), false) THEN 'image license'
    WHEN coco_id IS NULL AND source IN ('harborvqa_mc') THEN 'image number'
    WHEN f.split = 'train' AND (NOT t.pictured OR length(t.text) >= 200) AND t.text IN (SELECT text FROM near_text) THEN 'held out text'
    WHEN f.rec_key IN (SELECT rec_key FROM near_id) THEN 'held out id' END AS reason FROM full_r f JOIN text t USING (rec_key))"""
KEPT = f"{REASON}, kept AS (SELECT * FROM reasoned WHERE reason IS NULL)"
# a state's members sorted by their path: equal for states that differ only in spelling and order
KEYED = f"""{KEPT}, k AS (SELECT kept.*, coalesce(key, state_json) AS state_key FROM kept LEFT JOIN
  (SELECT rec_key, string_agg(t.fullkey || ' ' || t.type || ' ' || coalesce(CAST(t.atom AS VARCHAR), ''), chr(10) ORDER BY t.fullkey) AS key FROM kept, {_TREE} WHERE json_valid(state_json) GROUP BY 1) USING (rec_key) WHERE NOT {BLANK})"""


def once(spark, d):
    """Each record of a data folder once."""
    return P.once(table(spark, d, "records"))


def reasoned(spark, d):
    """Records with the reason that drops them."""
    r = once(spark, d)
    return P.drop_reasons(r, table(spark, d, "license_tiers"), table(spark, d, "coco_licenses"), EXCLUDE, NEED_IMAGE, P.held_out_hits(r))


def kept(spark, d):
    """Records that no rule drops."""
    return reasoned(spark, d).where("reason is null")


def kept_table(spark, d):
    """Kept records as a table, for operators that read them more than once."""
    cols = ("rec_key", "id", "source", "split", "license", "lang", "grid_id", "cluster", "coco_id", "flip_group", "flip_kind", "state_json", "questions")
    return Workspace(spark).put(kept(spark, d).select(*cols), "kept")


def record_validate(spark, d):
    """Messages of the validator with the number of records they hit."""
    messages = P.record_errors(once(spark, d)).select("source", F.explode(F.array_distinct("errors")).alias("error"))
    return messages.groupBy("source", F.regexp_replace("error", "^q[0-9]+: ", "q: ").alias("error")).agg(F.count("*").alias("n"))


def license_filter(spark, d):
    t = P.tiered(once(spark, d), table(spark, d, "license_tiers"))
    return t.groupBy("source", "tier_license").agg(F.count("*").alias("n"))


def coco_license(spark, d):
    r = P.image_licensed(once(spark, d), table(spark, d, "coco_licenses")).where("coco_id is not null")
    return r.groupBy("image_license").agg(F.count("*").alias("n"))


def drop_attribution(spark, d):
    return reasoned(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def manifest_sources(spark, d):
    return P.manifest(reasoned(spark, d))


def manifest_totals(spark, d):
    return P.totals(kept(spark, d))


def qa_source_stats(spark, d):
    return P.quality(once(spark, d))


def dup_ids(spark, d):
    return P.duplicate_ids(table(spark, d, "records"))


def dup_questions(spark, d):
    return P.duplicate_questions(once(spark, d))


def split_hash(spark, d):
    r = once(spark, d).where("grid_id is not null").select("grid_id").distinct()
    return r.groupBy(P.by_hash(F.col("grid_id")).alias("split")).agg(F.count("*").alias("grids"))


def split_coverage(spark, d):
    return P.covered_splits(kept(spark, d))


def grid_groups(spark, d):
    return P.grid_groups(kept(spark, d)).drop("state_key")


def grid_chunks(spark, d):
    """Questions of the kept records by the chunk they go to, named by the first record of their state."""
    k = kept_table(spark, d)
    c, g = P.chunked(k), P.grid_groups(k).select("source", "grid_id", "state_key", "first")
    return c.join(g, ["source", "grid_id", "state_key"]).select("first", "rec_key", "name", "derived", "chunk", "new_name")


def grid_records(spark, d):
    return P.grid_records(kept_table(spark, d))


def dedup_jaccard(spark, d):
    """Train records whose text is at least 80 % the same as a held-out text."""
    return P.held_out_hits(once(spark, d)).where("by_text").select("rec_key")


def grid_record_ids(spark, d):
    return P.grid_ids(kept(spark, d))


def derive_yes_no(spark, d):
    return P.derived_yes_no(once(spark, d))


def grid_shared_meta(spark, d):
    return P.shared_meta(kept(spark, d))


def question_language(spark, d):
    q = once(spark, d).select("lang", F.explode("questions").alias("q"))
    return q.groupBy(P.language(F.col("q.instructions"), F.col("lang")).alias("qlang"), "lang").agg(F.count("*").alias("n"))


def instruction_join(spark, d):
    q = once(spark, d).select("rec_key", "lang", F.explode("questions").alias("q"))
    zh = P.language(F.col("q.instructions"), F.col("lang")) == "zh"
    return q.select("rec_key", F.col("q.name").alias("qname"), P.joined(F.col("q.instructions"), F.lit("(yes/no)"), zh).alias("asked"))


_BY_HASH = "CASE WHEN {h} < 0.03 THEN 'calibration' WHEN {h} < 0.06 THEN 'validation' ELSE 'train' END"
_H = "(('0x' || substr(sha256(grid_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_U = lambda k: unit_sql(f"0.{k}", "rec_key", "name")
_QS = f"{ONCE}, q AS (SELECT rec_key, source, lang, unnest(questions) AS q FROM once), qs AS (SELECT rec_key, source, lang, q.name AS name, q.type AS type, q.instructions AS instructions, q.criteria AS criteria, q.target AS target, q.negated AS negated FROM q)"
_LANG = "CASE WHEN regexp_matches(coalesce(instructions, ''), '[一-鿿]') THEN 'zh' WHEN coalesce(instructions, '') <> '' THEN 'en' ELSE lang END"
_VALID = f"""{ONCE}, own AS (SELECT rec_key, source, unnest([
    CASE WHEN coalesce(id, '') = '' THEN 'id is missing' END, CASE WHEN coalesce(source, '') = '' THEN 'source is missing' END,
    CASE WHEN coalesce(split, '') = '' THEN 'split is missing' END, CASE WHEN coalesce(lang, '') = '' THEN 'lang is missing' END,
    CASE WHEN license IS NULL OR license NOT IN ('commercial-ok', 'non-commercial', 'unknown') THEN 'license is not known' END,
    CASE WHEN state_json IS NULL OR trim(state_json, ' ') = 'null' THEN 'state is missing' END,
    CASE WHEN len(list_filter(images, lambda i: (i.path IS NULL) = (i.url IS NULL))) > 0 THEN 'an image needs one of path and url' END,
    CASE WHEN coalesce(len(questions), 0) = 0 THEN 'questions are missing' END, CASE WHEN {BLANK} AND split = 'train' THEN 'grid_id is missing' END]) AS error FROM once),
  qs AS (SELECT rec_key, source, unnest(questions) AS q FROM once),
  k AS (SELECT rec_key, source, q, coalesce(len(q.criteria), 0) AS k, coalesce(len(q.target), 0) AS n FROM qs),
  asked AS (SELECT rec_key, source, coalesce(q.name, '?') || ': ' || unnest([
    CASE WHEN coalesce(q.instructions, '') = '' THEN 'instructions are missing' END,
    CASE WHEN q.type IS NULL OR q.type NOT IN ('noul', 'choice', 'score') THEN 'unknown type' END,
    CASE WHEN q.type IN ('choice', 'score') AND (k < 1 OR k > 255) THEN '1 to 255 options are needed' END,
    CASE WHEN q.type = 'noul' AND k NOT IN (0, 1, 2) THEN 'yes/no has other options' END,
    CASE WHEN q.type IN ('choice', 'score') AND n <> k THEN 'target and options differ' END,
    CASE WHEN q.type = 'noul' AND n <> 2 THEN 'target needs two entries' END,
    CASE WHEN n > 0 AND abs(list_sum(q.target) - 1.0) > 1e-6 THEN 'target does not sum to 1' END,
    CASE WHEN len(list_filter(q.target, lambda t: t IS NULL OR t < 0 OR t > 1)) > 0 THEN 'target outside 0 to 1' END]) AS error FROM k),
  every AS (SELECT DISTINCT rec_key, source, error FROM (SELECT * FROM own UNION ALL SELECT * FROM asked) WHERE error IS NOT NULL)"""
_DERIVED = f"""c AS (SELECT *, list_filter(range(len(target)), lambda i: target[i + 1] = list_max(target)) AS best,
    list_filter(range(len(target)), lambda i: target[i + 1] <> list_max(target)) AS wrong FROM qs WHERE type = 'choice' AND len(target) >= 3 AND {_U('choice')} < 0.5),
  picked AS (SELECT *, CASE WHEN len(wrong) = 0 OR {_U('side')} < 0.5 THEN best ELSE wrong END AS pool FROM c),
  x AS (SELECT rec_key, name, 'choice' AS kind, CAST(pool[CAST(floor({_U('pick')} * len(pool)) AS INT) + 1] AS INT) AS pick, target FROM picked),
  s AS (SELECT rec_key, name, 'score' AS kind, CAST(floor({_U('level')} * (len(target) - 1)) AS INT) + 1 AS pick, target FROM qs
    WHERE type = 'score' AND len(target) >= 2 AND {_U('score')} < 0.3),
  derived AS (SELECT rec_key, name, kind, pick, round(target[pick + 1], 6) AS p FROM x
  UNION ALL SELECT rec_key, name, kind, pick, round(least(greatest(list_sum(target[pick + 1:]), 0.0), 1.0), 6) FROM s)"""
_GRID_NAME = "(CASE WHEN starts_with(grid_id, source || '/') THEN grid_id ELSE source || '/' || grid_id END)"
_GROUPS = f"""{KEYED}, g AS (SELECT source, grid_id, state_key, CAST(row_number() OVER (PARTITION BY source, grid_id ORDER BY min(rec_key)) - 1 AS INT) AS variant, min(rec_key) AS first,
    count(*) AS records, CAST(sum(len(questions)) AS BIGINT) AS questions FROM k GROUP BY source, grid_id, state_key)"""
_ITEM = "rec_key, name, derived"
_CHUNKS = f"""{_GROUPS}, q AS (SELECT rec_key, source, lang, unnest(questions) AS q FROM k), qs AS (SELECT rec_key, q.name AS name, q.type AS type, q.target AS target FROM q), {_DERIVED},
  pooled AS (SELECT k.source, k.grid_id, k.state_key, rec_key, name, d AS derived FROM k JOIN (SELECT rec_key, name, '' AS d FROM qs UNION ALL SELECT rec_key, name, kind FROM derived) USING (rec_key)),
  u AS (SELECT *, {unit_sql(0, 'rec_key', 'name', 'derived')} AS u, {unit_sql(1, 'rec_key', 'name', 'derived')} AS s, count(*) OVER (PARTITION BY source, grid_id, state_key) AS n FROM pooled),
  sl AS (SELECT *, floor(u * ceil(n / 4096)) AS slice FROM u),
  b AS (SELECT *, CAST(row_number() OVER w = 1 OR s < 0.35 AS INT) AS start FROM sl WINDOW w AS (PARTITION BY source, grid_id, state_key, slice ORDER BY u, {_ITEM})),
  r AS (SELECT *, sum(start) OVER (PARTITION BY source, grid_id, state_key, slice ORDER BY u, {_ITEM} ROWS UNBOUNDED PRECEDING) AS run FROM b),
  at_p AS (SELECT *, row_number() OVER (PARTITION BY source, grid_id, state_key, slice, run ORDER BY u, {_ITEM}) - 1 AS p FROM r),
  placed AS (SELECT at_p.*, g.variant, g.first, CAST(sum(CAST(p % 16 = 0 AS INT)) OVER (PARTITION BY source, grid_id, state_key ORDER BY slice, u, {_ITEM} ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS chunk,
    'q' || (p % 16 + 1) AS new_name FROM at_p JOIN g USING (source, grid_id, state_key))"""
ORACLE_SQL = {
    "record_validate": f"""WITH {_VALID}
  SELECT source, regexp_replace(error, '^q[0-9]+: ', 'q: ') AS error, count(*) AS n FROM every GROUP BY 1, 2""",
    "license_filter": f"WITH {LICENSED} SELECT source, tier_license, count(*) AS n FROM full_r GROUP BY 1, 2",
    "coco_license": f"WITH {LICENSED} SELECT image_license, count(*) AS n FROM full_r WHERE coco_id IS NOT NULL GROUP BY 1",
    "dedup_jaccard": f"WITH {ONCE}, {NEAR} SELECT rec_key FROM text WHERE split = 'train' AND (NOT pictured OR length(text) >= 200) AND text IN (SELECT text FROM near_text)",
    "drop_attribution": f"WITH {REASON} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM reasoned GROUP BY 1",
    "manifest_sources": f"""WITH {REASON} SELECT source, count(*) AS raw, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'excluded source') AS excluded,
  count(*) FILTER (reason = 'license') AS license_drops, count(*) FILTER (reason = 'image license') AS image_license_drops,
  count(*) FILTER (reason = 'image number') AS image_number_drops, count(*) FILTER (reason = 'held out image') AS held_out_image_drops,
  count(*) FILTER (reason = 'held out text') AS held_out_text_drops, count(*) FILTER (reason = 'held out id') AS held_out_id_drops,
  count(*) FILTER (reason IS NULL AND split = 'train') AS kept_train, count(*) FILTER (reason IS NULL AND split = 'calibration') AS kept_calibration,
  count(*) FILTER (reason IS NULL AND split = 'validation') AS kept_validation, count(*) FILTER (reason IS NULL AND split = 'test') AS kept_test
  FROM reasoned GROUP BY source""",
    "manifest_totals": f"""WITH {KEPT}, q AS (SELECT unnest(questions) AS q FROM kept) SELECT 'split' AS kind, split AS value, count(*) AS n FROM kept GROUP BY 2
  UNION ALL SELECT 'bucket', CASE WHEN len(images) > 0 THEN 'image' ELSE 'text' END, count(*) FROM kept GROUP BY 2
  UNION ALL SELECT 'lang', lang, count(*) FROM kept GROUP BY 2 UNION ALL SELECT 'type', q.type, count(*) FROM q GROUP BY 2""",
    "qa_source_stats": f"""WITH {_VALID}, {LEAF}, c AS (SELECT source, length(CASE WHEN json_valid(state_json) THEN coalesce(all_leaves, '') ELSE state_json END) AS chars FROM once LEFT JOIN leaf USING (rec_key)),
  l AS (SELECT source, list_sort(list(chars)) AS x, count(chars) AS n FROM c WHERE chars IS NOT NULL GROUP BY 1),
  m AS (SELECT source, (x[(n - 1) // 2 + 1] + x[n // 2 + 1]) // 2 AS median_chars, x[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95_chars FROM l)
  SELECT o.source, count(*) AS records, CAST(sum(coalesce(len(questions), 0)) AS BIGINT) AS questions,
  {", ".join(f"CAST(sum(coalesce(len(list_filter(questions, lambda q: q.type = '{t}')), 0)) AS BIGINT) AS {t}" for t in ("noul", "choice", "score"))},
  CAST(max(coalesce(len(questions), 0)) AS INT) AS most_questions, count(*) FILTER (o.rec_key IN (SELECT rec_key FROM every)) AS invalid,
  count(DISTINCT lang) AS langs, count(*) FILTER (len(images) > 0) AS pictured, any_value(median_chars) AS median_chars, any_value(p95_chars) AS p95_chars,
  round_even(sum(coalesce(len(questions), 0))::DOUBLE / count(*), 2) AS per_record FROM once o LEFT JOIN m ON m.source = o.source GROUP BY o.source""",
    "dup_ids": "SELECT source, count(id) - count(DISTINCT id) AS repeats FROM records GROUP BY source",
    "dup_questions": f"""WITH {ONCE}, {LEAF}, q AS (SELECT source, substr(CASE WHEN json_valid(state_json) THEN coalesce(all_leaves, '') ELSE state_json END, 1, 200) AS s,
    list_transform(coalesce(images, []), lambda i: coalesce(i.path, substr(i.url, 1, 64), '')) AS shown, unnest(questions) AS q FROM once LEFT JOIN leaf USING (rec_key)),
  k AS (SELECT source, count(*) AS n FROM q GROUP BY source, s, shown, substr(coalesce(q.instructions, ''), 1, 200)) SELECT source, CAST(sum(n - 1) AS BIGINT) AS repeats FROM k GROUP BY source""",
    "split_hash": f"WITH {ONCE}, g AS (SELECT DISTINCT grid_id FROM once WHERE grid_id IS NOT NULL) SELECT {_BY_HASH.format(h=_H)} AS split, count(*) AS grids FROM g GROUP BY 1",
    "split_coverage": f"""WITH {KEPT}, g AS (SELECT source, grid_id, count(*) AS n, {_H} AS h FROM kept WHERE NOT {BLANK} GROUP BY 1, 2),
  s AS (SELECT *, {_BY_HASH.format(h='h')} AS split FROM g),
  r AS (SELECT *, sum(n) OVER w AS total, count(*) FILTER (split = 'train') OVER w AS trains, count(*) FILTER (split = 'calibration') OVER w AS cals,
    count(*) FILTER (split = 'validation') OVER w AS vals, row_number() OVER (PARTITION BY source, split ORDER BY h, grid_id) AS k FROM s WINDOW w AS (PARTITION BY source)),
  p AS (SELECT *, CAST(cals = 0 AND trains >= 2 AS INT) AS c FROM r)
  SELECT source, grid_id, n, CASE WHEN total < 50 THEN 'train' WHEN split = 'train' AND c = 1 AND k = 1 THEN 'calibration'
    WHEN split = 'train' AND vals = 0 AND trains - c >= 2 AND k = 1 + c THEN 'validation' ELSE split END AS split FROM p""",
    "grid_groups": f"""WITH {_GROUPS} SELECT source, grid_id, variant, first, records, questions FROM g""",
    "grid_chunks": f"""WITH {_CHUNKS} SELECT first, rec_key, name, derived, chunk, new_name FROM placed""",
    "grid_records": f"""WITH {_CHUNKS} SELECT {_GRID_NAME} || '#' || variant || '.' || chunk AS id, count(*) AS questions, count(*) FILTER (derived <> '') AS derived,
  array_to_string(list_sort(list_distinct(list(rec_key))), ',') AS asked_in FROM placed GROUP BY source, grid_id, variant, chunk""",
    "grid_record_ids": f"WITH {_GROUPS} SELECT first, {_GRID_NAME} || '#' || variant AS grid_record FROM g",
    "derive_yes_no": f"WITH {_QS}, {_DERIVED} SELECT rec_key, name, kind, pick, p FROM derived",
    "grid_shared_meta": f"WITH {KEYED} SELECT source, grid_id, min(rec_key) AS first, count(*) AS n, "
    + ", ".join(f"CASE WHEN count(DISTINCT {c}) = 1 AND count({c}) = count(*) THEN min({c}) END AS {c}" for c in ("license", "lang", "cluster", "split", "coco_id", "flip_group", "flip_kind"))
    + " FROM k GROUP BY source, grid_id, state_key",
    "question_language": f"WITH {_QS} SELECT {_LANG} AS qlang, lang, count(*) AS n FROM qs GROUP BY 1, 2",
    "instruction_join": f"""WITH {_QS}, t AS (SELECT rec_key, name AS qname, rtrim(instructions, ' ') AS t, {_LANG} = 'zh' AS zh FROM qs)
  SELECT rec_key, qname, t || CASE WHEN regexp_matches(t, '[.!?。！？:：]$') THEN '' WHEN zh THEN '。' ELSE '.' END || CASE WHEN zh THEN '' ELSE ' ' END || '(yes/no)' AS asked FROM t""",
}
QUERIES = {
    f.__name__: f
    for f in (
        record_validate, license_filter, coco_license, drop_attribution, manifest_sources, manifest_totals, qa_source_stats, dup_ids, dup_questions, split_hash,
        split_coverage, grid_groups, grid_chunks, grid_records, dedup_jaccard, grid_record_ids, derive_yes_no, grid_shared_meta, question_language, instruction_join,
    )
}
