"""Queries over text functions and converters, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import options as G
from tallyloom.functions import rng
from tallyloom.functions import text as T
from tallyloom.functions.rng import unit_sql
from tallyloom.operators import openqa as O
from tallyloom.operators import pipeline as P
from tallyloom.plans.pipeline import ONCE, TEXT, once
from tallyloom.tables import table

WS = T.BLANKS + "+"


def _asked(spark, d):
    return once(spark, d).select("rec_key", "source", "split", "lang", "images", F.explode("questions").alias("q"))


def record_text(spark, d):
    """Normalised text of each record: the strings of its state in written order, then the instructions."""
    r = once(spark, d)
    return r.select("rec_key", P.record_text(r).alias("text"))


def first_words(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.words(F.col("text"), 20).alias("words"))


def prompt_normalise(spark, d):
    q = _asked(spark, d).select(T.plain_prompt(F.col("q.instructions")).alias("prompt"))
    return q.groupBy("prompt").agg(F.count("*").alias("n"))


def path_images(spark, d):
    p = once(spark, d).select("rec_key", F.explode("images").alias("i")).select("rec_key", T.image_numbers(F.col("i.path")).alias("image"))
    return p.where("image is not null").distinct()


def dedup_ids(spark, d):
    """Train records whose image number also stands in an evaluation record."""
    r = once(spark, d).where("coco_id is not null")
    held = r.where("split in ('calibration', 'validation', 'test')").select("coco_id").distinct()
    return r.where("split = 'train'").join(held, "coco_id", "left_semi").select("rec_key", "coco_id")


def _numbers(spark, d):
    raw = F.regexp_extract_all("text", F.lit(r"(-?[0-9][0-9,]*(?:\.[0-9]+)?%?)"), 1)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(raw).alias("at", "raw"))


def number_parse(spark, d):
    """Numbers in documents by notation, with their mean size."""
    n = _numbers(spark, d).select("raw", T.number(F.col("raw")).alias("v"), T.notation(F.col("raw")).alias("notation"))
    return n.groupBy("notation").agg(F.count("*").alias("n"), F.count("v").alias("parsed"), F.round(F.avg(F.least(F.abs("v"), F.lit(1e6))), 3).alias("mean"))


def number_distractors(spark, d):
    """Three other values of each document's first number, written alike."""
    first = _numbers(spark, d).where("at = 0").select(F.col("doc_id").alias("qid"), F.lit("").alias("question"), F.col("raw").alias("answer"))
    return O.changed_numbers(first).select(F.col("qid").alias("doc_id"), F.col("place").alias("rank"), "text")


def answer_pools(spark, d):
    """Questions by the most specific pool of their answers."""
    q = _asked(spark, d).where("q.type = 'choice'").select("q.instructions", F.element_at("q.criteria", 1)["desc"].alias("answer"))
    keyed = q.where("answer is not null").select(T.pool_keys(F.col("instructions"), F.col("answer")).alias("keys"))
    return keyed.groupBy(F.element_at("keys", 1).alias("pool")).agg(F.count("*").alias("n"))


def _open(spark, d):
    """Choices as open questions: the first option's description is the answer."""
    q = _asked(spark, d).where("q.type = 'choice'")
    image = F.try_element_at("images", F.lit(1))["path"]
    return q.select(F.concat_ws("/", "rec_key", "q.name").alias("qid"), image.alias("image"), F.col("q.instructions").alias("question"), F.element_at("q.criteria", 1)["desc"].alias("answer"))


def pool_draw(spark, d):
    """Three distractors for each choice from the pool of its question's first words, or of its kind."""
    q = _open(spark, d).where("answer is not null").withColumn("pool", F.element_at(T.pool_keys(F.coalesce("question", F.lit("")), F.col("answer")), 1))
    return O.pool_draws(q, q.select("pool", "qid", "answer"))


def distractors(spark, d):
    """Choices as open questions, with the distractors of the whole cascade."""
    return O.distractors(_open(spark, d))


def option_blocks(spark, d):
    """Options written into the question in five styles and read back."""
    q = _asked(spark, d).where("q.type = 'choice' and size(q.criteria) between 2 and 4").select("rec_key", F.col("q.name").alias("name"), F.transform("q.criteria", lambda c: F.regexp_replace(F.coalesce(c["desc"], F.lit("")), r"[^\p{L} ]", "")).alias("o"))
    put = lambda head, sep, form: F.concat(F.lit(head), F.array_join(F.transform("o", lambda x, i: F.format_string(form, F.char(F.lit(65) + i), x)), sep))
    styles = {
        "trailing": G.trailing_lines(put("Which one?\n", "\n", "%s. %s")), "listed": G.listed(put("Which one? Options: ", ", ", "%s: %s")), "tail": G.option_tail(put("Which one?\nOption: ", "; ", "%s:%s")),
        "bracketed": G.bracketed(put("Which one?\n", "\n", "(%s) %s")), "inline": G.inline(put("Which one? ", " ", "%s. %s")),
    }
    shown = lambda c: F.array_join(F.transform(c, lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|")
    return q.select("rec_key", "name", *(shown(c).alias(n) for n, c in styles.items()))


def to_choice(spark, d):
    """The first option moved to a hashed place among the others."""
    q = _asked(spark, d).where("q.type = 'choice' and size(q.criteria) >= 3").select("rec_key", F.col("q.name").alias("name"), F.transform("q.criteria", lambda c: F.coalesce(c["desc"], F.lit(""))).alias("o"))
    place = F.floor(rng.unit("place", F.col("rec_key"), F.col("name")) * F.size("o")).cast("int")
    rest = F.slice("o", F.lit(2), F.size("o"))
    return q.select("rec_key", "name", place.alias("place"), F.array_join(T.inserted(rest, F.element_at("o", 1), place), "|").alias("options"))


def lettered_parse(spark, d):
    """Options written as lettered lines and read back."""
    q = _asked(spark, d).where("q.type = 'choice'").select("rec_key", F.col("q.name").alias("name"), F.transform("q.criteria", lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), F.coalesce(c["desc"], F.lit("")))).alias("lines"))
    parsed = T.lettered(F.concat(F.lit("Pick one.\n"), F.array_join("lines", "\n")))
    return q.select("rec_key", "name", F.size("lines").alias("lines"), F.array_join(parsed, "|").alias("options"))


def yes_no_answers(spark, d):
    q = _asked(spark, d).select(F.explode("q.criteria").alias("c")).select(T.clean_answer(F.col("c.label")).alias("a"))
    return q.groupBy(T.yes_no(F.when(F.col("a") == "true", "Yes.").when(F.col("a") == "false", "no").otherwise(F.col("a"))).alias("value")).agg(F.count("*").alias("n"))


def shingle_counts(spark, d):
    """Distinct 3-character pieces of each document."""
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.size(T.shingles(F.lower("text"))).alias("pieces"))


def minhash_agreement(spark, d):
    """Estimated against exact similarity of a document's two halves."""
    t = table(spark, d, "documents").where("length(text) >= 40")
    half = F.floor(F.length("text") / 2).cast("int")
    cut = t.select("doc_id", T.shingles(F.substring("text", F.lit(1), half)).alias("a"), T.shingles(F.substring("text", half + 1, half)).alias("b"))
    same = F.size(F.filter(F.arrays_zip(T.minhash(F.col("a")).alias("x"), T.minhash(F.col("b")).alias("y")), lambda z: z["x"] == z["y"])) / 16
    return cut.select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("exact"), same.alias("estimate"))


def data_urls(spark, d):
    u = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "data:text/plain;base64,").otherwise("data:image/png;base64,"), F.base64(F.encode("text", "utf-8"))).alias("url"))
    mime, size = T.data_url(F.col("url"))
    return u.select("doc_id", mime.alias("mime"), size.alias("bytes"))


def report_cells(spark, d):
    a = table(spark, d, "answers").groupBy("source").agg(F.avg("latency_ms").alias("ms"), F.avg("pred_negated").alias("neg"))
    return a.select("source", T.report_number(F.round("ms", 3), 1).alias("ms"), T.report_number(F.col("neg"), 2).alias("neg"))


def safe_names(spark, d):
    i = once(spark, d).select(F.explode("images").alias("i")).select(T.safe_name(F.substring_index("i.path", "/", -2)).alias("name"))
    return i.groupBy("name").agg(F.count("*").alias("n"))


def balanced_labels(spark, d):
    """Majority label of each source's choices with its share, labels compared without their ending."""
    q = _asked(spark, d).where("q.type = 'choice'").select("source", F.regexp_replace(F.element_at("q.criteria", 1)["label"], "[0-9]+$", "").alias("label"))
    by = q.groupBy("source", "label").agg(F.count("*").alias("n"))
    return by.groupBy("source").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


_Q = f"{ONCE}, a AS (SELECT rec_key, source, split, lang, unnest(questions) AS q FROM once)"
_NUM = r"'^(-?)([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(\.[0-9]+)?([eE][+-][0-9]+)?(%?)$'"
_RAW = r"SELECT doc_id, unnest(regexp_extract_all(text, '(-?[0-9][0-9,]*(?:\.[0-9]+)?%?)', 1)) AS raw FROM documents WHERE text IS NOT NULL"
_IS = f"(regexp_matches(raw, {_NUM}) AND regexp_matches(raw, '[0-9]'))"
_PART = lambda k: f"CASE WHEN regexp_extract(raw, {_NUM}, {k}) <> '' THEN '1' ELSE '0' END"
ORACLE_SQL = {
    "record_text": f"WITH {ONCE}, {TEXT} SELECT rec_key, text FROM text",
    "first_words": f"""SELECT doc_id, coalesce(array_to_string((list_filter(string_split(trim(regexp_replace(text, '{WS}', ' ', 'g'), ' '), ' '), lambda x: x <> ''))[1:20], ' '), '') AS words FROM documents WHERE text IS NOT NULL""",
    "prompt_normalise": f"WITH {_Q} SELECT trim(regexp_replace(lower(q.instructions), '[^a-z0-9]+', ' ', 'g'), ' ') AS prompt, count(*) AS n FROM a GROUP BY 1",
    "path_images": rf"""WITH {ONCE}, p AS (SELECT rec_key, unnest(images).path AS p FROM once),
  x AS (SELECT rec_key, coalesce(nullif(regexp_extract(p, 'COCO_[A-Za-z]+[0-9]{{4}}_0*([0-9]+)[^/]*$', 1), ''), nullif(regexp_extract(p, '(?:^|/)(?:train|val)[0-9]{{4}}/0*([0-9]+)[^/]*$', 1), '')) AS n FROM p)
  SELECT DISTINCT rec_key, CAST(n AS BIGINT) AS image FROM x WHERE n IS NOT NULL""",
    "dedup_ids": f"""WITH {ONCE} SELECT rec_key, coco_id FROM once WHERE split = 'train' AND coco_id IN (SELECT coco_id FROM once WHERE coco_id IS NOT NULL AND split IN ('calibration', 'validation', 'test'))""",
    "number_parse": rf"""WITH r AS ({_RAW}), v AS (SELECT raw, CASE WHEN {_IS} THEN TRY_CAST(regexp_replace(raw, '[,%]', '', 'g') AS DOUBLE) END AS v,
    CASE WHEN {_IS} THEN {_PART(1)} || {_PART(3)} || {_PART(4)} || {_PART(5)} END AS notation FROM r)
  SELECT notation, count(*) AS n, count(v) AS parsed, round(avg(least(abs(v), 1e6)), 3) AS mean FROM v GROUP BY notation""",
    "answer_pools": rf"""WITH {_Q}, c AS (SELECT q.instructions AS i, q.criteria[1].desc AS raw FROM a WHERE q.type = 'choice' AND q.criteria[1].desc IS NOT NULL),
  k AS (SELECT *, CASE WHEN {_IS} THEN 'number' WHEN regexp_matches(lower(i), '^what (is the )?colou?r') OR lower(raw) IN {T.COLOURS} THEN 'color' ELSE 'text' END AS kind FROM c)
  SELECT CASE WHEN kind <> 'text' THEN kind ELSE coalesce(array_to_string((regexp_extract_all(lower(i), '[a-z'']+'))[1:3], ' '), '') END AS pool, count(*) AS n FROM k GROUP BY 1""",
    "option_blocks": f"""WITH {_Q}, o AS (SELECT rec_key, q.name AS name, list_transform(q.criteria, lambda c: trim(regexp_replace(coalesce(c.desc, ''), '[^\\p{{L}} ]', '', 'g'), ' ')) AS o FROM a WHERE q.type = 'choice' AND len(q.criteria) BETWEEN 2 AND 4),
  t AS (SELECT rec_key, name, len(o) AS n, len(list_filter(o, lambda x: x = '')) = 0 AS good, array_to_string(list_transform(o, lambda x, i: chr(CAST(64 + i AS INT)) || '=' || x), '|') AS s,
    array_to_string(list_filter(list_transform(o, lambda x, i: CASE WHEN lower(x) NOT IN ('', '-', 'nan', 'none') THEN chr(CAST(64 + i AS INT)) || '=' || x END), lambda x: x IS NOT NULL), '|') AS b FROM o)
  SELECT rec_key, name, CASE WHEN good THEN s END AS trailing, CASE WHEN good THEN s END AS listed, CASE WHEN good THEN s END AS tail, b AS bracketed, CASE WHEN good AND n = 4 THEN s END AS inline FROM t""",
    "to_choice": f"""WITH {_Q}, o AS (SELECT rec_key, q.name AS name, list_transform(q.criteria, lambda c: coalesce(c.desc, '')) AS o FROM a WHERE q.type = 'choice' AND len(q.criteria) >= 3),
  p AS (SELECT *, CAST(floor({unit_sql('place', 'rec_key', 'name')} * len(o)) AS INT) AS place, o[2:] AS rest FROM o)
  SELECT rec_key, name, place, array_to_string(list_concat(list_concat(rest[1:place], [o[1]]), rest[place + 1:]), '|') AS options FROM p""",
    "lettered_parse": rf"""WITH {_Q}, l AS (SELECT rec_key, q.name AS name, CAST(len(q.criteria) AS INT) AS lines, list_transform(q.criteria, lambda c: trim(coalesce(c.desc, ''), ' ')) AS o FROM a WHERE q.type = 'choice')
  SELECT rec_key, name, lines, CASE WHEN len(o) >= 2 AND NOT list_contains(o, '') AND len(list_distinct(o)) = len(o) THEN array_to_string(o, '|') END AS options FROM l""",
    "yes_no_answers": f"""WITH {_Q}, c AS (SELECT unnest(q.criteria).label AS l FROM a), y AS (SELECT lower(CASE WHEN l = 'true' THEN 'yes' WHEN l = 'false' THEN 'no' ELSE trim(regexp_replace(trim(l, ' '), '\\.$', ''), ' ') END) AS l FROM c)
  SELECT CASE WHEN l = 'yes' THEN 1.0::DOUBLE WHEN l = 'no' THEN 0.0::DOUBLE END AS value, count(*) AS n FROM y GROUP BY 1""",
    "shingle_counts": "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substring(t, i, 3)))) AS INT) AS pieces FROM d",
    "data_urls": """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'image/png' END AS mime, CASE WHEN doc_id % 3 <> 0 THEN CAST(octet_length(encode(text)) AS INT) END AS bytes
  FROM documents WHERE length(text) > 0""",
    "report_cells": """WITH a AS (SELECT source, avg(latency_ms) AS ms, avg(pred_negated) AS neg FROM answers GROUP BY source)
  SELECT source, CASE WHEN ms IS NULL THEN '—' ELSE printf('%.1f', round(ms, 3)) END AS ms, CASE WHEN neg IS NULL THEN '—' ELSE printf('%.2f', neg) END AS neg FROM a""",
    "safe_names": rf"""WITH {ONCE}, p AS (SELECT string_split(unnest(images).path, '/') AS p FROM once)
  SELECT substr(regexp_replace(array_to_string(p[-2:], '/'), '[^A-Za-z0-9\-_.]', '_', 'g'), 1, 120) AS name, count(*) AS n FROM p GROUP BY 1""",
    "balanced_labels": f"""WITH {_Q}, l AS (SELECT source, regexp_replace(q.criteria[1].label, '[0-9]+$', '') AS label, count(*) AS n FROM a WHERE q.type = 'choice' GROUP BY 1, 2)
  SELECT source, arg_max(label, (n, label)) AS label, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM l GROUP BY source""",
}
QUERIES = {
    f.__name__: f
    for f in (
        record_text, first_words, prompt_normalise, path_images, dedup_ids, number_parse, number_distractors, answer_pools, pool_draw, distractors, option_blocks, to_choice, lettered_parse,
        yes_no_answers, shingle_counts, minhash_agreement, data_urls, report_cells, safe_names, balanced_labels,
    )
}
