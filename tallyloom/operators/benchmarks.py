"""Converters of evaluation collections: upstream rows become one question each, or are skipped with a reason.

All give ``key``, ``skip`` (the first reason that holds, null for a good row), ``type``, ``instructions``, ``labels``
(options in order), ``target`` (null where skipped) and columns of their own. Null texts count as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import options as G
from tallyloom.functions import rng
from tallyloom.functions import text as T
from tallyloom.workspace import Workspace

ROTATED = 1_000_000
BLANK = ("", "-", "nan", "none")


def _said(c: Column) -> Column:
    """The trimmed text, null if it says nothing."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*BLANK), t)


def _asked(rows: DataFrame, key: str, skip: Column, kind: Column, instructions: Column, labels: Column, at: Column, **more: Column) -> DataFrame:
    target = F.transform(labels, lambda _, i: (i == at).cast("double"))
    return rows.select(F.col(key).alias("key"), skip.alias("skip"), kind.alias("type"), instructions.alias("instructions"), labels.alias("labels"), F.when(skip.isNull(), target).alias("target"), *(c.alias(n) for n, c in more.items()))


def _truth() -> Column:
    return F.array(F.lit("true"), F.lit("false"))


def expected_answers(tiers: dict[str, DataFrame], licences: dict[str, str]) -> DataFrame:
    """Rows of several tiers (id, type, instructions, labels, expected, licence): a label, yes or no, or a level as the answer."""
    rows = None
    for name, df in tiers.items():
        part = df.select("id", "type", "instructions", "labels", F.col("expected").cast("string").alias("expected"), "licence", F.lit(name).alias("tier"))
        rows = part if rows is None else rows.unionByName(part)
    labels = F.when(F.col("type") == "noul", _truth()).otherwise(F.col("labels"))
    at = F.when(F.col("type") == "noul", F.array_position(F.array(F.lit("yes"), F.lit("no")), F.col("expected"))).when(F.col("type") == "score", F.col("expected").try_cast("int") + 1).otherwise(F.array_position("labels", F.col("expected"))) - 1
    skip = F.when(~F.coalesce(at.between(0, F.size(labels) - 1), F.lit(False)), "answer_not_in_options")
    known = F.coalesce(*(F.when(F.col("licence") == k, v) for k, v in licences.items()), F.lit("unknown"))
    return _asked(rows, "id", skip, F.col("type"), F.col("instructions"), labels, at, tier=F.col("tier"), license=known)


def labelled_questions(rows: DataFrame, licences: DataFrame) -> DataFrame:
    """Records with several labelled questions (id, repo, questions: name, type, labels, label, src): a row a question.

    ``licences`` (repo, license) is a dimension; ``src`` is the record's one source of labels, null if they differ.
    """
    clean = licences.groupBy("repo").agg(F.min("license").alias("license"))
    one = F.array_distinct(F.transform("questions", lambda q: q["src"]))
    flat = rows.join(clean, "repo", "left").withColumn("src", F.when(F.size(one) == 1, one[0])).select("id", "license", "src", F.explode("questions").alias("q"))
    labels = F.when(F.col("q.type") == "noul", _truth()).otherwise(F.col("q.labels"))
    at = F.array_position(labels, F.col("q.label")) - 1
    skip = F.when(~F.coalesce(at >= 0, F.lit(False)), "answer_not_in_options")
    return _asked(flat, "id", skip, F.col("q.type"), F.col("q.instructions"), labels, at, qname=F.col("q.name"), src=F.col("src"), license=F.coalesce("license", F.lit("unknown")))


def counterfactual_pairs(rows: DataFrame, key: str, pair: str) -> DataFrame:
    """The rows with ``partner``: the other one of a pair of exactly two."""
    p = rows.where(F.col(pair).isNotNull()).groupBy(pair).agg(F.min(key).alias("_a"), F.max(key).alias("_b"), F.count("*").alias("_n")).where("_n = 2 and _a <> _b")
    return rows.join(p, pair, "left").withColumn("partner", F.when(F.col(key) == F.col("_a"), F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b", "_n")


def lettered_columns(rows: DataFrame, ask: str, letters: str = "ABCD") -> DataFrame:
    """Options in columns A to D (index, question, hint, answer): rotated copies are skipped, blank options left out, and a
    hint stands before the question."""
    options = F.filter(F.array(*(F.struct(F.lit(x).alias("label"), _said(F.col(x)).alias("text")) for x in letters)), lambda o: o["text"].isNotNull())
    labels = F.transform(options, lambda o: o["label"])
    at = F.array_position(labels, F.col("answer")) - 1
    skip = F.when(F.col("index") >= ROTATED, "circular_rotation").when(~F.coalesce(at >= 0, F.lit(False)), "answer_not_in_options")
    state = F.concat_ws("\n\n", _said(F.col("hint")), F.trim("question"))
    return _asked(rows, "index", skip, F.lit("choice"), F.lit(ask), labels, at, state=state, texts=F.transform(options, lambda o: o["text"]))


def packed_options(rows: DataFrame, ask: str) -> DataFrame:
    """Options inside the question (id, question, answer), in bracketed lines or behind ``Options:``."""
    options = F.coalesce(G.bracketed(F.col("question")), G.listed(F.col("question")))
    at, reason = G.chosen(options, F.col("answer"))
    stem = F.regexp_replace(F.col("question"), r"(?s)(\n?Choices:\s*)?\n?\(A\) ?.*$|\s*Options:(?!.*Options:).*$", "")
    return _asked(rows, "id", reason, F.lit("choice"), F.lit(ask), F.transform(options, lambda o: o["label"]), at, state=F.trim(stem), texts=F.transform(options, lambda o: o["text"]))


def tagged_images(rows: DataFrame, ask: str, judge: str, right: str = "对", wrong: str = "错") -> DataFrame:
    """Choices and judgements whose texts name image files as ``<img="name">`` (id, kind, question, options, answer, files).

    File names become ``<image n>`` by their place in ``files``; ``order`` has the images as they are named, then the rest.
    """
    tag = r'<img="([^"]*)">'
    named = F.flatten(F.transform(F.concat(F.array("question"), F.coalesce("options", F.array())), lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(tag), 1)))
    places = F.transform(F.array_distinct(named), lambda n: F.coalesce(F.array_position("files", n), F.lit(0)).cast("int"))
    retag = lambda t: F.aggregate(F.sequence(F.lit(1), F.size("files")), t, lambda a, i: F.replace(a, F.concat(F.lit('<img="'), F.element_at("files", i), F.lit('">')), F.concat(F.lit("<image "), i.cast("string"), F.lit(">"))))
    options = F.filter(F.coalesce("options", F.array()), lambda o: F.coalesce(F.trim(o), F.lit("")) != "")
    choice = F.col("kind") == "choice"
    labels = F.when(choice, F.transform(options, lambda _, i: F.char(F.lit(65) + i))).otherwise(_truth())
    at = F.when(choice, F.array_position(labels, F.trim("answer"))).otherwise(F.array_position(F.array(F.lit(right), F.lit(wrong)), F.col("answer"))) - 1
    skip = (
        F.when(~F.col("kind").isin("choice", "judge") | F.col("kind").isNull(), "type").when(F.exists(places, lambda p: p == 0), "img_tag_without_image").when(F.coalesce(F.size("files"), F.lit(0)) < 1, "no_image")
        .when(choice & (F.length(F.trim("answer")) != 1), "multi_answer").when(~F.coalesce(at >= 0, F.lit(False)) | (choice & (F.size(labels) < 2)), F.when(choice, "answer_not_in_options").otherwise("judge_answer"))
    )
    rest = F.array_except(F.sequence(F.lit(1), F.greatest(F.size("files"), F.lit(1))), places)
    return _asked(rows, "id", skip, F.when(choice, "choice").otherwise("noul"), F.when(choice, ask).otherwise(judge), labels, at, state=F.when(F.size("files") > 0, retag(F.col("question"))).otherwise(F.col("question")), order=F.concat(places, rest), unnamed=F.size(rest))


def presence(rows: DataFrame, column: str = "question") -> DataFrame:
    """Yes/no questions about an object (id, question, answer), with the negated one where the wording is the usual one."""
    asked = F.trim(column)
    thing = F.regexp_extract(asked, r"^Is there an? (.+) in the image\?$", 1)
    at = F.array_position(F.array(F.lit("yes"), F.lit("no")), F.lower(F.trim("answer"))) - 1
    skip = F.when(~F.coalesce(at >= 0, F.lit(False)), "answer_not_yes_no")
    return _asked(rows, "id", skip, F.lit("noul"), asked, _truth(), at, negated=F.when(thing != "", F.concat(F.lit("Is there no "), thing, F.lit(" in the image?"))))


def pictured_only(rows: DataFrame, image: str) -> DataFrame:
    """Yes/no rows (id, question, answer as 0 or 1); those without an image are skipped."""
    at = 1 - F.col("answer").try_cast("int")
    skip = F.when(F.coalesce(F.trim(image), F.lit("")) == "", "text_only").when(~F.coalesce(at.isin(0, 1), F.lit(False)), "answer_not_0_1")
    return _asked(rows, "id", skip, F.lit("noul"), F.trim("question"), _truth(), at)


def mapped_classes(rows: DataFrame, column: str, classes: dict[str, str], endings: tuple[str, ...], ask: str) -> DataFrame:
    """A class by its upstream name without one of the endings; names that are not listed are skipped."""
    plain = F.regexp_replace(F.trim(column), "(" + "|".join(endings) + ")$", "")
    name = F.coalesce(*(F.when(plain == k, v) for k, v in classes.items()))
    labels = F.array(*(F.lit(v) for v in dict.fromkeys(classes.values())))
    return _asked(rows, "id", F.when(name.isNull(), "unknown_type"), F.lit("choice"), F.lit(ask), labels, F.array_position(labels, name) - 1, cluster=F.coalesce("game", F.lit("N/A")))


CUT = r"(?is)\n\s*(provide your (answer|response)|based on your analysis, respond|respond using|output).*$"


def routed(rows: DataFrame, routes: dict[str, tuple[str, str, int]]) -> DataFrame:
    """One scan for several sets (id, categories, truth as JSON, media, source, question): ``set`` by category, the truth's
    member and the number of media. The instruction loses the words about the form of the answer; the cluster is the scene
    in the id, else the source, else the id."""
    said = lambda member: F.get_json_object("truth", f"$.{member}")
    fits = lambda r: F.array_contains("categories", r[0]) & said(r[1]).isNotNull() & (F.size("media") == r[2])
    name = F.coalesce(*(F.when(F.coalesce(fits(r), F.lit(False)), k) for k, r in routes.items()))
    value = F.coalesce(*(F.when(name == k, said(r[1])) for k, r in routes.items()))
    scene = F.regexp_extract("id", "^sphere_([A-Za-z0-9]+)-", 1)
    source = F.when((F.coalesce("source", F.lit("")) != "") & ~F.lower("source").startswith("unity"), F.col("source"))
    at = F.when(value == "true", 0).when(value == "false", 1)
    skip = F.when(name.isNull(), "no_set").when(at.isNull(), "no_truth")
    return _asked(rows, "id", skip, F.lit("noul"), F.trim(F.regexp_replace("question", CUT, "")), _truth(), at, set=name, cluster=F.coalesce(F.nullif(scene, F.lit("")), source, F.col("id")))


def quoted(rows: DataFrame, ask: str, images: int | None = None) -> DataFrame:
    """A quoted statement that is said to be right or wrong (id, user, assistant, images); a wanted number of images."""
    said = F.trim(F.regexp_extract("user", r'"([^"]+)"', 1))
    at = 1 - T.yes_no(F.col("assistant")).cast("int")
    skip = F.when(F.size("images") != images, "images") if images else F.lit(None).cast("string")
    skip = F.coalesce(skip, F.when((said == "") | at.isNull() | said.isNull(), "unparsed"))
    pair = F.regexp_replace(F.element_at("images", 1), "-img0$", "")
    split = F.when(pair.rlike("^(train|dev|test1)-"), F.substring_index(pair, "-", 1)).otherwise("train")
    return _asked(rows, "id", skip, F.lit("noul"), F.concat(F.lit(ask), F.lit(' "'), said, F.lit('"')), _truth(), at, pair=pair, split=split)


def chart_options(rows: DataFrame, n: int = 4, none: str = "Not Applicable", seed: int = 0) -> DataFrame:
    """Options for answers about charts (qid, chart, template, answer): the answer, then answers of its kind on the chart,
    changed values, answers to the same template, and none of it; at most n, in a hashed order.

    Answers of a chart and answers to a template are drawn as in the pools of open questions, so no question meets all of them.
    Questions, draws and changed values are written once; joins with a row for each question are merges, so the driver holds none.
    """
    from tallyloom.operators.openqa import changed_numbers, pool_draws

    size = r"^([0-9]+) by ([0-9]+)$"
    kind = F.when(T.is_number(F.col("answer")), "num").when(F.col("answer").rlike(size), "layout").when(F.col("answer").isin("Yes", "No"), "bool").otherwise("text")
    q = rows.where("answer is not null and trim(answer) <> ''").select("qid", "chart", "template", F.trim("answer").alias("answer")).withColumn("kind", kind)
    ws = Workspace(rows.sparkSession)
    q = ws.put(q.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid"), "questions")  # set, for few bytes make many draws
    on_chart = q.where("chart is not null and template is not null").select("qid", F.concat_ws("|", "kind", F.col("chart").cast("string")).alias("pool"), "answer", "template")
    same = pool_draws(on_chart, on_chart.where(F.col("answer") != none), n - 1, f"chart.{seed}", "template", ws).select("qid", F.lit(0).alias("step"), F.col("place").cast("double").alias("order"), "text")
    numbers = changed_numbers(q.where("kind = 'num'").select("qid", F.lit("").alias("question"), "answer"), n, ws).select("qid", F.lit(1).alias("step"), F.col("place").cast("double").alias("order"), "text")
    a, b = (F.regexp_extract("answer", size, k).cast("int") for k in (1, 2))
    least = lambda x: F.greatest(x - 1, F.lit(1))
    moves = F.array(*(F.concat_ws(" by ", x.cast("string"), y.cast("string")) for x, y in ((b, a), (a + 1, b), (a, b + 1), (least(a), b), (a, least(b)))))
    layouts = q.where("kind = 'layout'").select("qid", F.lit(1).alias("step"), F.posexplode(moves).alias("p", "text")).select("qid", "step", F.col("p").cast("double").alias("order"), "text")
    bools = q.where("kind = 'bool'").select("qid", F.lit(1).alias("step"), F.lit(0.0).alias("order"), F.when(F.col("answer") == "Yes", "No").otherwise("Yes").alias("text"))
    pool = q.select("qid", F.col("template").alias("pool"), "answer")
    drawn = pool_draws(pool, pool, n, ws=ws).select("qid", F.lit(2).alias("step"), F.col("place").cast("double").alias("order"), "text")
    last = q.select("qid", F.lit(3).alias("step"), F.lit(0.0).alias("order"), F.lit(none).alias("text"))
    same, drawn = ws.put(same, "same"), ws.put(drawn, "drawn")
    every = same.unionByName(numbers).unionByName(layouts).unionByName(bools).unionByName(drawn).unionByName(last)
    wrong = every.join(q.select("qid", "answer").hint("merge"), "qid").where(F.lower("text") != F.lower("answer"))
    first = F.row_number().over(Window.partitionBy("qid", F.lower("text")).orderBy("step", "order", "text"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("step", "order", "text"))
    kept = wrong.withColumn("f", first).where("f = 1").withColumn("rank", rank).where(F.col("rank") < n).select("qid", "text", F.lit(0.0).alias("p"))
    options = kept.unionByName(q.select("qid", F.col("answer").alias("text"), F.lit(1.0).alias("p")))
    shuffled = F.array_sort(F.collect_list(F.struct(rng.unit(seed + 1, F.col("qid"), F.col("text")).alias("u"), "text", "p")))  # n at most
    return options.groupBy("qid").agg(shuffled.alias("o")).where("size(o) >= 2").select("qid", F.transform("o", lambda x: x["text"]).alias("texts"), F.transform("o", lambda x: x["p"]).alias("target"))
