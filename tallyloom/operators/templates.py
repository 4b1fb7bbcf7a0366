"""Converter templates for text classification sources: upstream rows (text, other, label) to typed questions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rng
from tallyloom.functions import text as T
from tallyloom.operators import convert as C


@dataclass(frozen=True)
class Template:
    """How one source is asked about.

    ``kind`` is noul, choice or score; ``options`` are labels in order; ``words`` cuts the text; ``paired`` puts the other
    text into the instruction; ``yes`` are the labels that mean yes; a label below ``least`` is skipped. ``named`` templates
    take their options from the source's label names, whatever their number; ``rename`` changes single names. Besides
    the main question ``about`` labels drawn by hash are asked about as yes/no, and so is ``from_level`` of a score.
    """

    kind: str
    ask: str
    options: tuple[str, ...] = ()
    words: int = 0
    paired: bool = False
    yes: tuple[int, ...] = ()
    least: int = 0
    mean: bool = False
    clean: str = ""
    named: bool = False
    rename: dict[str, str] = field(default_factory=dict)
    about: int = 0
    from_level: int | None = None


TEMPLATES = {
    "paraphrase_zh": Template("noul", "两句话意思相同吗？", paired=True, yes=(1,)),
    "news_topic": Template("choice", "Which section does this news item belong to?", ("world", "sports", "business", "science"), about=2),
    "product_stars": Template("score", "How many stars does the review give?", ("1", "2", "3", "4", "5"), words=220),
    "bank_intent": Template("choice", "What does the customer want?", ("card", "transfer", "refund", "limit", "other"), named=True),
    "passage_yes_no": Template("noul", "", paired=True, yes=(1,), clean="question"),
    "assistant_intent": Template("choice", "What is the request about?", ("travel", "banking", "home", "oos"), named=True, rename={"oos": "out_of_scope"}),
    "encyclopedia_class": Template("choice", "What kind of thing is described?", ("company", "artist", "athlete", "place", "film"), words=200, named=True),
    "film_review": Template("noul", "Is the review positive?", yes=(1,), words=220, clean="markup"),
    "entailment": Template("choice", "Does the second text follow?", ("entailment", "neutral", "contradiction"), paired=True),
    "entailment_zh": Template("choice", "后一句能否由前一句推出？", ("蕴含", "中立", "矛盾"), paired=True),
    "sentiment_levels": Template("score", "How positive is the text?", ("very negative", "negative", "neutral", "positive", "very positive")),
    "similarity_levels": Template("score", "How similar are the two texts?", ("0", "1", "2", "3", "4", "5"), paired=True, mean=True),
    "short_news_zh": Template("choice", "这条新闻属于哪一类？", ("财经", "体育", "科技", "娱乐", "其他"), named=True),
    "question_type": Template("choice", "What does the question ask for?", ("person", "place", "number", "description", "entity", "abbreviation")),
    "shop_stars": Template("score", "How many stars does the review give?", ("1", "2", "3", "4", "5"), from_level=3),
}


def options_of(name: str, labels: list[str] | None = None) -> list[str]:
    """The options of a template in order: its own, or the label names of the source in plain form."""
    t = TEMPLATES[name]
    names = list(labels) if labels and t.named else list(t.options)
    plain = [re.sub("[ /-]+", "_", t.rename.get(x, x).strip().lower()) if t.named else x for x in names]
    if not len(plain) <= 255 or len(set(plain)) != len(plain):
        raise ValueError(f"{name}: 1 to 255 different options are needed")
    return plain


def apply(rows: DataFrame, name: str, labels: list[str] | None = None) -> DataFrame:
    """``key``, ``template``, ``skip``, ``type``, ``state``, ``instructions``, ``options``, ``target`` of each upstream row."""
    t, options = TEMPLATES[name], options_of(name, labels)
    state = C.unbroken(F.col("text")) if t.clean == "markup" else F.col("text")
    state = T.words(state, t.words) if t.words else state
    ask = C.asked_once(F.col("other")) if t.clean == "question" else F.concat_ws("\n", F.lit(t.ask), F.col("other")) if t.paired else F.lit(t.ask)
    label = C.half_up_level(F.col("label")) if t.mean else F.col("label").cast("int")
    known = label < (len(options) if options else 2)
    skip = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text").when(F.lit(t.paired) & (F.coalesce(F.trim("other"), F.lit("")) == ""), "no second text").when(label.isNull() | (label < t.least), "no label").when(~known, "unknown label")
    offered = F.array(*(F.lit(x) for x in options)) if options else F.array(F.lit("true"), F.lit("false"))
    target: Column = F.array(label.isin(*t.yes).cast("double"), (~label.isin(*t.yes)).cast("double")) if t.kind == "noul" else F.transform(offered, lambda _, i: (i == label).cast("double"))
    return rows.select("key", F.lit(name).alias("template"), skip.alias("skip"), F.lit(t.kind).alias("type"), state.alias("state"), ask.alias("instructions"), offered.alias("options"), F.when(skip.isNull(), target).alias("target"))


def besides(rows: DataFrame, name: str, labels: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Yes/no questions a template asks besides the main one: ``key``, ``template``, ``instructions``, ``yes``."""
    t, options = TEMPLATES[name], options_of(name, labels)
    good = apply(rows, name, labels).where("skip is null")
    made = []
    if t.about:
        drawn = F.slice(F.array_sort(F.transform("options", lambda o, i: F.struct(rng.unit(f"{seed}.{name}", F.col("key"), o).alias("u"), o.alias("o"), i.alias("i")))), 1, t.about)
        each = good.select("key", "target", F.explode(drawn).alias("d"))
        made.append(each.select("key", F.lit(name).alias("template"), F.concat(F.lit("Is this about: "), F.col("d.o"), F.lit("?")).alias("instructions"), F.get("target", F.col("d.i")).alias("yes")))
    if t.from_level is not None:
        above = F.aggregate(F.slice("target", t.from_level + 1, len(options)), F.lit(0.0), lambda a, x: a + x)
        made.append(good.select("key", F.lit(name).alias("template"), F.lit("Would the writer recommend it?").alias("instructions"), above.alias("yes")))
    return reduce(DataFrame.unionByName, made) if made else good.select("key", "template", "instructions", F.lit(None).cast("double").alias("yes")).limit(0)


def apply_all(rows: DataFrame) -> DataFrame:
    """Every template over the same upstream rows."""
    return reduce(DataFrame.unionByName, (apply(rows, n) for n in TEMPLATES))
