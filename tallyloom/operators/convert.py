"""Converters: upstream rows become typed questions, or are skipped with a counted reason.

A converter gives for each row either a question (instructions, options, target) or a reason. Both come from one scan;
the rows that were skipped are an aggregate and never a second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rng
from tallyloom.functions import text as T


def converted(rows: DataFrame, skip: Column, **fields: Column) -> DataFrame:
    """The rows with their fields and ``skip``: the first reason that holds, null for a good row."""
    return rows.withColumn("skip", skip).withColumns(fields)


def skip_counts(rows: DataFrame, by: str) -> DataFrame:
    """Good rows and skipped rows by reason."""
    return rows.groupBy(by, F.coalesce("skip", F.lit("good")).alias("outcome")).agg(F.count("*").alias("n"))


def asked_once(question: Column) -> Column:
    """A question with one question mark at its end."""
    return F.concat(F.trim(F.regexp_replace(F.trim(question), "[?]+$", "")), F.lit("?"))


def half_up_level(score: Column, top: int = 5) -> Column:
    """A mean as a level: half goes up, capped."""
    return F.least(F.floor(score + 0.5), F.lit(top)).cast("int")


def unbroken(text: Column) -> Column:
    """Markup of line breaks as blanks."""
    return F.regexp_replace(text, r"<br\s*/?>", " ")


def label_name(c: Column) -> Column:
    """A class name in lower case with underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ /-]+", "_")


def one_hot(hit: Column, options: Column) -> Column:
    """A target with all mass on one option; an option that is not there fails."""
    known = F.array_contains(options, hit)
    return F.when(known, F.transform(options, lambda o: (o == hit).cast("double"))).otherwise(F.raise_error(F.concat(F.lit("no such option: "), F.coalesce(hit, F.lit("null")))))


def sampled_labels(rows: DataFrame, key: str, options: list[str], k: int, seed: int = 0) -> DataFrame:
    """k of the labels for yes/no questions about each row, without replacement: the k smallest hashes of one array."""
    tagged = F.array_sort(F.array(*(F.struct(rng.unit(seed, F.col(key), F.lit(o)).alias("u"), F.lit(o).alias("o")) for o in options)))
    return rows.select(key, F.explode(F.slice(F.transform(tagged, lambda x: x["o"]), 1, k)).alias("label"))


def image_order(text: Column, present: Column) -> Column:
    """Images in the order in which a text names them as ``<image n>``, then those it does not name."""
    named = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("<image ([0-9]+)>"), 1), lambda x: x.cast("int")))
    return F.concat(F.array_intersect(named, present), F.array_except(present, named))


def verdict(text: Column) -> Column:
    """Which answer a comparison prefers: 1 for A, 0 for B, one half for a tie, by the first grammar that matches."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\b(answer|response|draft) a (is|was) (better|best)\b"), 1.0)
        .when(low.rlike(r"\b(answer|response|draft) b (is|was) (better|best)\b"), 0.0)
        .when(low.rlike(r"\b(tie|equally good|neither of the two)\b"), 0.5)
    )


def bucket_of(score: Column, width: int = 20, top: int = 4) -> Column:
    """A score of 0 to 100 in five buckets."""
    return F.least(F.floor(score / width), F.lit(top)).cast("int")


def picked_captions(rows: DataFrame, group: str, text: str, kind: str, original: str, changed: str) -> DataFrame:
    """Groups with an original and a changed caption: which one to show is a stable bit of the group."""
    g = rows.groupBy(group).agg(F.min(F.when(F.col(kind) == original, F.col(text))).alias("o"), F.min(F.when(F.col(kind) == changed, F.col(text))).alias("c")).where("o is not null and c is not null")
    bit = rng.stable_bit(F.col(group).cast("string"))
    return g.select(group, F.when(bit == 1, F.col("o")).otherwise(F.col("c")).alias("shown"), bit.cast("double").alias("target"))


def action_steps(events: DataFrame, user: str, kinds: dict[str, str]) -> DataFrame:
    """Steps of each episode with the action's plain name; the last step is done."""
    w = Window.partitionBy(user).orderBy("ts", "event_id")
    name = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit("other"))
    return events.select(user, "event_id", F.row_number().over(w).alias("step"), name.alias("action"), (F.lead("event_id").over(w).isNull()).cast("int").alias("done"))


def novel_prompts(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose normalised prompt is not among the known ones."""
    keys = known.select(T.plain_prompt(F.col(column)).alias("_p")).distinct()
    return rows.withColumn("_p", T.plain_prompt(F.col(column))).join(keys, "_p", "left_anti").drop("_p")


def vote_hardness(rows: DataFrame, key: str, yes: Column) -> DataFrame:
    """Share of yes votes of each key, and whether the votes agree."""
    by = rows.groupBy(key).agg(F.count("*").alias("votes"), F.count_if(yes).alias("yes"))
    return by.select(key, "votes", F.round(F.col("yes") / F.col("votes"), 6).alias("share"), F.when((F.col("yes") == 0) | (F.col("yes") == F.col("votes")), "hard").otherwise("soft").alias("kind"))
