"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are put in a random order, and as many rounds of that order are laid end to end as the source may
repeat. The virtual finish time of a document is the number of tokens its source has given out up to and with it,
divided by the source's weight. Sorted by finish time, all sources advance at their weights, and a source that has used
up its repeats simply ends; what it leaves goes to the others in proportion. The mix is the part of this order that fits
the budget.

Running sums are made in slices: tokens are added up by (source, slice of the hash), slice totals are summed over the
few slices, and only the order inside one slice is left to a task, so no task holds a whole source.

Cases: documents without a source, or of a source that is not listed, are in no mix; a listed source without documents
gives nothing and its share falls to the others; a null or negative share is 0 and a null ``max_repeats`` is 1; null and
empty texts have no tokens and go along with the document before them; repeated rows of one ``doc_id`` are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.tokenize import DEFAULT_VOCABULARY, token_counts
from tallyloom.workspace import Workspace

SLICES = 1024  # by the ten upper bits of the hash
TIME_SLICES = 4096


def weights(targets: DataFrame) -> DataFrame:
    """``source``, ``weight``, ``max_repeats``: one row for each listed source with a positive share."""
    return (
        targets.where("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    )


def finish_times(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``round`` (from 0) and ``finish``: one row for each allowed use."""
    h = F.xxhash64(F.lit(seed), "doc_id")
    docs = sized.join(weights(targets), "source").withColumns({"h": h, "slice": F.shiftrightunsigned(h, 54).cast("int")})
    slices = docs.groupBy("source", "slice").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    slices = slices.select("source", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("once"))
    inner = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("within", F.sum("n_tokens").over(inner)).join(slices, ["source", "slice"])
    uses = placed.where("max_repeats > 0").select(
        "doc_id",
        "source",
        "n_tokens",
        "weight",
        "once",
        (F.col("offset") + F.col("within")).alias("upto"),
        F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)).alias("round"),
    )
    finish = (F.col("round") * F.col("once") + F.col("upto")) / F.col("weight")
    return uses.select("doc_id", "source", "n_tokens", "round", finish.alias("finish"))


def full_shares_budget(sized: DataFrame, targets: DataFrame) -> int:
    """The largest budget in which every source that has tokens reaches its share: none has used up its repeats before.

    Sources without tokens can reach none; what they leave goes to the others in proportion.
    """
    tokens = sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    listed = weights(targets).join(tokens, "source")
    r = listed.agg(F.min(F.col("n") * F.col("max_repeats") / F.col("weight")).alias("finish"), F.sum("weight").alias("weight")).first()
    return int((r["finish"] or 0.0) * (r["weight"] or 0.0))


def mix(docs: DataFrame, targets: DataFrame, budget: int | str | None = None, seed: int = 0, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The mix in order: ``doc_id``, ``source``, ``round``, ``n_tokens``, ``finish``.

    ``budget`` is the total of tokens; by default as many as the documents of the listed sources have; ``shares`` is the
    largest one in which all shares hold.
    """
    ws = Workspace(docs.sparkSession)
    one = token_counts(docs.where("source is not null and doc_id is not null"), ["doc_id", "source"], vocabulary)
    sized = ws.put(one.groupBy("doc_id").agg(F.min_by("source", F.struct(F.col("n_tokens"), F.col("source"))).alias("source"), F.min("n_tokens").alias("n_tokens")), "sized")
    times = ws.put(finish_times(sized, targets, seed), "times")
    if budget == "shares":
        budget = full_shares_budget(sized, targets)
    elif budget is None:
        budget = sized.join(weights(targets), "source", "left_semi").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    last = times.agg(F.coalesce(F.max("finish"), F.lit(0.0))).first()[0] or 1.0
    tick = F.least(F.floor(F.col("finish") / F.lit(last) * TIME_SLICES), F.lit(TIME_SLICES - 1)).cast("int")
    ticked = times.withColumn("tick", tick)
    totals = ticked.groupBy("tick").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("tick", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    cut = totals.where((F.col("offset") <= budget) & (F.col("offset") + F.col("n") > budget)).first()
    if cut is None:
        inside = times
    else:  # one time slice straddles the budget and is cut exactly
        order = Window.partitionBy("tick").orderBy("finish", "source", "doc_id", "round").rowsBetween(Window.unboundedPreceding, 0)
        edge = ticked.where(F.col("tick") == cut["tick"]).withColumn("upto", F.sum("n_tokens").over(order) + cut["offset"])
        inside = ticked.where(F.col("tick") < cut["tick"]).drop("tick").unionByName(edge.where(F.col("upto") <= budget).drop("tick", "upto"))
    return inside.select("doc_id", "source", "round", "n_tokens", "finish").orderBy("finish", "source", "doc_id", "round")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share, tokens, uses and largest number of uses of a document, for each listed source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("round") + 1).alias("most_uses"))
    listed = weights(targets).join(got, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.greatest(F.sum(zero("tokens")).over(Window.partitionBy(F.lit(0))), F.lit(1))
    return listed.select(
        "source",
        F.round("weight", 6).alias("target_share"),
        F.round(zero("tokens") / total, 6).alias("actual_share"),
        zero("tokens").alias("tokens"),
        zero("uses").alias("uses"),
        zero("most_uses").alias("most_uses"),
        "max_repeats",
    )
