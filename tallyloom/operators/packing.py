"""Batches and packing by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rng
from tallyloom.functions.ranks import ranked


def folded(lengths: Column, fits) -> Column:
    """Batch numbers of lengths in order: a batch is closed when one more row would not fit.

    ``fits(longest, rows)`` says whether so many rows of the longest length fit.
    """
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("rows"), F.lit(0).alias("longest"), F.array().cast("array<int>").alias("out"))

    def step(s, n):
        longest = F.greatest(s["longest"], n)
        stay = (s["rows"] == 0) | fits(longest, s["rows"] + 1)
        batch = F.when(stay, s["batch"]).otherwise(s["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(stay, s["rows"] + 1).otherwise(1).alias("rows"), F.when(stay, longest).otherwise(n).alias("longest"), F.concat(s["out"], F.array(batch)).alias("out"))

    return F.aggregate(lengths, start, step, lambda s: s["out"])


def micro_batches(rows: DataFrame, key: str, length: str, budget: int, buffer: int = 64, seed: int = 0) -> DataFrame:
    """Rows in a hashed order are cut into buffers, sorted by length in each, and packed while longest x rows fits.

    A buffer is the bounded unit of work; buffers come from slices of the hash, so no task orders all rows.
    """
    u = rng.unit(seed, F.col(key))
    placed = rows.select(F.col(key).alias("key"), F.col(length).cast("int").alias("len"), u.alias("u")).withColumn("slice", F.floor(F.col("u") * 256).cast("int"))
    inner = F.row_number().over(Window.partitionBy("slice").orderBy("u", "key")) - 1
    buffers = placed.withColumn("buffer", F.floor(inner / buffer)).groupBy("slice", "buffer").agg(F.array_sort(F.collect_list(F.struct("len", "key"))).alias("r"))
    packed = buffers.withColumn("b", folded(F.transform("r", lambda x: x["len"]), lambda longest, n: longest * n <= budget))
    out = packed.select("slice", "buffer", F.explode(F.arrays_zip("r", "b")).alias("x"))
    return out.select("slice", "buffer", F.col("x.b").alias("batch"), F.col("x.r.key").alias(key), F.col("x.r.len").alias("len"))


def request_chunks(questions: DataFrame, group: str, name: str, length: str, budget: int = 32_768) -> DataFrame:
    """Questions of a request sorted by length and name, packed while longest x questions stays in the budget."""
    lists = questions.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(length).cast("int").alias("len"), F.col(name).alias("name")))).alias("r"))
    packed = lists.withColumn("b", folded(F.transform("r", lambda x: x["len"]), lambda longest, n: longest * n <= budget))
    out = packed.select(group, F.explode(F.arrays_zip("r", "b")).alias("x"))
    return out.select(group, F.col("x.r.name").alias("name"), F.col("x.r.len").alias("len"), F.col("x.b").alias("chunk"))


def padded(ids: Column, to: Column, fill: int) -> tuple[Column, Column]:
    """Ids padded on the right, and the mask of real places."""
    gap = F.greatest(to - F.size(ids), F.lit(0)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(fill), gap)), F.concat(F.transform(ids, lambda x: F.lit(1)), F.array_repeat(F.lit(0), gap))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])


def path(n: Column, state_tokens: Column, pictured: Column, repeated: Column, least_prefix: int = 4096, least_saved: int = 2048) -> Column:
    """How a request is run: one question behind a kept prefix or alone; several with a shared state where there are
    pictures or enough tokens are saved, else in rows. ``repeated`` says that a picture layout repeats the state."""
    return (
        F.when((n == 1) & (state_tokens >= least_prefix) & ~repeated, "prefix")
        .when(n == 1, "single")
        .when(pictured | ((n - 1) * state_tokens >= least_saved), "shared batches")
        .otherwise("row batches")
    )


def sampled_questions(questions: DataFrame, group: str, name: str, k: int = 4, seed: int = 0) -> DataFrame:
    """At most k questions of a record by hashed rank; with one option, or too long, they are skipped with the reason."""
    u = rng.unit(seed, F.col(group), F.col(name))
    reason = F.when(F.col("options") == 1, "single_option").when(F.col("len") > 60, "too_long")
    tagged = questions.withColumn("reason", reason)
    ok = tagged.where("reason is null").withColumn("u", u).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("u", name)))
    return ok.withColumn("reason", F.when(F.col("rank") > k, "not_drawn")).drop("u", "rank").unionByName(tagged.where("reason is not null"))


def token_stats(rows: DataFrame, kind: str, length: str) -> DataFrame:
    """Rows, mean, upper median and largest length, by kind; the median from the counts of each length."""
    sums = rows.groupBy(kind).agg(F.count("*").alias("rows"), F.round(F.avg(length), 6).alias("mean"), F.max(length).alias("longest"))
    return sums.join(ranked(rows, kind, length, upper_median="n div 2"), kind, "left").select(kind, "rows", "mean", "upper_median", "longest")
