"""Exact ranks and quantiles of many values without a task that holds all values of a key."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(values: DataFrame, key: str, value: str, **ranks) -> DataFrame:
    """Values at given ranks from 0 of each key; a rank is an expression of the number of rows ``n``.

    Equal values are counted first, so a task holds the distinct values of a key and not its rows.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto).join(counted.groupBy(key).agg(F.sum("_c").alias("n")), key)
    return placed.groupBy(key).agg(*(F.min(F.when(F.col("_upto") > F.expr(rank), F.col(value))).alias(name) for name, rank in ranks.items()))


def quantiles(rows: DataFrame, keys: list[str], value: str, **at: float) -> DataFrame:
    """Exact quantiles (linear between ranks) of each key's values.

    Values are counted in slices of their logarithm, and only the slices that hold a wanted rank are sorted, by distinct
    value; no task holds all values of a key.
    """
    v = F.col(value)
    known = rows.where(v.isNotNull()).select(*keys, v.alias("_v"), F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * 64).alias("_s"))
    order = Window.partitionBy(*keys).orderBy("_s")
    slices = known.groupBy(*keys, "_s").agg(F.count("*").alias("_m"))
    slices = slices.withColumns({"_before": F.sum("_m").over(order) - F.col("_m"), "_n": F.sum("_m").over(Window.partitionBy(*keys))})
    rank = lambda p: (F.col("_n") - 1) * F.lit(p)
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m"))
    wanted = slices.where(functools.reduce(lambda a, b: a | b, (inside(f(rank(p))) for p in at.values() for f in (F.floor, F.ceil)))).drop("_m")
    hit = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    counted = known.alias("_l").join(wanted.alias("_r"), [*hit, F.col("_l._s") == F.col("_r._s")]).groupBy(*(F.col(f"_l.{k}") for k in keys), "_l._s", "_before", "_n", "_v").agg(F.count("*").alias("_c"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_end", end)
    one = lambda r: F.max(F.when((r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")), F.col("_v")))
    ends = placed.groupBy(*keys, "_n").agg(*(one(f(rank(p))).alias(f"{name}{i}") for name, p in at.items() for i, f in enumerate((F.floor, F.ceil))))
    line = lambda name, p: F.col(f"{name}0") + (F.col(f"{name}1") - F.col(f"{name}0")) * (rank(p) - F.floor(rank(p)))
    return ends.select(*keys, *(F.round(line(name, p), 6).alias(name) for name, p in at.items()))
