"""Joins, windows, sampling and set operations that converters and evaluation need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rng


def pooled_votes(votes: DataFrame, key: str, left: str, right: str, weight: str) -> DataFrame:
    """Votes for unordered pairs: the share that went to the smaller of the two, pairs without a strict winner dropped."""
    a, b = F.least(left, right), F.greatest(left, right)
    by = votes.where(F.col(left) != F.col(right)).groupBy(key, a.alias("a"), b.alias("b")).agg(
        F.sum(F.when(F.col(left) == a, F.col(weight)).otherwise(0)).alias("for_a"), F.sum(F.when(F.col(left) == b, F.col(weight)).otherwise(0)).alias("for_b")
    )
    return by.where("for_a <> for_b").withColumn("share_a", F.round(F.col("for_a") / (F.col("for_a") + F.col("for_b")), 6))


def ranked_pairs(rows: DataFrame, group: str, item: str, rank: str) -> DataFrame:
    """Pairs of items ranked together: how often the smaller item ranked higher; ties are left out.

    Items of one group become one sorted array, so pairs are made inside a row; groups are bounded lists of options.
    """
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(rank).alias("r")))).alias("x"))
    pairs = lists.select(F.explode(F.transform(F.col("x"), lambda a: F.transform(F.filter("x", lambda b: b["i"] > a["i"]), lambda b: F.struct(a["i"].alias("a"), b["i"].alias("b"), F.sign(b["r"] - a["r"]).alias("s"))))).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return pairs.where("s <> 0").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("s") > 0).alias("a_first"))


def vote_histogram(rows: DataFrame, key: str, rating: Column, levels: int = 5) -> DataFrame:
    """Share of valid ratings 1..levels of each key, as one target a level."""
    valid = rows.withColumn("_r", rating).where(F.col("_r").between(1, levels))
    n = F.count("*")
    return valid.groupBy(key).agg(n.alias("votes"), *(F.round(F.count_if(F.col("_r") == k) / n, 6).alias(f"p{k}") for k in range(1, levels + 1)))


def soft_levels(mean: Column, sd: Column, levels: int = 5) -> list[Column]:
    """Normal mass of each level 1..levels, cut at the half-way edges 1..levels-1 scaled, spread at least 1e-3.

    The error function is the rational approximation of Abramowitz and Stegun 7.1.26, exact to 1.5e-7.
    """
    s = F.greatest(sd, F.lit(1e-3))

    def cdf(x: float) -> Column:
        z = (F.lit(x) - mean) / (s * F.lit(2**0.5))
        t = 1 / (1 + 0.3275911 * F.abs(z))
        tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
        return F.when(z >= 0, 1 - tail / 2).otherwise(tail / 2)

    edges = [F.lit(0.0), *(cdf(float(k)) for k in range(1, levels)), F.lit(1.0)]
    return [F.round(b - a, 6) for a, b in zip(edges, edges[1:], strict=False)]


def balanced_swap(rows: DataFrame, key: Column, a: str, b: str) -> DataFrame:
    """Swap two options for about half of the keys, always the same ones."""
    bit = rng.stable_bit(key)
    return rows.withColumns({"swapped": bit, "first": F.when(bit == 1, F.col(b)).otherwise(F.col(a)), "second": F.when(bit == 1, F.col(a)).otherwise(F.col(b))})


def frequent_negatives(tags: DataFrame, item: str, tag: str, top: int, k: int, seed: int = 0) -> DataFrame:
    """k tags a item out of the most frequent ones that the item lacks, by hashed rank.

    The top list is bounded, so each item takes its candidates from one array.
    """
    counts = tags.groupBy(tag).agg(F.count_distinct(item).alias("n"), F.min(item).alias("first")).orderBy(F.desc("n"), "first", tag).limit(top)
    pool = counts.agg(F.array_sort(F.collect_list(tag)).alias("pool"))
    own = tags.groupBy(item).agg(F.collect_set(tag).alias("own"))
    left = own.join(F.broadcast(pool), F.lit(True)).select(item, F.explode(F.array_except("pool", "own")).alias(tag))
    w = Window.partitionBy(item).orderBy(rng.unit(seed, F.col(item), F.col(tag)), tag)
    return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def both_kinds(rows: DataFrame, group: str, kind: str, one: str, other: str, order: str) -> DataFrame:
    """Groups that have exactly the two kinds, with the first row of each."""
    g = rows.groupBy(group).agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.min(F.when(F.col(kind) == one, F.col(order))).alias("first_one"), F.min(F.when(F.col(kind) == other, F.col(order))).alias("first_other"))
    return g.where(F.col("kinds") == F.array_sort(F.array(F.lit(one), F.lit(other)))).drop("kinds")


def boxes_at(points: DataFrame, boxes: DataFrame, screen: str, cell: int = 256) -> DataFrame:
    """The smallest box around each point of the same screen.

    Equal places and equal rectangles are one during the search; rectangles are laid on a grid of cells and joined by
    cell, so the range condition has an equality to run on.
    """
    edges = ["x0", "y0", "x1", "y1"]
    kinds = boxes.where("x0 <= x1 and y0 <= y1").groupBy(screen, *edges).agg(F.min("box_id").alias("box_id"), F.count("*").alias("n"))
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    laid = kinds.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    p = points.select(screen, "x", "y").distinct().withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    inside = p.join(laid, [screen, "cx", "cy"]).where("x between x0 and x1 and y between y0 and y1")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    least = lambda c: F.min(c).alias("least")
    at = inside.groupBy(screen, "x", "y").agg(least(F.struct(area.alias("area"), F.col("box_id"))), F.sum("n").alias("n"))
    each = points.select(screen, "point_id", "x", "y").join(at, [screen, "x", "y"])
    return each.groupBy(screen, "point_id").agg(least("least"), F.sum("n").alias("around")).select(screen, "point_id", F.col("least.box_id").alias("box_id"), "around")


def occluded(boxes: DataFrame, screen: str, share: float = 0.5, cell: int = 256) -> DataFrame:
    """Boxes that a later box of their screen covers by at least the share of their area.

    Equal rectangles are one during the search, with their latest box. A box that covers half of another holds its
    centre, so centres are looked up in the other rectangles, by grid cell. A smaller share than one half needs no centre;
    then every cell of the box is looked up.
    """
    edges = ["x0", "y0", "x1", "y1"]
    spans = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    sound = boxes.where("x1 > x0 and y1 > y0").select(screen, "box_id", *edges)
    kinds = sound.groupBy(screen, *edges).agg(F.min("box_id").alias("first"), F.max("box_id").alias("last"))
    later = kinds.select(screen, F.col("last").alias("l_last"), *(F.col(c).alias(f"l_{c}") for c in edges))
    later = later.withColumn("cx", F.explode(spans("l_x0", "l_x1"))).withColumn("cy", F.explode(spans("l_y0", "l_y1")))
    if share >= 0.5:  # the middle of each axis lies in the overlap, whose width and height are half or more
        at = kinds.withColumns({"cx": F.floor((F.col("x0") + F.col("x1")) / 2 / cell), "cy": F.floor((F.col("y0") + F.col("y1")) / 2 / cell)})
    else:
        at = kinds.withColumn("cx", F.explode(spans("x0", "x1"))).withColumn("cy", F.explode(spans("y0", "y1")))
    w = F.greatest(F.least("x1", "l_x1") - F.greatest("x0", "l_x0"), F.lit(0))
    h = F.greatest(F.least("y1", "l_y1") - F.greatest("y0", "l_y0"), F.lit(0))
    cover = w * h >= share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    last = at.join(later, [screen, "cx", "cy"]).where((F.col("l_last") > F.col("first")) & cover).groupBy(screen, *edges).agg(F.max("l_last").alias("l_last"))
    return sound.join(last, [screen, *edges]).where(F.col("box_id") < F.col("l_last")).select(screen, "box_id").distinct()


def reservoir(rows: DataFrame, group: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows a group by hashed rank; ranks are limited before the exchange."""
    u = rng.unit(seed, F.col(key))
    return rows.withColumn("u", u).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("u", key))).where(F.col("rank") <= k).drop("u")


def until_total(rows: DataFrame, group: str, order: str, amount: str, limit: int) -> DataFrame:
    """The first rows of each group whose running total stays within the limit."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(amount).over(w)).where(F.col("running") <= limit)


def distinct_limited(rows: DataFrame, group: str, kind: str, order: str, k: int) -> DataFrame:
    """Rows of at most k distinct kinds a group, the kinds that come first."""
    kinds = rows.groupBy(group, kind).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_first", kind))
    return rows.join(kinds.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_first", "_rank"), [group, kind], "left_semi")


def hash_ranks(rows: DataFrame, group: str, key: str, seed: int | str = 0, slices: int = 1024) -> DataFrame:
    """``group``, ``key``, ``i`` (rank from 0 in a hashed order of the group), ``n`` (size of the group).

    Ranks come from counts of slices of the hash, so no task orders a whole group.
    """
    placed = rows.select(group, key, rng.unit(seed, F.col(key)).alias("u")).withColumn("slice", F.floor(F.col("u") * slices))
    counts = placed.groupBy(group, "slice").agg(F.count("*").alias("m"))
    w = Window.partitionBy(group)
    upto = F.sum("m").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    offsets = counts.select(F.col(group).alias("_g"), F.col("slice").alias("_s"), (upto - F.col("m")).alias("offset"), F.sum("m").over(w).alias("n"))
    inner = F.row_number().over(Window.partitionBy(group, "slice").orderBy("u", key)) - 1
    ranked = placed.withColumn("inner", inner)
    full = ranked.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("slice") == F.col("_s")))
    return full.select(group, key, (F.col("offset") + F.col("inner")).alias("i"), "n")


def derangement(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """A donor for every row of its group, never itself: the next in a hashed order, around the end."""
    ranked = hash_ranks(rows, group, key, seed).where("n >= 2")
    donors = ranked.select(group, F.col("i").alias("j"), F.col(key).alias("donor"))
    return ranked.withColumn("j", (F.col("i") + 1) % F.col("n")).join(donors, [group, "j"]).select(group, key, "donor")


def balanced(rows: DataFrame, kind: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each kind as the rarest has, by hashed rank; every column of a row with its key."""
    least = rows.groupBy(kind).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    ranked = hash_ranks(rows, kind, key, seed)
    return ranked.join(F.broadcast(least), F.lit(True)).where("i < least").select(kind, key)  # one row is sent


def tie_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Average ranks: equal values share the mean of their places."""
    w = Window.partitionBy(group)
    return rows.withColumn("tie_rank", F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(group, value)) - 1) / 2.0)


def first_seen(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Distinct values of each group in the order of their first appearance, as one list."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("f"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", F.col(value).cast("string").alias("v")))), lambda s: s["v"]), ",").alias("seen"))


def near_hashes(left: DataFrame, right: DataFrame, most: int = 4) -> DataFrame:
    """Pairs of 64-bit hashes within a Hamming distance: equal in one of five blocks, then counted exactly."""
    def blocks(df: DataFrame, name: str) -> DataFrame:
        cut = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
        parts = F.array(*(F.struct(F.lit(k).alias("b"), F.shiftrightunsigned("h", at).bitwiseAND((1 << n) - 1).alias("v")) for k, (at, n) in enumerate(cut)))
        return df.select(F.col("id").alias(name), F.col("h").alias(f"{name}_h"), F.explode(parts).alias("p")).select(name, f"{name}_h", "p.b", "p.v")

    pairs = blocks(left, "l").join(blocks(right, "r"), ["b", "v"])
    return pairs.select("l", "r", F.bit_count(F.col("l_h").bitwiseXOR(F.col("r_h"))).alias("distance")).where(F.col("distance") <= most).distinct()


def unpivot_pairs(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Two columns a row as two rows, each with its partner."""
    return rows.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(left).alias("own"), F.col(right).alias("partner")), F.struct(F.lit(1).alias("side"), F.col(right).alias("own"), F.col(left).alias("partner")))).alias("x")).select(key, "x.*")


def striped(rows: DataFrame, key: str, epoch: int, workers: int, seed: int = 0) -> DataFrame:
    """The order of an epoch dealt to workers: the rank in a hashed order modulo their number.

    Ranks come from slice counts, so no task orders all rows.
    """
    u = rng.unit(f"{seed}.{epoch}", F.col(key))
    placed = rows.select(key, u.alias("u"), F.floor(u * 1024).cast("int").alias("slice"))
    counts = placed.groupBy("slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("slice", before.alias("offset"))
    inner = F.row_number().over(Window.partitionBy("slice").orderBy("u", key)) - 1
    ranked = placed.withColumn("i", inner).join(F.broadcast(offsets), "slice").withColumn("rank", F.col("offset") + F.col("i"))
    return ranked.select(key, "rank", (F.col("rank") % workers).alias("worker"))
