"""Splits that keep related records together.

Records are tied by keys (a shared grid, a shared cluster). Each key is represented by its smallest record number, each
record with two keys is an edge between two representatives, and components of these edges are found by parallel
hooking (every root takes the smallest root it is linked to) and shortcutting (pointer jumping) over a parent table.
After each round only edges between different roots remain, so the work shrinks at least by half a round.

Split totals come from the sizes of the components alone: a bitset holds every total that some subset of components
can reach, and the reachable total closest to the target is taken and traced back to a number of components per size.

Cases: a null ``rec_key`` names no record and gets no row; a record without usable keys is a group of its own; repeated
rows are one record; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.workspace import Workspace

BLANK = ("", "-", "nan", "None")


def usable(c: Column) -> Column:
    """The trimmed key, or null if it is blank."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t.isin(*BLANK), None).otherwise(t)


def tie_keys(records: DataFrame) -> DataFrame:
    """``rec_key``, ``gkey``, ``ckey``: a grid without ``/`` is local to its source."""
    grid = usable(F.col("grid_id"))
    full = F.when(grid.contains("/"), grid).otherwise(F.concat(F.coalesce(F.col("source"), F.lit("")), F.lit("/"), grid))
    return records.where(F.col("rec_key").isNotNull()).select(
        "rec_key",
        F.concat(F.lit("g:"), full).alias("gkey"),
        F.concat(F.lit("c:"), usable(F.col("cluster"))).alias("ckey"),
    )


def _flatten(ws: Workspace, hooks: DataFrame, tag: str) -> DataFrame:
    """Shortcut (node, parent) until every parent is a root."""
    step = 0
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        jumped = hooks.join(up, "parent", "left").select(
            "node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")
        )
        nxt, moved = ws.put_counted(jumped, f"{tag}-jump{step}", "moved")
        if not moved:
            return nxt.select("node", "parent")
        if step:
            ws.drop(f"{tag}-jump{step - 1}")
        hooks, step = nxt.select("node", "parent"), step + 1


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of the edges (``a``, ``b``); the root is the component's smallest node."""
    turn = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, n = ws.put_counted(turn(edges), "edges0")
    parents, k = None, 0
    while n:
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        flat = _flatten(ws, hooks, f"hook{k}")
        to = lambda col: flat.select(F.col("node").alias(col), F.col("parent").alias(f"{col}_root"))
        if parents is None:
            parents = flat.select("node", F.col("parent").alias("root"))
        else:  # roots of earlier rounds that were hooked now, and those that only now became children
            moved = parents.join(to("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root"))
            fresh = flat.join(parents, "node", "left_anti").select("node", F.col("parent").alias("root"))
            parents = moved.unionByName(fresh)
        parents = ws.put(parents, f"parents{k}")
        left = edges.join(to("a"), "a", "left").join(to("b"), "b", "left")
        edges, n = ws.put_counted(
            turn(left.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), f"edges{k + 1}"
        )
        for name in (f"edges{k}", f"parents{k - 1}"):  # nothing reads them any more
            ws.drop(name)
        k += 1
    if parents is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = parents.select(F.col("root").alias("node"), "root").distinct()
    return parents.unionByName(roots)


def tied_groups(records: DataFrame) -> DataFrame:
    """``rec_key``, ``group_key``, ``tied``: one row a record; ``tied`` says that the group has another record."""
    ws = Workspace(records.sparkSession)
    keys = tie_keys(records)
    members = keys.select(F.explode(F.array_compact(F.array("gkey", "ckey"))).alias("key"), "rec_key")
    reps = ws.put(members.groupBy("key").agg(F.min("rec_key").alias("rep"), F.max("rec_key").alias("last")), "reps")
    both = keys.where("gkey is not null and ckey is not null").select("gkey", "ckey").distinct()
    rep = lambda name: reps.select(F.col("key").alias(name), F.col("rep").alias(f"{name}_rep"))
    edges = both.join(rep("gkey"), "gkey").join(rep("ckey"), "ckey").select(F.col("gkey_rep").alias("a"), F.col("ckey_rep").alias("b"))
    roots = components(ws, edges).select(F.col("node").alias("rep"), "root")
    rooted = reps.join(roots, "rep", "left").select("key", "rep", "last", F.coalesce("root", "rep").alias("group_key"))
    rooted = ws.put(rooted, "rooted")
    spread = rooted.groupBy("group_key").agg((F.max("last") > F.min("rep")).alias("tied"))
    of_key = ws.put(rooted.join(spread, "group_key").select("key", "group_key", "tied"), "of_key")
    own = keys.select("rec_key", F.coalesce("gkey", "ckey").alias("key")).distinct()
    return (
        own.join(of_key, "key", "left")
        .groupBy("rec_key")
        .agg(F.min(F.coalesce("group_key", "rec_key")).alias("group_key"), F.coalesce(F.max("tied"), F.lit(False)).alias("tied"))
    )


def closest_counts(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as close to ``target`` as any choice can come.

    Filled from the largest size on, the counts already lie next to a best choice: changes can be ordered so that the
    total never strays further than the largest size, and a stretch of changes that returns to one total can be left
    out, so some best choice differs by fewer than twice the largest size in groups (Steinitz). Counts outside that
    reach are settled by the filling, at every size of the input. For what is open the multiplicity of a size is cut
    into binary pieces and one bitset gains a shift by each piece. The bitset has at most as many bits as the target
    and a group, so what is sent to the driver and held there follows the groups that are open and not the records.
    """
    total = sum(s * c for s, c in sizes.items())
    target = max(0, min(target, total))
    filled, rest = {}, target
    for s in sorted(sizes, reverse=True):
        filled[s] = min(sizes[s], rest // s)
        rest -= s * filled[s]
    reach = 2 * max(sizes, default=0)
    taken = {s: max(0, filled[s] - reach) for s in sizes}
    left = {s: min(sizes[s], filled[s] + reach) - taken[s] for s in sizes}
    rest = target - sum(s * c for s, c in taken.items())
    width = min(sum(s * c for s, c in left.items()), rest + max(left, default=0)) + 1
    items = []
    for s in sorted(left, reverse=True):
        c, k = min(left[s], math.ceil(width / s)), 1
        while c > 0:
            items.append((s, min(k, c)))
            c, k = c - k, k * 2
    mask, bits = (1 << width) - 1, 1
    first = np.full(width, len(items), dtype=np.uint8 if len(items) < 255 else np.uint16)
    for i, (s, k) in enumerate(items):
        grown = (bits | (bits << (s * k))) & mask
        raw = np.frombuffer((grown ^ bits).to_bytes((width + 7) // 8, "little"), dtype=np.uint8)
        for lo in range(0, len(raw), 1 << 20):  # in parts, for the places of a part take 64 times its bytes
            at = np.flatnonzero(raw[lo : lo + (1 << 20)]) + lo
            first[(at[:, None] * 8 + np.arange(8))[np.unpackbits(raw[at], bitorder="little").reshape(-1, 8).astype(bool)]] = i
        bits = grown
    reached = np.flatnonzero(first < len(items))
    at = np.searchsorted(reached, rest)
    near = [0, *(int(reached[i]) for i in (at - 1, at) if 0 <= i < len(reached))]
    t = min(near, key=lambda x: (abs(x - rest), x))
    while t > 0:
        s, k = items[first[t]]
        taken[s] += k
        t -= s * k
    return taken


def assign_splits(groups: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``rec_key``, ``group_key``, ``split`` with whole groups and totals closest to the target shares.

    What reaches the driver is the number of groups of each size: at most the square root of twice the records.
    Groups of one size are ranked by hash in 256 slices whose offsets come from counts, so no task holds a whole size.
    """
    spark = groups.sparkSession
    ws = Workspace(spark)
    groups = ws.put(groups.select("rec_key", "group_key"), "groups")
    sized = ws.put(groups.groupBy("group_key").agg(F.count("*").alias("size")), "sized")
    sizes = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(s * c for s, c in sizes.items())
    wanted = targets.where("split is not null").groupBy("split").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("s"))
    shares = sorted((r["s"], r["split"]) for r in wanted.collect())
    if not shares:
        raise ValueError("no split has a target share")
    norm = sum(s for s, _ in shares) or 1.0
    cuts, left, done = [], dict(sizes), dict.fromkeys(sizes, 0)
    for share, name in shares[:-1]:
        chosen = closest_counts(left, round(total * share / norm))
        for s, k in chosen.items():
            if k:
                cuts.append((s, done[s], done[s] + k, name))
                done[s] += k
                left[s] -= k
    h = F.xxhash64(F.lit(seed), "group_key")
    placed = sized.select("group_key", "size", h.alias("h"), F.shiftrightunsigned(h, 56).cast("int").alias("slice"))
    slices = placed.groupBy("size", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("size", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("size", "slice").orderBy("h", "group_key")
    ranked = placed.join(slices, ["size", "slice"]).withColumn("rank", F.col("offset") + F.row_number().over(inner) - 1)
    cut = spark.createDataFrame(cuts or [(0, 0, 0, shares[-1][1])], "size long, lo long, hi long, split string")
    on = (ranked["size"] == cut["size"]) & (ranked["rank"] >= cut["lo"]) & (ranked["rank"] < cut["hi"])
    split = ranked.join(cut, on, "left").select("group_key", F.coalesce("split", F.lit(shares[-1][1])).alias("split"))
    return groups.join(split, "group_key").select("rec_key", "group_key", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Records, groups, target share and actual share of each split of the targets."""
    n = assigned.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_key").alias("groups"))
    shares = targets.where("split is not null").groupBy("split").agg(F.max("target_share").alias("target_share"))
    full = shares.join(n, "split", "left").select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"))
    total = F.sum("records").over(Window.partitionBy())
    return full.withColumn("actual_share", F.round(F.col("records") / F.greatest(total, F.lit(1)), 6))
