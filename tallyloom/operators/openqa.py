"""Open questions made into choices: distractors from the same image, from changed numbers, and from pools of answers.

Questions are rows (``qid``, ``image``, ``question``, ``answer``); ``qid`` is unique. Chances are hashes of ``qid``.

Cases: a question without an answer makes no row; a question without an image has no neighbours; answers are compared in
lower case; who finds fewer than three distractors gets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rng
from tallyloom.functions import text as T
from tallyloom.operators.relational import hash_ranks
from tallyloom.workspace import Workspace

NEAR = 5.0
FIRST_TRIES, ALL_TRIES = 24, 200
FIRST_DRAWS, DRAWS = 6, 16


def changed_numbers(rows: DataFrame, n: int = 3, ws: Workspace | None = None) -> DataFrame:
    """``qid``, ``place``, ``text``: n other values of each number, written alike.

    Values lie 10 to 50 % away; years move by 1 to 10; zero gets small values; whole numbers that would stay move by a
    step that grows with the tries, and do not change their sign. All rows make a few tries, those in need all 200. With a
    workspace the rows of each number of tries are written, so no try is made again by a filter that the planner moves.
    """
    known = rows.where(T.is_number(F.col("answer"))).select("qid", "answer", F.coalesce("question", F.lit("")).alias("question"), T.number(F.col("answer")).alias("v"))
    # a whole number has neither a fraction nor an exponent; the percent sign may stand
    whole = ~F.trim("answer").rlike(r"[.eE]")
    known = known.withColumns({"whole": whole, "year": whole & F.col("v").between(1800, 2100) & F.lower("question").contains("year")})
    known = known.withColumns({f"part{k}": c for k, c in enumerate(T.number_parts(F.col("answer")))})

    v, whole = F.col("v"), F.col("whole")
    own = tuple(F.col(f"part{k}") for k in range(4))

    def texts(upto: int) -> Column:
        """The first n texts of so many tries, within the row: each step is an array, so no try is written or computed twice."""
        sign = lambda k: F.when(rng.unit("number.sign", F.col("qid"), k) < 0.5, -1.0).otherwise(1.0)
        tries = F.transform(F.sequence(F.lit(0), F.lit(upto - 1)), lambda k: F.struct(k.alias("k"), sign(k).alias("sign"), rng.unit("number.size", F.col("qid"), k).alias("size")))
        tries = F.transform(tries, lambda t: F.struct(t["k"].alias("k"), t["sign"].alias("sign"), t["size"].alias("size"), (v * (1 + t["sign"] * (0.1 + 0.4 * t["size"]))).alias("moved")))
        values = F.transform(
            tries,
            lambda t: F.when(F.col("year"), v + t["sign"] * (1 + F.floor(t["size"] * 10)))
            .when(v == 0, F.when(whole, 1 + F.floor(t["size"] * 5).cast("double")).otherwise(F.round(0.1 + 4.9 * t["size"], 2)))
            .when(whole & (F.bround(t["moved"], 0) == v), v + t["sign"] * (1 + F.floor(t["k"] / 10)))
            .otherwise(t["moved"]),
        )
        made = F.transform(F.filter(values, lambda c: ~(whole & (v >= 0) & (c < 0))), lambda c: T.format_like(c, own))
        return F.slice(F.filter(F.array_distinct(made), lambda x: T.number(x) != v), 1, n)

    if ws:
        found, known = None, ws.put(known, "numbers")
        for upto in (FIRST_TRIES // 3, FIRST_TRIES, 2 * FIRST_TRIES, ALL_TRIES):
            tried = ws.put(known.withColumn("texts", texts(upto)), f"numbers{upto}")
            done = tried.where(F.size("texts") >= n) if upto < ALL_TRIES else tried
            found, known = done if found is None else found.unionByName(done), tried.where(F.size("texts") < n).drop("texts")
        return found.select("qid", F.posexplode("texts").alias("place", "text")).select("qid", (F.col("place") + 1).alias("place"), "text")
    found = known.withColumn("texts", texts(FIRST_TRIES // 3))  # the first tries of more tries are the same
    for upto in (FIRST_TRIES, ALL_TRIES):
        found = found.withColumn("texts", F.when(F.size("texts") >= n, F.col("texts")).otherwise(texts(upto)))
    return found.select("qid", F.posexplode("texts").alias("place", "text")).select("qid", (F.col("place") + 1).alias("place"), "text")


def pool_draws(rows: DataFrame, pools: DataFrame, n: int = 3, seed: str = "draw", apart: str | None = None, ws: Workspace | None = None) -> DataFrame:
    """``qid``, ``pool``, ``place``, ``text``: n answers of a pool for each (qid, pool, answer), by weight, without the own one
    and, where a column ``apart`` of both sides is named, only of rows that differ in it.

    ``pools`` (pool, qid, answer) are all answers. Weights are counts, so a draw is the answer of a hashed member of the
    pool: an equality on its number, and no question meets the whole pool. Who lacks some after DRAWS draws, because
    the pool is small or one answer outweighs it, takes the rest from the list of answers by the largest
    log(u) / weight, which goes on with the same distribution. With a workspace draws are
    written, and only who lacks some after a few makes all of them.

    Sides with a row for each question are merged and never broadcast, whatever size the planner expects of them.
    """
    ranked = hash_ranks(pools, "pool", "qid", seed).join(pools.hint("merge"), ["pool", "qid"])
    more = [apart] if apart else []
    other = F.col("_apart") != F.col(apart) if apart else F.lit(True)
    numbered = ranked.select("pool", F.col("i").alias("at"), F.col("answer").alias("text"), *(F.col(c).alias("_apart") for c in more))
    numbered = ws.put(numbered, f"pool.{seed}") if ws else numbered
    sizes = pools.groupBy("pool").agg(F.count("*").alias("total"))
    asked = rows.select("qid", "pool", F.lower("answer").alias("own"), *more).join(sizes, "pool")

    def draws(asked: DataFrame, upto: int) -> DataFrame:
        """The first n different answers of so many draws, and how many there are."""
        tries = asked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(upto))))
        tries = tries.withColumn("at", F.floor(rng.unit(seed, F.col("qid"), F.col("pool"), F.col("k")) * F.col("total")))
        hit = tries.join(numbered.hint("merge"), ["pool", "at"]).where((F.lower("text") != F.col("own")) & other)
        one = hit.groupBy("qid", "pool", F.lower("text").alias("low")).agg(F.min("k").alias("k"), F.min_by("text", "k").alias("text"))
        w = Window.partitionBy("qid", "pool")
        return one.withColumns({"place": F.row_number().over(w.orderBy("k")), "some": F.count("*").over(w)}).where(F.col("place") <= n)

    if ws:  # the first draws of more draws are the same
        first = ws.put(draws(asked, FIRST_DRAWS), f"draws.{seed}.{FIRST_DRAWS}")
        whole = first.where(F.col("some") >= n)
        lacking = asked.join(whole.where("place = 1").select("qid", "pool").hint("merge"), ["qid", "pool"], "left_anti")
        drawn = whole.unionByName(ws.put(draws(lacking, DRAWS), f"draws.{seed}.{DRAWS}"))
    else:
        drawn = draws(asked, DRAWS)
    have = drawn.groupBy("qid", "pool").agg(F.count("*").alias("have"), F.collect_list("low").alias("got"))  # n at most
    short = asked.join(have.hint("merge"), ["qid", "pool"], "left").where(F.coalesce("have", F.lit(0)) < n)
    listed = pools.groupBy("pool", F.lower("answer").alias("low"), *(F.col(c).alias("_apart") for c in more)).agg(F.count("*").alias("w"), F.min("answer").alias("text"))
    left = short.join(listed, "pool").where((F.col("low") != F.col("own")) & ~F.coalesce(F.array_contains("got", F.col("low")), F.lit(False)) & other)
    if apart:
        left = left.groupBy("qid", "pool", "have", "low").agg(F.sum("w").alias("w"), F.min("text").alias("text"))
    key = F.ln(F.greatest(rng.unit(seed, F.col("qid"), F.col("pool"), F.col("low")), F.lit(1e-300))) / F.col("w")
    after = F.row_number().over(Window.partitionBy("qid", "pool").orderBy(F.desc(key), "low")) + F.coalesce("have", F.lit(0)).cast("int")
    rest = left.withColumn("place", after).where(F.col("place") <= n)
    return drawn.select("qid", "pool", "place", "text").unionByName(rest.select("qid", "pool", "place", "text"))


def distractors(rows: DataFrame, n: int = 3) -> DataFrame:
    """``qid``, ``rank``, ``text``, ``origin``: n distractors of every question that has as many.

    In this order: answers of the same kind to other questions on the image (numbers in the same notation and within
    five times), changed numbers or draws from the pools of the question's first three words, two words and its kind,
    and colour words. Answers of yes and no are no distractors.
    """
    q = rows.where("answer is not null and trim(answer) <> ''").select("qid", "image", F.coalesce("question", F.lit("")).alias("question"), F.trim("answer").alias("answer"))
    q = q.withColumns({"kind": T.answer_kind(F.col("question"), F.col("answer")), "keys": T.pool_keys(F.col("question"), F.col("answer")), "v": T.number(F.col("answer")), "notation": T.notation(F.col("answer"))})
    other = q.where(T.yes_no(F.col("answer")).isNull()).select("image", "kind", F.col("qid").alias("o"), F.col("answer").alias("text"), F.col("v").alias("ov"), F.col("notation").alias("on"))
    size = lambda c: F.when(F.abs(c) == 0, 1.0).otherwise(F.abs(c))
    near = (F.col("on") == F.col("notation")) & (size(F.col("ov")) / size(F.col("v"))).between(1 / NEAR, NEAR)
    met = q.join(other, ["image", "kind"]).where((F.col("o") != F.col("qid")) & ((F.col("kind") != "number") | near))
    same = met.select("qid", F.lit(0).alias("step"), rng.unit("image", F.col("qid"), F.col("o")).alias("order"), "text", F.lit("same_image").alias("origin"))
    changed = changed_numbers(q, n).select("qid", F.lit(1).alias("step"), F.col("place").cast("double").alias("order"), "text", F.lit("perturb").alias("origin"))
    worded = q.where("kind <> 'number'").select("qid", "answer", F.posexplode("keys").alias("at", "pool"))
    drawn = pool_draws(worded, worded.select("pool", "qid", "answer").dropDuplicates(["pool", "qid"]), n)
    level = worded.groupBy("qid", "pool").agg(F.min("at").alias("at"))
    pooled = drawn.join(level, ["qid", "pool"]).select("qid", (F.col("at") + 2).alias("step"), F.col("place").cast("double").alias("order"), "text", F.concat(F.lit("pool:"), "pool").alias("origin"))
    fill = F.explode(F.array(*(F.lit(c) for c in T.COLOURS if c != "grey")))
    coloured = q.where("kind = 'color'").select("qid", "answer", fill.alias("c"))
    upper = F.substring("answer", 1, 1).rlike(r"\p{Lu}")
    colours = coloured.select("qid", F.lit(9).alias("step"), rng.unit("colour", F.col("qid"), F.col("c")).alias("order"), F.when(upper, F.initcap("c")).otherwise(F.col("c")).alias("text"), F.lit("color_list").alias("origin"))
    every = same.unionByName(changed).unionByName(pooled).unionByName(colours).join(q.select("qid", F.lower("answer").alias("own")), "qid").where(F.lower("text") != F.col("own"))
    first = F.row_number().over(Window.partitionBy("qid", F.lower("text")).orderBy("step", "order", "text"))
    distinct = every.withColumn("_f", first).where("_f = 1")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("step", "order", "text"))
    kept = distinct.withColumn("rank", rank).where(F.col("rank") <= n)
    enough = kept.groupBy("qid").agg(F.count("*").alias("_n")).where(F.col("_n") == n).select("qid")
    return kept.join(enough, "qid", "left_semi").select("qid", "rank", "text", "origin")
