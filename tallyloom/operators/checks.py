"""Request rules, text extraction of states, order-dependent near-duplicates, latency curves and other small operators."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import rng
from tallyloom.functions.ranks import quantiles
from tallyloom.workspace import Workspace

MODELS = ("nova-s", "nova-m")
# Short wordings of a generic question.
GENERIC = {"zh": ("请作答。", "请选择。"), "en": ("Answer the question.", "Choose the best option.", "What is right?")}


def request_errors(rows: DataFrame, model: Column, types: Column, options: Column, blank_label: Column) -> DataFrame:
    """The first rule a request breaks, null for a good one."""
    fault = (
        F.when(~model.isin(*MODELS) | model.isNull(), "unknown model")
        .when(types.isNull() | ~types.isin("noul", "choice", "score"), "unknown type")
        .when((types == "choice") & ((options < 1) | (options > 255)), "1 to 255 options")
        .when((types == "score") & ((options < 1) | (options > 10)), "1 to 10 levels")
        .when((types == "choice") & blank_label, "empty label")
    )
    return rows.withColumn("fault", fault)


def _leaves(x, numbers: bool) -> list[str]:
    out, stack = [], [x]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            stack.extend([w for k, w in v.items() if k != "image"][::-1])
        elif isinstance(v, list):
            stack.extend(v[::-1])
        elif numbers and v is not None:
            out.append(json.dumps(v))
    return out


def leaf_text(numbers: bool):
    """Strings of a state in written order without what stands under ``image``; with numbers for quality reports."""

    def one(s):
        try:
            return " ".join(_leaves(json.loads(s), numbers))
        except (ValueError, RecursionError):
            return s

    @F.pandas_udf("string")
    def run(states: pd.Series) -> pd.Series:
        return states.map(one, na_action="ignore")

    return run


def canonical(state: Column) -> Column:
    """JSON with sorted members and one spelling; what is no JSON stands as it is."""

    def one(s):
        try:
            return json.dumps(json.loads(s), sort_keys=True, ensure_ascii=False).encode("utf-8", "replace").decode()
        except (ValueError, RecursionError):
            return s

    @F.pandas_udf("string")
    def run(states: pd.Series) -> pd.Series:
        return states.map(one, na_action="ignore")

    return run(state)


def greedy_distinct(rows: DataFrame, group: str, order: str, h: str, most: int = 2) -> DataFrame:
    """Rows kept in order if no kept row of their group is within a Hamming distance of their 64-bit hash.

    Equal hashes are settled first: all but the first row go. Near ones are equal in one of ``most`` + 1 blocks; each
    later row waits for the earlier ones it is near to. In every round rows that wait for nobody are kept, and what
    is near to them goes, until nobody waits; there are as many rounds as rows wait for each other in a chain.
    """
    ws = Workspace(rows.sparkSession)
    g = F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g")
    first = ws.put(rows.where(F.col(h).isNotNull()).groupBy(group, F.col(h).alias("h")).agg(F.min(order).alias("at")), "first")
    size = 64 // (most + 1)
    cuts = [(k * size, size if k < most else 64 - size * most) for k in range(most + 1)]
    part = F.explode(F.array(*(F.struct(F.lit(k).alias("b"), F.shiftrightunsigned("h", at).bitwiseAND((1 << n) - 1 if n < 64 else -1).alias("v")) for k, (at, n) in enumerate(cuts))))
    cut = first.select(g, F.col(group).isNull().alias("none"), "at", "h", part.alias("p")).select("g", "none", "at", "h", "p.b", "p.v")
    late = cut.select("g", "none", "b", "v", F.col("at").alias("late"), F.col("h").alias("lh"))
    near = cut.join(late, ["g", "none", "b", "v"]).where((F.col("at") < F.col("late")) & (F.bit_count(F.col("h").bitwiseXOR(F.col("lh"))) <= most))
    waits, n = ws.put_counted(near.select("g", "none", F.col("at").alias("early"), "late").distinct(), "waits0")
    gone, k = None, 0
    key = ["g", "none"]
    while n:
        free = waits.select(*key, F.col("early").alias("x")).distinct().join(waits.select(*key, F.col("late").alias("x")).distinct(), [*key, "x"], "left_anti")
        out = ws.put(waits.join(free.withColumnRenamed("x", "early"), [*key, "early"], "left_semi").select(*key, F.col("late").alias("x")).distinct(), f"gone{k}")
        gone = out if gone is None else gone.unionByName(out)
        left = waits.join(out.withColumnRenamed("x", "late"), [*key, "late"], "left_anti").join(out.withColumnRenamed("x", "early"), [*key, "early"], "left_anti")
        waits, n = ws.put_counted(left, f"waits{k + 1}")
        k += 1
    kept = first.select(group, F.col("at").alias(order), F.col("h").alias(h))
    if gone is None:
        return kept
    dropped = gone.select(F.col("g").alias("_g"), F.col("none").alias("_none"), F.col("x").alias("_x"))
    return kept.join(dropped, (g == F.col("_g")) & (F.col(group).isNull() == F.col("_none")) & (F.col(order) == F.col("_x")), "left_anti")


def generic_variant(questions: DataFrame, seed: int = 0) -> DataFrame:
    """A variant of each choice with a generic instruction of its language, picked by hash."""
    pick = lambda lang: F.element_at(F.array(*(F.lit(x) for x in GENERIC[lang])), (F.floor(rng.unit(f"{seed}.generic", F.col("rec_key"), F.col("name")) * len(GENERIC[lang])) + 1).cast("int"))
    zh = F.coalesce("instructions", F.lit("")).rlike("[一-鿿]")
    return questions.where("type = 'choice'").select("rec_key", "name", F.when(zh, pick("zh")).otherwise(pick("en")).alias("instructions"))


def latency_curve(rows: DataFrame, cell: list[str], order: str, ms: str) -> DataFrame:
    """First sample apart; median (linear), least and largest of the others."""
    known = rows.where(F.col(ms).isNotNull())
    first = known.groupBy(*cell).agg(F.min_by(ms, order).alias("first_ms"), F.min(order).alias("_first"))
    rest = known.join(first.select(*cell, "_first"), cell).where(F.col(order) != F.col("_first"))
    others = rest.groupBy(*cell).agg(F.count("*").alias("n"), F.min(ms).alias("least"), F.max(ms).alias("most"))
    full = first.join(others, cell, "left").join(quantiles(rest, cell, ms, p50=0.5), cell, "left")
    return full.select(*cell, "first_ms", F.coalesce("n", F.lit(0)).alias("n"), "p50", "least", "most")


def bootstrap_clusters(rows: DataFrame, cluster: str, record: str, question: str, least: int = 20) -> DataFrame:
    """The unit of resampling: the cluster, or the record where it has none; single questions if clusters are too few."""
    unit = F.coalesce(F.col(cluster), F.col(record).cast("string"))
    n = rows.agg(F.count_distinct(unit).alias("clusters"))
    fall = F.when(F.col("clusters") < least, F.concat_ws("/", F.col(record).cast("string"), F.col(question))).otherwise(unit)
    return rows.join(F.broadcast(n), F.lit(True)).withColumn("unit", fall)


def with_split(steps: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Steps with the split of their episode, ``unknown`` where no list names it."""
    return steps.join(splits, key, "left").withColumn("split", F.coalesce("split", F.lit("unknown")))


def comma_options(c: Column) -> Column:
    """Four distinct options of the form ``Options: a, b, c, d.``; null for others."""
    body = F.regexp_extract(c, r"Options:\s*([^\n]*?)\.?\s*$", 1)
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x))
    return F.when((F.size(parts) == 4) & (F.size(F.array_distinct(parts)) == 4) & ~F.array_contains(parts, ""), parts)
