"""Model answers against records: accuracy, calibration, ranking, stability and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rng
from tallyloom.functions import vectors as V
from tallyloom.functions.ranks import quantiles
from tallyloom.operators.pipeline import blank

BINS = 10


def once(answers: DataFrame) -> DataFrame:
    """Each answer once, whatever the number of loads."""
    w = Window.partitionBy("answer_id").orderBy(F.col("answered_at").asc_nulls_last(), F.col("rec_key").asc_nulls_last())
    return answers.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scored(answers: DataFrame, records: DataFrame) -> DataFrame:
    """Successful answers to known records, with their per-row measures."""
    known = once(answers).where("status = 200 and pred is not null and target is not null")
    known = known.join(records.select("rec_key").distinct(), "rec_key", "left_semi")
    pred, target = F.col("pred"), F.col("target")
    return known.withColumns(
        {
            "correct": (V.argmax(pred) == V.argmax(target)).cast("int"),
            "brier": V.brier(pred, target),
            "nll": V.nll(pred, target),
            "conf": V.confidence(pred, F.col("qtype")),
            "top": F.array_max(pred),
        }
    )


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, accuracy, Brier, negative log likelihood and mean confidence."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), mean("correct").alias("accuracy"), mean("brier").alias("brier"), mean("nll").alias("nll"), mean("conf").alias("confidence")
    )


def bin_of(c: Column) -> Column:
    """Ten equal bins; the ends are held inside."""
    return F.least(F.greatest(F.floor(c * BINS).cast("int"), F.lit(0)), F.lit(BINS - 1))


def reliability(rows: DataFrame, spark, conf: str = "conf") -> DataFrame:
    """Count, accuracy and confidence of every bin of each model, empty bins too."""
    cells = rows.groupBy("model", bin_of(F.col(conf)).alias("bin")).agg(F.count("*").alias("n"), F.avg("correct").alias("acc"), F.avg(conf).alias("c"))
    every = rows.select("model").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))))
    return every.join(cells, ["model", "bin"], "left").select(
        "model", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("acc", 6).alias("accuracy"), F.round("c", 6).alias("confidence")
    )


def ece(rows: DataFrame, conf: str, name: str) -> DataFrame:
    """Expected calibration error of each model."""
    cells = rows.groupBy("model", bin_of(F.col(conf)).alias("bin")).agg(F.count("*").alias("n"), F.sum("correct").alias("k"), F.sum(conf).alias("c"))
    return cells.groupBy("model").agg(F.round(F.sum(F.abs(F.col("k") - F.col("c"))) / F.sum("n"), 6).alias(name))


def coverage(rows: DataFrame) -> DataFrame:
    """Share and accuracy of answers at or above each threshold 0.50 ... 0.99.

    Answers are counted by the highest threshold they reach, then summed from above, so no row is repeated.
    """
    step = F.least(F.floor(F.round(F.col("conf") * 100, 9)).cast("int"), F.lit(99))
    cells = rows.groupBy("model", step.alias("step")).agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    every = rows.select("model").distinct().withColumn("step", F.explode(F.sequence(F.lit(50), F.lit(99))))
    low = cells.where("step >= 50").unionByName(every.select("model", "step", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k")))
    grid = low.groupBy("model", "step").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    above = Window.partitionBy("model").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    total = cells.groupBy("model").agg(F.sum("n").alias("all"))
    summed = grid.select("model", "step", F.sum("n").over(above).alias("n"), F.sum("k").over(above).alias("k")).join(total, "model")
    return summed.select("model", (F.col("step") / 100.0).alias("threshold"), F.round(F.col("n") / F.col("all"), 6).alias("coverage"), F.round(F.try_divide("k", "n"), 6).alias("accuracy"))


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC of yes/no answers with a decided target; ties share their rank.

    Answers are first counted by score, so ranks are summed over distinct scores; slices of the scores give the offsets.
    """
    yes = rows.where("qtype = 'noul'").select("model", F.round(F.element_at("pred", 1), 9).alias("score"), (F.element_at("target", 1) >= 0.5).cast("int").alias("y"))
    cells = yes.groupBy("model", "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).withColumn("slice", F.floor(F.col("score") * 4096))
    slices = cells.groupBy("model", "slice").agg(F.sum("n").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("model").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    below = Window.partitionBy("model", "slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))).join(slices.select("model", "slice", F.coalesce(upto, F.lit(0)).alias("before")), ["model", "slice"])
    ranked = placed.withColumn("rank", F.col("before") + F.col("below") + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy("model").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select("model", p.alias("positives"), q.alias("negatives"), F.round(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2.0) / (p * q)), 6).alias("auroc"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """F1 averaged over the classes of each question type that occur in targets or predictions, and over all of them."""
    pairs = rows.select("model", "qtype", F.element_at("labels", V.argmax(F.col("target")) + 1).alias("y"), F.element_at("labels", V.argmax(F.col("pred")) + 1).alias("p"))
    cells = pairs.groupBy("model", "qtype", "y", "p").agg(F.count("*").alias("n"))
    parts = cells.select("model", "qtype", F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("f")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("f")))).alias("x"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    by = parts.groupBy("model", "qtype", "x.c").agg(F.sum("x.t").alias("t"), F.sum("x.f").alias("f"), (F.sum("hit") / 2).alias("tp"))
    f1 = F.when(F.col("t") + F.col("f") > 0, 2 * F.col("tp") / (F.col("t") + F.col("f"))).otherwise(0.0)
    mean = (F.count("*").alias("classes"), F.round(F.avg(f1), 6).alias("macro_f1"))
    return by.groupBy("model", "qtype").agg(*mean).unionByName(by.groupBy("model", F.lit("all").alias("qtype")).agg(*mean))


def stability(rows: DataFrame) -> DataFrame:
    """Flips and largest change under reversed options, and the gap of negated questions."""
    order = F.col("qtype").isin("choice", "score") & F.col("pred_reversed").isNotNull()
    turned = F.when(order, (V.argmax(F.col("pred")) != V.argmax(F.col("pred_reversed"))).cast("int"))
    gap = F.when((F.col("qtype") == "noul") & F.col("pred_negated").isNotNull(), F.abs(F.element_at("pred", 1) + F.col("pred_negated") - 1))
    return rows.groupBy("model").agg(
        F.count(turned).alias("order_pairs"),
        F.round(F.avg(turned), 6).alias("order_flip_rate"),
        F.round(F.max(V.max_gap(F.col("pred"), F.col("pred_reversed"))), 6).alias("order_max_change"),
        F.count(gap).alias("negated"),
        F.round(F.avg(gap), 6).alias("negation_gap"),
    )


def latency(answers: DataFrame) -> DataFrame:
    """Median, 95th percentile (linear between ranks) and mean of each record's first known latency."""
    first = once(answers).groupBy("model", "rec_key").agg(F.min_by("latency_ms", F.when(F.col("latency_ms").isNotNull(), F.struct("answered_at", "answer_id"))).alias("ms"))
    mean = first.groupBy("model").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 6).alias("mean"))
    return mean.join(quantiles(first, ["model"], "ms", p50=0.5, p95=0.95), "model", "left").select("model", "n", "p50", "p95", "mean")


def errors(answers: DataFrame) -> DataFrame:
    """Failed answers by status, with the first five as samples."""
    bad = once(answers).where("status <> 200")
    w = Window.partitionBy("status").orderBy("answer_id")
    first = bad.select("status", "answer_id", F.row_number().over(w).alias("_n")).where("_n <= 5")  # limited before the exchange
    samples = first.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("answer_id")).cast("array<string>"), ",").alias("first_five"))
    return bad.groupBy("status").agg(F.count("*").alias("n")).join(samples, "status").select(F.col("status").cast("string").alias("status"), "n", "first_five")


def confidence_buckets(rows: DataFrame) -> DataFrame:
    """Distinct confidences (12 digits), and how many are 1 and how many of those are wrong."""
    sure = F.col("conf") >= 1 - 1e-9
    return rows.groupBy("model").agg(F.count_distinct(F.bround("conf", 12)).alias("distinct_conf"), F.count_if(sure).alias("sure"), F.count_if(sure & (F.col("correct") == 0)).alias("sure_wrong"))


def skill(rows: DataFrame) -> DataFrame:
    """Accuracy above chance, scaled so that chance is 0; by source, then averaged with weights."""
    by = rows.groupBy("model", "source").agg(F.count("*").alias("n"), F.avg("correct").alias("acc"), F.avg(1.0 / F.size("labels")).alias("chance"))
    s = (F.col("acc") - F.col("chance")) / (1 - F.col("chance"))
    return by.groupBy("model").agg(F.count("*").alias("sources"), F.round(F.avg(s), 6).alias("skill"), F.round(F.sum(s * F.col("n")) / F.sum("n"), 6).alias("weighted_skill"))


def meter(rows: DataFrame) -> DataFrame:
    """Training meter: means by type and overall; yes/no counts as yes only above one half."""
    yes = lambda v: F.element_at(v, 1) > 0.5
    right = F.when(F.col("qtype") == "noul", yes(F.col("pred")) == yes(F.col("target"))).otherwise(V.argmax(F.col("pred")) == V.argmax(F.col("target"))).cast("int")
    return rows.withColumn("right", right).rollup("qtype").agg(
        F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"), F.round(F.avg("brier"), 6).alias("brier"), F.round(F.avg("nll"), 6).alias("nll"), F.grouping("qtype").alias("_all")
    ).select(F.when(F.col("_all") == 1, "all").otherwise(F.col("qtype")).alias("qtype"), "n", "accuracy", "brier", "nll")


def row_loss(rows: DataFrame) -> DataFrame:
    """Cross entropy, a tenth of the Brier sum, and for scores a twentieth of the squared scaled gap of means."""
    k = F.greatest(F.size("target") - 1, F.lit(1))
    gap = F.when(F.col("qtype") == "score", F.pow((V.expectation(F.col("pred")) - V.expectation(F.col("target"))) / k, 2)).otherwise(0.0)
    loss = F.col("nll") + 0.1 * F.col("brier") + 0.05 * gap
    return rows.groupBy("model", "qtype").agg(F.round(F.avg(loss), 6).alias("loss"), F.round(F.max(loss), 6).alias("worst"))


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Answers of two models to the same questions."""
    side = lambda m, p: rows.where(F.col("model") == m).select("rec_key", "qname", *(F.col(c).alias(f"{p}_{c}") for c in ("correct", "brier", "pred", "source")))
    return side(a, "a").join(side(b, "b"), ["rec_key", "qname"])


def divergence(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mean divergence between the answer distributions of two models, by source."""
    return paired(rows, a, b).groupBy(F.col("a_source").alias("source")).agg(F.count("*").alias("n"), F.round(F.avg(V.kl(F.col("a_pred"), F.col("b_pred"))), 6).alias("kl"))


def gate_samples(clusters: DataFrame, reps: int = 4000, seed: int = 0) -> DataFrame:
    """Bootstrap replicates of the difference between two groups of rows in each cluster.

    Differences are first added up by cluster; each cluster enters a replicate with a Poisson(1) weight that is a hash
    of replicate and cluster, so replicates need no resampling pass and add up before the exchange.
    """
    sums = clusters.groupBy("cluster").agg(F.sum("d_acc").alias("d"), F.sum("d_brier").alias("e"), F.count("*").alias("m"))
    # few bytes make much work here, so the sums are spread over all cores
    sums = sums.repartition(sums.sparkSession.sparkContext.defaultParallelism, "cluster")
    each = rng.replicates(sums, reps, seed, ["cluster"], 4)
    return each.withColumn("w", rng.poisson_weight(F.col("draw"))).groupBy("rep").agg(
        F.round(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum(F.col("w") * F.col("m"))), 9).alias("d_acc"),
        F.round(F.try_divide(F.sum(F.col("w") * F.col("e")), F.sum(F.col("w") * F.col("m"))), 9).alias("d_brier"),
    )


def clustered(pairs: DataFrame, records: DataFrame, least: int = 20) -> DataFrame:
    """``cluster``: the unit of resampling. A record without a cluster is its own; single questions if no record of the
    pairs has one or there are fewer than ``least`` units."""
    own = F.when(~blank(F.col("cluster")), F.trim("cluster"))
    known = records.where("rec_key is not null").groupBy("rec_key").agg(F.min(own).alias("own"))
    full = pairs.join(known, "rec_key", "left").withColumn("unit", F.coalesce(F.concat(F.lit("c/"), "own"), F.concat(F.lit("r/"), F.col("rec_key").cast("string"))))
    n = full.agg(F.count("own").alias("named"), F.count_distinct("unit").alias("units"))
    single = F.concat_ws("/", F.lit("q"), F.col("rec_key").cast("string"), F.col("qname"))
    fall = F.when((F.col("named") == 0) | (F.col("units") < least), single).otherwise(F.col("unit"))
    return full.crossJoin(F.broadcast(n)).withColumn("cluster", fall).drop("own", "unit", "named", "units")


def gate(pairs: DataFrame, reps: int = 4000, seed: int = 0) -> DataFrame:
    """Difference of two models on shared questions with order-statistic bounds, and the verdict.

    Resampled are the values of ``cluster`` (see ``clustered``), or records if the pairs have no such column.
    """
    cluster = F.col("cluster" if "cluster" in pairs.columns else "rec_key").cast("string")
    c = pairs.select(cluster.alias("cluster"), (F.col("a_correct") - F.col("b_correct")).alias("d_acc"), (F.col("a_brier") - F.col("b_brier")).alias("d_brier"))
    at = lambda col, i: F.get(F.array_sort(F.collect_list(col)), F.lit(i))
    lo, hi = int(0.025 * reps), int(0.975 * reps) - 1
    bounds = gate_samples(c, reps, seed).agg(at("d_acc", lo).alias("acc_lo"), at("d_acc", hi).alias("acc_hi"), at("d_brier", lo).alias("brier_lo"))
    point = c.agg(F.count("*").alias("n"), F.avg("d_acc").alias("d"), F.avg("d_brier").alias("e"))
    verdict = (
        F.when(F.col("n") == 0, "fail: nothing shared")
        .when((F.col("acc_hi") < 0) | ((F.col("n") >= 600) & (F.col("d") < -0.03)) | (F.col("brier_lo") > 0), "fail")
        .when(F.col("acc_lo") > 0, "better")
        .otherwise("pass")
    )
    return point.join(bounds, F.lit(True)).select(
        "n", F.round("d", 6).alias("delta_accuracy"), F.round("e", 6).alias("delta_brier"), F.round("acc_lo", 6).alias("acc_lo"), F.round("acc_hi", 6).alias("acc_hi"), F.round("brier_lo", 6).alias("brier_lo"), verdict.alias("verdict")
    )


def noise_floor(rows: DataFrame, reps: int = 200, seed: int = 0) -> DataFrame:
    """Calibration error left by chance: labels drawn from the target distributions, the mean over draws."""
    upto = F.filter(F.transform("target", lambda t, i: F.round(V.total(F.slice("target", F.lit(1), i + 1)), 9)), lambda c, i: i < F.size("target") - 1)
    each = rng.replicates(rows.select("model", "answer_id", "top", upto.alias("upto"), V.argmax(F.col("pred")).alias("best")), reps, seed, ["answer_id"], 8)
    each = each.withColumn("u", F.conv("draw", 16, 10).cast("double") / F.lit(float(2**32)))
    drawn = F.size(F.filter("upto", lambda c: F.col("u") >= c))
    cells = each.withColumn("hit", (drawn == F.col("best")).cast("int")).groupBy("model", "rep", bin_of(F.col("top")).alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("k"), F.sum("top").alias("c"))
    per = cells.groupBy("model", "rep").agg((F.sum(F.abs(F.col("k") - F.col("c"))) / F.sum("n")).alias("e"))
    return per.groupBy("model").agg(F.round(F.avg("e"), 6).alias("noise_floor"))


def ece_interval(rows: DataFrame, reps: int = 1000, seed: int = 1) -> DataFrame:
    """2.5 % and 97.5 % points (linear) of the calibration error under resampling of rows."""
    each = rng.replicates(rows.select("model", "answer_id", "correct", "conf"), reps, seed, ["answer_id"], 4)
    cells = each.withColumn("w", rng.poisson_weight(F.col("draw"))).groupBy("model", "rep", bin_of(F.col("conf")).alias("bin")).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("correct")).alias("k"), F.sum(F.col("w") * F.col("conf")).alias("c"))
    per = cells.groupBy("model", "rep").agg(F.try_divide(F.sum(F.abs(F.col("k") - F.col("c"))), F.sum("n")).alias("e"))
    return per.groupBy("model").agg(F.round(F.percentile("e", 0.025), 6).alias("lo"), F.round(F.percentile("e", 0.975), 6).alias("hi"))


def flip_probe(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs of records that differ in one detail: is the answer for the true one higher, by kind and for all.

    Only yes/no questions named q1 take part. The true record of a group has a target above one half, the false one any
    other; of several the last counts, and the last record of the group gives the kind. A group without a kind, or of
    the kind ``all``, is counted once.
    """
    asked = records.where("flip_group is not null and rec_key is not null").select("rec_key", "flip_group", "flip_kind", F.explode("questions").alias("q")).where("q.name = 'q1' and q.type = 'noul'")
    true = F.element_at("q.target", 1) > 0.5
    roles = asked.groupBy("flip_group").agg(
        F.max(F.when(true, F.col("rec_key"))).alias("t"), F.max(F.when(~F.coalesce(true, F.lit(False)), F.col("rec_key"))).alias("f"), F.max_by("flip_kind", "rec_key").alias("kind")
    ).where("t is not null and f is not null")
    answer = rows.where("qname = 'q1'").groupBy("model", "rec_key").agg(F.max(F.element_at("pred", 1)).alias("p"))
    of = lambda c, p: answer.select("model", F.col("rec_key").alias(c), F.col("p").alias(p))
    pairs = roles.join(of("t", "hi"), "t").join(of("f", "lo"), ["f", "model"])
    each = pairs.withColumn("kind", F.explode(F.array_distinct(F.array(F.coalesce("kind", F.lit("all")), F.lit("all")))))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return each.groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("margin"), share(F.col("hi") > F.col("lo")).alias("ordered"),
        share((F.col("hi") > 0.5) & (F.col("lo") > 0.5)).alias("both_hi"), share((F.col("hi") < 0.5) & (F.col("lo") < 0.5)).alias("both_lo"),
    )
