"""Hand-computed cases of the metrics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import evaluation as E

ANSWERS = (
    "answer_id long, rec_key long, source string, qname string, qtype string, model string, labels array<string>, pred array<double>, target array<double>, "
    "pred_reversed array<double>, pred_negated double, confidence double, latency_ms double, status int, answered_at timestamp"
)
T0 = dt.datetime(2030, 1, 1)


def noul(i, p, t, **k):
    row = {"answer_id": i, "rec_key": i, "source": "s", "qname": "q", "qtype": "noul", "model": "m", "labels": ["true", "false"], "pred": None if p is None else [p, 1 - p], "target": [t, 1 - t], "pred_reversed": None, "pred_negated": None, "confidence": None, "latency_ms": 10.0 * i, "status": 200, "answered_at": T0}
    return row | k


def scored(spark, rows):
    a = spark.createDataFrame([tuple(r[c.split()[0]] for c in ANSWERS.split(", ")) for r in rows], ANSWERS)
    return a, E.scored(a, a.select("rec_key"))


def test_hand_computed_yes_no(spark):
    _, r = scored(spark, [noul(1, 0.8, 1.0), noul(2, 0.3, 1.0), noul(3, 0.1, 0.0), noul(4, 0.6, 0.0)])
    s = E.summary(r, "model").first()
    assert s.accuracy == 0.5 and s.brier == pytest.approx(2 * (0.04 + 0.49 + 0.01 + 0.36) / 4, abs=1e-6)
    assert E.ece(r, "conf", "ece").first().ece == pytest.approx(0.4, abs=1e-6)
    assert E.auroc(r).first().auroc == 1.0 - 0.25
    assert E.macro_f1(r).first().macro_f1 == 0.5


@pytest.mark.parametrize(("ps", "ts", "want"), [([0.9, 0.1], [1, 0], 1.0), ([0.1, 0.9], [1, 0], 0.0), ([0.5, 0.5], [1, 0], 0.5), ([0.9, 0.4, 0.4, 0.1], [1, 1, 0, 0], 0.875), ([0.3, 0.2], [1, 1], None)])
def test_auroc_with_ties(spark, ps, ts, want):
    _, r = scored(spark, [noul(i, p, float(t)) for i, (p, t) in enumerate(zip(ps, ts, strict=True))])
    assert E.auroc(r).first().auroc == want


def test_ties_go_to_the_first_option(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.2, 0.4],), ([],)], "v array<double>")
    assert [r.a for r in df.select(V.argmax(F.col("v")).alias("a")).collect()][:2] == [0, 1]


def test_stability_and_gap(spark):
    choice = noul(1, 0.0, 0.0, qtype="choice", labels=["A", "B"], pred=[0.6, 0.4], target=[1.0, 0.0], pred_reversed=[0.4, 0.6])
    same = choice | {"answer_id": 2, "rec_key": 2, "pred_reversed": [0.7, 0.3]}
    _, r = scored(spark, [choice, same, noul(3, 0.7, 1.0, pred_negated=0.4)])
    s = E.stability(r).first()
    assert (s.order_pairs, s.order_flip_rate, s.negated) == (2, 0.5, 1)
    assert s.order_max_change == pytest.approx(0.2) and s.negation_gap == pytest.approx(0.1)


def test_repeats_failures_and_unknown_records(spark):
    rows = [noul(1, 0.8, 1.0), noul(1, 0.8, 1.0), noul(2, None, 1.0, pred=None, status=500), noul(3, 0.9, 1.0)]
    a, _ = scored(spark, rows)
    known = spark.createDataFrame([(1,), (1,), (2,)], "rec_key long")
    assert E.scored(a, known).count() == 1
    assert [(x.status, x.n, x.first_five) for x in E.errors(a).collect()] == [("500", 1, "2")]


def test_empty_input(spark):
    _, r = scored(spark, [])
    assert E.summary(r, "model").count() == 0 and E.coverage(r).count() == 0 and E.reliability(r, spark).count() == 0


def test_a_calibrated_model_meets_the_noise_floor(spark):
    rows = [noul(i, (i % 19 + 1) / 20, (i % 19 + 1) / 20) for i in range(1, 2000)]
    _, r = scored(spark, rows)
    assert E.noise_floor(r, reps=5).first().noise_floor < 0.05


def test_gate_prefers_the_better_model(spark):
    rows = [noul(2 * i, 0.9, 1.0, model="a", rec_key=i) for i in range(200)] + [noul(2 * i + 1, 0.9 if i % 2 else 0.1, 1.0, model="b", rec_key=i) for i in range(200)]
    _, r = scored(spark, rows)
    g = E.gate(E.paired(r, "a", "b")).first()
    assert g.n == 200 and g.delta_accuracy == 0.5 and g.verdict == "better"
    assert E.gate(E.paired(r, "a", "none")).first().verdict == "fail: nothing shared"
