"""Whole jobs: what earlier versions cut."""

import inspect
import json
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from tallyloom.functions import ranks, rng
from tallyloom.operators import augment as A
from tallyloom.operators import evaluation as E
from tallyloom.operators import neartext
from tallyloom.operators import pipeline as P
from tallyloom.operators import templates as M
from tallyloom.plans import pipeline as plan
from tallyloom.plans import requests as request_plan
from tallyloom.plans import texts as text_plan

Q = "array<struct<name string, type string, instructions string, criteria array<struct<pos int, label string, desc string>>, target array<double>, negated string>>"
RECORDS = f"rec_key long, id string, source string, split string, license string, lang string, grid_id string, cluster string, coco_id long, state_json string, images array<struct<path string, url string>>, questions {Q}, loaded_at timestamp"


def records(spark, rows):
    names = [c.split()[0] for c in RECORDS.split(", ")][:11] + ["questions", "loaded_at"]
    base = {"source": "s", "split": "train", "license": "commercial-ok", "lang": "en"}
    return spark.createDataFrame([tuple((base | {"id": str(r["rec_key"])} | r).get(n) for n in names) for r in rows], RECORDS)


def test_held_out_passes_are_reasons(spark, monkeypatch):
    text = "The delivery came three days late and the box was open, but the support team replaced every broken cup."
    rows = [
        {"rec_key": 1, "split": "test", "state_json": json.dumps({"a": text, "n": 1}), "coco_id": 77},
        {"rec_key": 2, "state_json": '{ "n":1,"a" : ' + json.dumps(text) + "}"},
        {"rec_key": 3, "state_json": json.dumps(text.replace("three", "four"))},
        {"rec_key": 4, "state_json": '"quite another text"', "coco_id": 77},
        {"rec_key": 5, "state_json": '"a text of its own"', "grid_id": "g/1"},
        {"rec_key": 6, "state_json": '"one more, with a picture"'},
        {"rec_key": 7, "state_json": '"quite another text again"', "grid_id": "g/1", "coco_id": 77},
    ]
    r = records(spark, rows)
    images = spark.createDataFrame([(77, "f", 4)], "image_id long, file_name string, license_id int")
    hashes, held = spark.createDataFrame([(5, 12345 << 20), (6, 0b1011)], "rec_key long, h long"), spark.createDataFrame([(0b1000,)], "h long")
    tiers = spark.createDataFrame([("s", "commercial-ok")], "source string, tier string")
    hits = P.held_out_hits(r, hashes, held)
    got = P.drop_reasons(r, tiers, images, (), (), hits)
    assert {x.rec_key: x.reason for x in got.collect()} == {1: None, 2: "held out text", 3: "held out text", 4: "held out id", 5: None, 6: "held out image", 7: "held out id"}
    m = P.manifest(got).first()
    assert (m.raw, m.kept, m.held_out_image_drops, m.held_out_text_drops, m.held_out_id_drops) == (7, 2, 1, 2, 2)
    monkeypatch.setattr(plan, "table", lambda s, d, name: {"records": r, "license_tiers": tiers, "coco_licenses": images}[name])
    assert {x.reason: x.n for x in plan.drop_attribution(spark, "").collect()} == {"kept": 3, "held out text": 2, "held out id": 2}
    assert [x.records for x in plan.grid_groups(spark, "").collect()] == [1]  # only kept rows


def test_tiers_and_image_licences(spark):
    rows = [{"rec_key": k, "source": x, "state_json": '"x"'} for k, x in enumerate("abcde")] + [{"rec_key": 9, "source": "a", "state_json": '"x"', "coco_id": c} for c in (None,)]
    tiers = spark.createDataFrame([("a ", "copyleft"), ("b", None), ("c", "commercial-ok"), ("d", "odd")], "source string, tier string")
    got = {x.source: x.tier_license for x in P.tiered(records(spark, rows), tiers).collect()}
    assert got == {"a": "non-commercial", "b": "unknown", "c": "commercial-ok", "d": "unknown", "e": "unknown"}
    pictured = records(spark, [{"rec_key": c, "state_json": '"x"', "coco_id": c, "images": [("dir/f.jpg", None)]} for c in (1, 2, 3, 4)])
    licences = spark.createDataFrame([(1, "x", 4), (1, "x", 4), (None, "2", 5), (7, "f.jpg", 6), (4, None, None)], "image_id long, file_name string, license_id int")
    assert {x.coco_id: x.image_license for x in P.image_licensed(pictured, licences).collect()} == {1: 4, 2: 5, 3: None, 4: None}


def test_image_numbers_of_held_out_and_other_paths(spark):
    paths = ["a/COCO_val2014_000000000077.jpg", "a/COCO_train2014_000000000078.jpg", "a/train2017/00079.jpg", "a/val2017/80.jpg", "a/val2018/81.jpg", "a/82.jpg"]
    r = records(spark, [{"rec_key": k, "images": [(p, None)], "state_json": '"x"'} for k, p in enumerate(paths)] + [{"rec_key": 10, "images": [(None, "h/COCO_test2015_5.jpg"), (None, None)], "coco_id": 6}, {"rec_key": 11}])
    found = lambda held: {(x.rec_key, x.number) for x in P.numbers_shown(r, held).collect()}
    assert found(False) == {(0, 77), (1, 78), (2, 79), (3, 80), (10, 5), (10, 6)} and found(True) == {(0, 77), (10, 6)}


def test_near_texts_equal_brute_force(spark):
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    held = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(80)] + ["a", "ab", "", None]
    mine = ["a", "b", "ab", "", None, held[0], held[0]]
    for t in held[:80]:
        w = t.split()
        for _ in range(rnd.randrange(0, 8)):
            w[rnd.randrange(len(w))] = word()
        mine.append(" ".join(w))
    cut = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))}
    want = {a for a in mine if a and any(b and len(cut(a) & cut(b)) >= 0.8 * len(cut(a) | cut(b)) for b in held)}
    frame = lambda x: spark.createDataFrame([(t, "e") for t in x], "text string, tkey string")
    got = [x.text for x in neartext.near(frame(mine), frame(held)).collect()]
    assert len(got) == len(want) > 20 and set(got) == want
    assert neartext.near(frame(mine).limit(0), frame(held)).count() == neartext.near(frame(mine), frame(held).limit(0)).count() == 0


def test_grid_records_hold_one_state(spark):
    q = lambda n: [(f"q{i}", "choice", "?", [(0, "A", "a"), (1, "B", "b"), (2, "C", "c")], [0.2, 0.5, 0.3], None) for i in range(n)]
    rows = [{"rec_key": k, "grid_id": "s/1" if k % 2 else "g", "state_json": ['{"a": "\u00e9", "b": 1}', '{"b": 1, "a": "é"}', '"other"'][k % 3], "questions": q(30)} for k in range(12)]
    rows += [{"rec_key": 50, "grid_id": " ", "state_json": "[]", "questions": q(1)}]
    r = records(spark, rows)
    groups = P.grid_groups(r).collect()
    assert sorted((x.grid_id, x.variant, x.records) for x in groups) == [("g", 0, 4), ("g", 1, 2), ("s/1", 0, 4), ("s/1", 1, 2)]
    c = P.chunked(r).collect()
    assert sum(x.derived == "" for x in c) == 360 and len({(x.rec_key, x.name, x.derived) for x in c}) == len(c) > 500
    state = {x["rec_key"]: x["state_json"].startswith("{") for x in rows}
    chunks = {}
    for x in c:
        chunks.setdefault((x.grid_id, x.state_key, x.chunk), []).append(x)
    assert all(len({state[x.rec_key] for x in v}) == 1 and sorted(int(x.new_name[1:]) for x in v) == list(range(1, len(v) + 1)) and len(v) <= 16 for v in chunks.values())
    g = {x.id: x for x in P.grid_records(r).collect()}
    assert len(g) == len(chunks) and {i.split(".")[0] for i in g} == {"s/g#0", "s/g#1", "s/1#0", "s/1#1"} and sum(x.questions for x in g.values()) == len(c)


def test_quality_lengths_are_the_defined_ranks(spark):
    rows = [{"rec_key": k, "state_json": json.dumps("x" * n)} for k, n in enumerate([1, 2, 5, 8, 8, 30])] + [{"rec_key": 90, "source": "t", "state_json": None}]
    got = {x.source: (x.median_chars, x.p95_chars, x.invalid) for x in P.quality(records(spark, rows)).collect()}
    assert got == {"s": (6, 8, 6), "t": (None, None, 1)}


def test_replicates_are_whole():
    assert [inspect.signature(f).parameters["reps"].default for f in (E.gate, E.ece_interval, E.noise_floor)] == [4000, 1000, 200]


def test_gate_resamples_clusters(spark):
    pairs = spark.createDataFrame([(k, f"q{j}") for k in range(100) for j in (1, 2)], "rec_key long, qname string")
    units = lambda cluster: {x.cluster for x in E.clustered(pairs, spark.createDataFrame([(k, cluster(k)) for k in range(100)], "rec_key long, cluster string")).collect()}
    assert units(lambda k: f"g{k % 25}" if k < 90 else " - ") == {f"c/g{k}" for k in range(25)} | {f"r/{k}" for k in range(90, 100)}
    assert len(units(lambda k: f"g{k % 5}")) == 200 and len(units(lambda k: None)) == 200  # too few, none
    # one large group of 60 records moves together: bounds by group are wider than by record
    rows = [(k, "q", k % 2 if k >= 60 else 1, 0, 0.1, 0.1, "g" if k < 60 else None) for k in range(120)]
    p = spark.createDataFrame(rows, "rec_key long, qname string, a_correct int, b_correct int, a_brier double, b_brier double, cluster string")
    by_record, by_group = E.gate(p.drop("cluster"), 300).first(), E.gate(E.clustered(p.drop("cluster"), p.select("rec_key", "cluster")), 300).first()
    assert by_group.acc_hi - by_group.acc_lo > 1.2 * (by_record.acc_hi - by_record.acc_lo)


def test_draws_are_uniform_and_weights_poisson(spark):
    import math

    w = [x.w for x in rng.replicates(spark.range(300).withColumn("k", F.lit("x")), 100, 3, ["id", "k"], 4).select(rng.poisson_weight(F.col("draw")).alias("w")).collect()]
    assert len(w) == 30_000 and all(abs(w.count(k) / 30_000 - math.exp(-1) / math.factorial(k)) < 0.012 for k in range(5))
    reps = rng.replicates(spark.range(3), 17, 0, ["id"], 8).collect()
    assert sorted((x.id, x.rep) for x in reps) == [(i, r) for i in range(3) for r in range(17)] and len({x.draw for x in reps}) == 51


def test_flip_pairs_by_role(spark):
    yes, no = [0.8, 0.2], [0.5, 0.5]
    asked = lambda t, name="q1", kind="noul": [(name, kind, "?", None, t, None)]
    rows = [(1, "a", "tone", asked(yes)), (2, "a", "tone", asked(no)), (3, "b", None, asked(no)), (4, "b", None, asked(yes)), (5, "c", "all", asked(yes)), (6, "c", "all", asked(no)),
            (7, "d", "tone", asked(yes)), (8, "d", "tone", asked(yes)), (9, "e", "tone", asked(yes, "q2")), (10, "e", "tone", asked(no, "q2")), (11, None, "tone", asked(no))]
    rec = spark.createDataFrame(rows + rows[:2], f"rec_key long, flip_group string, flip_kind string, questions {Q}")
    answers = spark.createDataFrame([(k, "q1", "m", [p, 1 - p]) for k, p in ((1, 0.9), (2, 0.6), (3, 0.7), (4, 0.5), (5, 0.4), (6, 0.1), (7, 0.9), (8, 0.9))], "rec_key long, qname string, model string, pred array<double>")
    got = {x.kind: (x.n, x.margin, x.ordered, x.both_hi, x.both_lo) for x in E.flip_probe(answers, rec).collect()}
    assert got == {"tone": (1, 0.3, 1.0, 1.0, 0.0), "all": (3, 0.133333, 0.666667, 0.333333, 0.333333)}


def test_quantiles_equal_numpy(spark):
    import random

    import numpy as np

    rnd = random.Random(1)
    rows = [("a", rnd.choice([5.0, -3.5, 0.0, 1e6, rnd.random()])) for _ in range(500)] + [("b", 2.0), ("c", None), (None, 1.0), (None, 4.0)] + [("d", 7.0)] * 50
    got = {x.k: (x.p50, x.p95) for x in ranks.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", p50=0.5, p95=0.95).collect()}
    want = {k: tuple(round(float(np.quantile([v for g, v in rows if g == k], q)), 6) for q in (0.5, 0.95)) for k in ("a", "b", "d", None)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_long_states_have_all_their_units(spark):
    docs = [(k, f'"word{k}" ' * 5, "en") for k in range(300)] + [(1000 + k, chr(0x4E00 + k) * 30, "en") for k in range(50)] + [(2000, " ", "en")]
    docs = spark.createDataFrame(docs + docs[:5] + [(None, "lost", "en"), (3000, None, "en")], "doc_id long, text string, lang string")
    rows = [{"rec_key": k, "state_json": '"body"' if k % 2 else '"正文"', "lang": "fr" if k % 3 else "zh"} for k in range(60)]
    got = A.lengthened(records(spark, rows), docs, p=1.1).collect()
    assert len(got) == 60
    seen = set()
    for x in got:
        state = json.loads(x.state_json)
        extra, body = (state.split("\n\n")) if x.front else (state.split("\n\n"))[::-1]
        found = extra.split(" ") if x.rec_key % 2 else list(extra)
        assert body == ("body" if x.rec_key % 2 else "正文") and 200 <= x.want <= 800 and len(found) == x.want
        assert all(w.startswith('"word') if x.rec_key % 2 else w >= "一" for w in found)
        seen |= set(found)
    assert sum(w.startswith('"word') for w in seen) > 250  # of 300, no slots


def test_texts_join_any_state(spark):
    for state, front, want in [
        ('"a"', True, "T\n\na"), ('["a", {"b": 1}]', False, ["a", {"b": 1}, "T"]), ('{"n": 1, "x": "y", "context": "c"}', False, {"n": 1, "x": "y", "context": "c\n\nT"}), ('{"n": 1, "x": "y"}', True, {"n": 1, "x": "T\n\ny"}),
        ('{"text": 1}', True, {"_text": "T", "text": 1}), ('{"a": []}', False, {"a": [], "text": "T"}), ("7", False, {"value": 7, "text": "T"}), ("{cut", True, "{cut"),
    ]:
        got = A.with_text(state, "T", front)
        assert (json.loads(got) if got != "{cut" else got) == want
    rows = records(spark, [{"rec_key": k, "state_json": x} for k, x in enumerate(['"a"', '{"k": {"m": []}}', "[1]", None])])
    got = {x.rec_key: (x.line, json.loads(x.state_json)) for x in A.appended(rows, ["L1", "L2"], 1.1).collect()}
    assert set(got) == {0, 1, 2} and got[0][1] == f"a\n\n{got[0][0]}" and got[1][1] == {"k": {"m": []}, "text": got[1][0]} and got[2][1] == [1, got[2][0]]


def test_templates_with_all_labels(spark):
    labels = [f"Intent {i:03d}" for i in range(150)] + ["oos"]
    rows = spark.createDataFrame([(i, "some text", "other", float(i)) for i in (0, 3, 150, 151)] + [(900, " ", "o", 1.0), (901, "t", "o", None)], "key long, text string, other string, label double")
    got = {x.key: x for x in M.apply(rows, "assistant_intent", labels).collect()}
    assert len(got[0].options) == 151 and got[0].options[0] == "intent_000" and got[150].options[150] == "out_of_scope" and got[150].target[150] == 1.0 and sum(got[3].target) == 1.0
    assert {k: got[k].skip for k in (151, 900, 901)} == {151: "unknown label", 900: "no text", 901: "no label"}
    about = M.besides(rows, "news_topic").collect()
    assert [x.key for x in about].count(0) == 2 and all(x.yes in (0.0, 1.0) for x in about) and len({x.instructions for x in about if x.key == 3}) == 2
    assert {x.key: x.yes for x in M.besides(rows, "shop_stars").collect()} == {0: 0.0, 3: 1.0} and M.besides(rows, "film_review").count() == 0
    with pytest.raises(ValueError):
        M.options_of("bank_intent", ["a b", "A_B"])


def test_texts_are_treated_to_their_end(spark, monkeypatch):
    text = "é" * 100 + "<|end|> and <|a b|>"
    docs = spark.createDataFrame([(1, text), (3, text), (5, None)], "doc_id long, text string")
    for m in (request_plan, text_plan):
        monkeypatch.setattr(m, "table", lambda s, d, name: docs)
    assert {x.doc_id: x.safe for x in request_plan.sanitize(spark, "").collect()} == dict.fromkeys((1, 3), "é" * 100 + "<¦end¦> and <¦a b¦>")
    assert {x.doc_id: (x.mime, x.bytes) for x in text_plan.data_urls(spark, "").collect()} == {1: ("image/png", len(text.encode())), 3: (None, None)}


def test_record_text_has_every_record(spark, monkeypatch):
    asked = [("q", "noul", "Is it  SO?", None, None, None), ("r", "noul", None, None, None, None)]
    states = ['"A\\nb"', '{"b": ["X", 5, {"image": {"path": "p.png"}}], "a": "y"}', "[]", "{cut", None, "7"]
    monkeypatch.setattr(text_plan, "once", lambda s, d: records(spark, [{"rec_key": k, "state_json": x, "questions": asked if k != 5 else None} for k, x in enumerate(states)]))
    got = {x.rec_key: x.text for x in text_plan.record_text(spark, "").collect()}
    assert got == {0: "a b is it so?", 1: "x y is it so?", 2: "is it so?", 3: "{cut is it so?", 4: "is it so?", 5: ""}


def test_repeated_questions_need_the_same_text_and_images(spark):
    asked, long = [("q", "noul", "Is it so?", None, None, None)], "x" * 230
    rows = [
        {"state_json": json.dumps({"k": long})}, {"state_json": '{"k":  ' + json.dumps(long) + "}"},  # a repeat in another spacing
        {"state_json": json.dumps({"k": long}), "images": [("a.png", None)]}, {"state_json": json.dumps({"k": long}), "images": [("b.png", None)]},
        {"state_json": json.dumps({"k" * 250: "one"})}, {"state_json": json.dumps({"k" * 250: "two"})},  # long names, other texts
    ]
    got = P.duplicate_questions(records(spark, [r | {"rec_key": k, "questions": asked} for k, r in enumerate(rows)]))
    assert [x.repeats for x in got.collect()] == [1]
