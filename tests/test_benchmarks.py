"""Converters of evaluation collections on small upstream rows."""

import threading

from pyspark.sql import functions as F

from tallyloom.operators import benchmarks as B


def rows(df, *names):
    return {r["key"]: tuple(r[n] for n in names) for r in df.collect()}


def test_expected_answers(spark):
    s = "id string, type string, instructions string, labels array<string>, expected string, licence string"
    one = spark.createDataFrame([("a", "choice", "?", ["x", "y"], "y", "MIT"), ("b", "noul", "?", None, "no", None), ("c", "score", "?", ["0", "1", "2"], "2", "GPL"), ("d", "choice", "?", ["x"], "z", "MIT"), ("e", "score", "?", ["0"], "7", None)], s)
    got = rows(B.expected_answers({"easy": one, "hard": one.where("id = 'zz'")}, {"MIT": "commercial-ok"}), "target", "skip", "license", "tier")
    assert got == {"a": ([0.0, 1.0], None, "commercial-ok", "easy"), "b": ([0.0, 1.0], None, "unknown", "easy"), "c": ([0.0, 0.0, 1.0], None, "unknown", "easy"), "d": (None, "answer_not_in_options", "commercial-ok", "easy"), "e": (None, "answer_not_in_options", "unknown", "easy")}


def test_labelled_questions_and_pairs(spark):
    q = "array<struct<name string, type string, instructions string, labels array<string>, label string, src string>>"
    up = spark.createDataFrame([("r", "repo1", [("q1", "choice", "?", ["x", "y"], "x", "human"), ("q2", "noul", "?", None, "true", "human")]), ("s", "other", [("q1", "noul", "?", None, "maybe", "a"), ("q2", "noul", "?", None, "false", "b")])], f"id string, repo string, questions {q}")
    got = {(r.key, r.qname): (r.target, r.src, r.license, r.skip) for r in B.labelled_questions(up, spark.createDataFrame([("repo1", "commercial-ok")], "repo string, license string")).collect()}
    assert got == {("r", "q1"): ([1.0, 0.0], "human", "commercial-ok", None), ("r", "q2"): ([1.0, 0.0], "human", "commercial-ok", None), ("s", "q1"): (None, None, "unknown", "answer_not_in_options"), ("s", "q2"): ([0.0, 1.0], None, "unknown", None)}
    p = B.counterfactual_pairs(spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None), (5, None)], "id int, pair string"), "id", "pair")
    assert {r.id: r.partner for r in p.collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: None}


def test_lettered_columns(spark):
    up = spark.createDataFrame([(1, "Q ", "hint", "x", "nan", "y", None, "C"), (2, "Q", "nan", "x", "y", "", None, "D"), (1_000_001, "Q", None, "x", "y", "z", "w", "A")], "index long, question string, hint string, A string, B string, C string, D string, answer string")
    got = rows(B.lettered_columns(up, "Pick."), "skip", "labels", "target", "state")
    assert got == {1: (None, ["A", "C"], [0.0, 1.0], "hint\n\nQ"), 2: ("answer_not_in_options", ["A", "B"], None, "Q"), 1_000_001: ("circular_rotation", list("ABCD"), None, "Q")}


def test_packed_options(spark):
    up = spark.createDataFrame([(1, "Which?\nChoices:\n(A) x\n(B) nan\n(C) y", "C"), (2, "Old Options: no. Options: A: a, b, B: c", "A"), (3, "None", "A"), (4, "Q\n(A) x\n(B) nan", "B")], "id int, question string, answer string")
    got = rows(B.packed_options(up, "Pick."), "skip", "state", "texts", "target")
    assert got == {1: (None, "Which?", ["x", "y"], [0.0, 1.0]), 2: (None, "Old Options: no.", ["a, b", "c"], [1.0, 0.0]), 3: ("options_not_parsed", "None", None, None), 4: ("answer_not_in_options", "Q", ["x"], None)}


def test_tagged_images(spark):
    s = "id int, kind string, question string, options array<string>, answer string, files array<string>"
    up = spark.createDataFrame([
        (1, "choice", 'See <img="b.png"> and <img="a.png">', ['<img="b.png">', "x", " "], "B", ["a.png", "b.png", "c.png"]), (2, "judge", "Right?", None, "错", ["a.png"]), (3, "judge", "Right?", None, "?", ["a.png"]),
        (4, "choice", '<img="z.png">', ["x", "y"], "A", ["a.png"]), (5, "choice", "Q", ["x", "y"], "AB", ["a.png"]), (6, "fill", "Q", None, "1", ["a.png"]), (7, "choice", "Q", ["x", "y"], "A", []),
    ], s)
    got = rows(B.tagged_images(up, "Pick.", "True?"), "skip", "state", "order", "target")
    assert got[1] == (None, "See <image 2> and <image 1>", [2, 1, 3], [0.0, 1.0]) and got[2] == (None, "Right?", [1], [0.0, 1.0])
    assert {k: got[k][0] for k in range(3, 8)} == {3: "judge_answer", 4: "img_tag_without_image", 5: "multi_answer", 6: "type", 7: "no_image"}


def test_yes_no_collections(spark):
    up = spark.createDataFrame([(1, "Is there a red bus in the image?", " Yes"), (2, "Is it raining?", "no"), (3, "Is there an owl in the image?", "maybe"), (4, None, None)], "id int, question string, answer string")
    assert rows(B.presence(up), "target", "negated", "skip") == {1: ([1.0, 0.0], "Is there no red bus in the image?", None), 2: ([0.0, 1.0], None, None), 3: (None, "Is there no owl in the image?", "answer_not_yes_no"), 4: (None, None, "answer_not_yes_no")}
    up = spark.createDataFrame([(1, "Q", "1", "a.png"), (2, "Q", "0", "a.png"), (3, "Q", "1", " "), (4, "Q", "x", "a.png")], "id int, question string, answer string, image string")
    assert rows(B.pictured_only(up, "image"), "target", "skip") == {1: ([1.0, 0.0], None), 2: ([0.0, 1.0], None), 3: (None, "text_only"), 4: (None, "answer_not_0_1")}
    up = spark.createDataFrame([(1, 'Say if "cats fly" holds.', "No.", ["dev-1-img0", "dev-1-img1"]), (2, 'A "b"?', "yes", ["x"]), (3, "no quote", "yes", ["x", "y"])], "id int, user string, assistant string, images array<string>")
    assert rows(B.quoted(up, "True?", 2), "skip", "instructions", "target", "pair", "split") == {1: (None, 'True? "cats fly"', [0.0, 1.0], "dev-1", "dev"), 2: ("images", 'True? "b"', None, "x", "train"), 3: ("unparsed", 'True? ""', None, "x", "train")}
    assert rows(B.quoted(up, "True?"), "skip")[2] == (None,)


def test_classes_and_routes(spark):
    up = spark.createDataFrame([(1, "Camera Issues ", "g"), (2, "Physics Errors", None), (3, "Odd", "g"), (4, None, "g")], "id int, kind string, game string")
    got = rows(B.mapped_classes(up, "kind", {"Camera": "camera", "Physics": "physics"}, (" Issues", " Errors"), "Which?"), "skip", "target", "cluster")
    assert got == {1: (None, [1.0, 0.0], "g"), 2: (None, [0.0, 1.0], "N/A"), 3: ("unknown_type", None, "g"), 4: ("unknown_type", None, "g")}
    s = "id string, categories array<string>, truth string, media array<string>, source string, question string"
    up = spark.createDataFrame([
        ("sphere_hall-1", ["Glitch"], '{"seen": true}', ["a"], "v", "Is it?\n Provide your answer as JSON"), ("b", ["Clip", "x"], '{"clip": false}', ["a"], "video", "Q"), ("c", ["Glitch"], '{"seen": true}', ["a", "b"], "Unity 5", "Q"), ("d", ["Clip"], "no json", ["a"], None, "Q"),
    ], s)
    got = rows(B.routed(up, {"glitch": ("Glitch", "seen", 1), "clip": ("Clip", "clip", 1)}), "set", "skip", "target", "cluster", "instructions")
    assert got == {"sphere_hall-1": ("glitch", None, [1.0, 0.0], "hall", "Is it?"), "b": ("clip", None, [0.0, 1.0], "video", "Q"), "c": (None, "no_set", None, "c", "Q"), "d": (None, "no_set", None, "d", "Q")}


def test_chart_options(spark):
    up = [(1, "c1", "t1", "2 by 3"), (2, "c1", "t2", "10"), (3, "c1", "t3", "12"), (4, "c1", "t4", "Yes"), (5, "c2", "t5", "alone"), (6, "c3", "t6", "x"), (7, "c4", "t6", "y"), (8, "c5", "t6", None)]
    got = {r.qid: (r.texts, r.target) for r in B.chart_options(spark.createDataFrame(up, "qid int, chart string, template string, answer string")).collect()}
    own = {k: a for k, _, _, a in up if a}
    assert set(got) == set(own) and all(sum(t) == 1.0 and x[t.index(1.0)] == own[k] and len({y.lower() for y in x}) == len(x) for k, (x, t) in got.items())
    assert {"3 by 2", "3 by 3", "2 by 4"} <= set(got[1][0]) and "12" in got[2][0] and len(got[2][0]) == 4 and set(got[4][0]) == {"Yes", "No", "Not Applicable"}
    assert set(got[5][0]) == {"alone", "Not Applicable"} and set(got[6][0]) == {"x", "y", "Not Applicable"}


def test_a_chart_of_very_many_questions(spark):
    t = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # fails the test
    t.start()
    n = 100_000  # ten to the tenth pairs
    up = spark.range(n).selectExpr("id AS qid", "'c' AS chart", "CAST(id % 7 AS STRING) AS template", "concat('text ', CAST(id % 5 AS STRING)) AS answer")
    got = B.chart_options(up).selectExpr("size(texts) AS k", "aggregate(target, 0D, (a, x) -> a + x) AS p", "array_contains(texts, 'Not Applicable') AS na").groupBy("k", "p", "na").count().collect()
    t.cancel()
    assert [tuple(r) for r in got] == [(4, 1.0, False, n)]


def test_the_driver_holds_no_side_of_questions(spark):
    up = spark.range(500).selectExpr("id AS qid", "CAST(id % 9 AS STRING) AS chart", "CAST(id % 7 AS STRING) AS template", "CASE WHEN id % 2 = 0 THEN CAST(id % 40 AS STRING) ELSE concat('text ', CAST(id % 5 AS STRING)) END AS answer")
    plan = B.chart_options(up)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("FileScan") < 12


def test_written_draws_and_numbers_equal_the_others(spark):
    from tallyloom.operators import openqa as O
    from tallyloom.workspace import Workspace

    q = spark.range(400).selectExpr("id AS qid", "CAST(id % 9 AS STRING) AS pool", "CASE WHEN id % 9 = 0 THEN 'x' WHEN id % 3 = 0 THEN concat(id % 40, '.5%') ELSE CAST(id % 13 AS STRING) END AS answer", "CAST(id % 4 AS STRING) AS t", "'?' AS question")
    ws = Workspace(spark)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 300
    assert same(O.changed_numbers(q, 4), O.changed_numbers(q, 4, ws)) and same(O.pool_draws(q, q, 3, "s", "t"), O.pool_draws(q, q, 3, "s", "t", ws))
