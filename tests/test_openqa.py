"""Open questions made into choices, and options read from texts."""

import collections

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import options as G
from tallyloom.functions import text as T
from tallyloom.operators import openqa as O

NUMBERS = ["1", "0", "2", "3", "7", "0.0", "12%", "1,250", "007", "1e+3", "2.50e-4", "-3", "-0.75", "1999", "1850", "12.1234567", "100000"]


def test_three_other_values_for_every_number(spark):
    rows = [(i, "In which year?" if a in ("1999", "1850") else "How many?", a) for i, a in enumerate(NUMBERS)] + [(90, "?", "text"), (91, "?", None), (92, None, "5")]
    got = collections.defaultdict(list)
    for r in O.changed_numbers(spark.createDataFrame(rows, "qid long, question string, answer string")).collect():
        got[r.qid].append((r.place, r.text))
    assert set(got) == set(range(len(NUMBERS))) | {92}
    back = {r.t: (r.v, r.n) for r in spark.createDataFrame([(x,) for v in got.values() for _, x in v] + [(a,) for a in NUMBERS], "t string").distinct().select("t", T.number(F.col("t")).alias("v"), T.notation(F.col("t")).alias("n")).collect()}
    for i, a in enumerate(NUMBERS):
        texts = [x for _, x in sorted(got[i])]
        assert [p for p, _ in sorted(got[i])] == [1, 2, 3] and len({*texts, a}) == 4, (a, texts)
        v = back[a][0]
        for x in texts:
            w = back[x][0]
            assert back[x][1] == back[a][1] and (w >= 0) == (v >= 0 or w >= 0), (a, x)
            if a in ("1999", "1850"):
                assert 1 <= abs(w - v) <= 10
            elif v and abs(v) >= 10:
                assert 0.1 * abs(v) - 0.51 <= abs(w - v) <= 0.5 * abs(v) + 0.51, (a, x)
    assert all(len(x) == 3 and x.isdigit() for _, x in got[NUMBERS.index("007")]) and all("e-" in x and len(x.split("e")[0]) == 4 for _, x in got[NUMBERS.index("2.50e-4")])


def test_draws_come_from_the_whole_pool_by_weight(spark):
    answers = [f"a{i:03d}" for i in range(120)] * 4 + ["heavy"] * 120
    rows = [(k, "p", a) for k, a in enumerate(answers)] + [(1000 + k, "tiny", a) for k, a in enumerate(["x"] * 60 + ["y", "Y", "z"])]
    q = spark.createDataFrame(rows, "qid long, pool string, answer string")
    by = collections.defaultdict(list)
    for x in O.pool_draws(q, q).collect():
        by[x.qid].append(x)
    own = dict(enumerate(answers))
    assert all(sorted(x.place for x in by[k]) == [1, 2, 3] and len({x.text for x in by[k]} - {own[k]}) == 3 for k in own)
    assert {x.text for k in own for x in by[k]} == set(answers)
    others = [k for k in own if own[k] != "heavy"]
    assert 0.14 < sum(x.place == 1 and x.text == "heavy" for k in others for x in by[k]) / len(others) < 0.26  # a fifth of the weight
    assert all({x.text.lower() for x in by[1000 + k]} == {"x", "y", "z"} - {a.lower()} for k, a in enumerate(["x"] * 60 + ["y", "Y", "z"]))


def test_cascade_of_distractors(spark):
    rows = [(1, "img", "What sport is shown?", "Tennis"), (2, "img", "What sport is next?", "golf"), (3, "img", "Is it?", "Yes."), (4, "img", "What color is it?", "Red"), (5, "img", "How many?", "10"),
            (6, "img", "How many cats?", "12"), (7, "img", "How many dogs?", "90"), (8, "img", "How many in all?", "11.5"), (9, None, "Why?", "alone"), (10, None, "?", None), (11, None, None, " ")]
    rows += [(100 + i, f"i{i}", "What sport is shown?", x) for i, x in enumerate(["golf", "chess", "rugby", "tennis"])]
    got = collections.defaultdict(list)
    for r in sorted(O.distractors(spark.createDataFrame(rows, "qid long, image string, question string, answer string")).collect()):
        got[r.qid].append((r.text, r.origin))
    assert got[1][0] == ("golf", "same_image") and all(o == "pool:what sport is" for _, o in got[1][1:]) and {t for t, _ in got[1]} <= {"golf", "chess", "rugby"}
    assert [o for _, o in got[4]] == ["color_list"] * 3 and all(t[0].isupper() for t, _ in got[4])
    assert got[5][0] == ("12", "same_image") and [o for _, o in got[5][1:]] == ["perturb"] * 2 and [o for _, o in got[8]] == ["perturb"] * 3
    assert len(got[9]) == 3 and 10 not in got and 11 not in got and all(len({t.lower() for t, _ in v}) == 3 for v in got.values())
    assert O.distractors(spark.createDataFrame([], "qid long, image string, question string, answer string")).count() == 0


@pytest.mark.parametrize(("parse", "text", "want"), [
    (G.trailing_lines, "Q\nB. no\n A．yes", "A=yes|B=no"), (G.trailing_lines, "A. x\nQ\nA. only", None), (G.trailing_lines, "Q\nA. x\nC. y", None), (G.trailing_lines, "", None),
    (G.listed, "Q Options: old? Options: A: x, y, B: z", "A=x, y|B=z"), (G.listed, "Options: B: x", None), (G.listed, "A: x, B: y", None), (G.listed, "Options: A: a, C: c, B: b", "A=a, C: c|B=b"),
    (G.inline, "See A. and B. first A. a B、 b C．c D. d", "A=a|B=b|C=c|D=d"), (G.inline, "A. a B. b C. c D. d E. e", "A=a|B=b|C=c|D=d|E=e"), (G.inline, "A. a B. b C. D. d", None), (G.inline, "none", None),
    (G.option_tail, "Where?\nOption: A:To the right; B:To the left;", "A=To the right|B=To the left"), (G.option_tail, "Option: A:x; B:;", None), (G.option_tail, "Where?", None),
    (G.bracketed, "Q\n(A) x\n(B) nan\n(C)y", "A=x|C=y"), (G.bracketed, "(A) x", None), (G.bracketed, None, None),
])
def test_options_in_texts(spark, parse, text, want):
    c = F.array_join(F.transform(parse(F.col("t")), lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|")
    assert spark.createDataFrame([(text,)], "t string").select(c.alias("o")).first().o == want


def test_answered_option(spark):
    o = [("A", "x"), ("B", "y")]
    rows = [(o, "B"), (o, "(b)"), (o, "a."), (o, "AB"), (o, "C"), (o, ""), (None, "A")]
    at, why = G.chosen(F.col("o"), F.col("a"))
    got = spark.createDataFrame(rows, "o array<struct<label string, text string>>, a string").select(at.alias("at"), why.alias("why")).collect()
    assert [(r["at"], r.why) for r in got] == [(1, None), (1, None), (0, None), (None, "multi_answer"), (None, "answer_not_in_options"), (None, "answer_not_in_options"), (None, "options_not_parsed")]


def test_greedy_in_order_equals_brute_force(spark):
    import random

    from tallyloom.operators import checks as K

    rnd = random.Random(3)
    rows = []
    for i in range(300):
        base = rnd.choice(rows)[2] if rows and i % 3 else rnd.getrandbits(64) - 2**63
        rows.append((rnd.choice(["a", "a", "b", None]), i, base ^ sum(1 << p for p in rnd.sample(range(63), rnd.randrange(4)))))
    rows += [("hot", 1000 + i, 77) for i in range(500)]
    want, kept = set(), {}
    for g, i, h in rows:
        if all(bin((h ^ x) & (2**64 - 1)).count("1") > 2 for x in kept.setdefault(g, [])):
            kept[g].append(h)
            want.add((g, i))
    df = spark.createDataFrame(rows + [("a", 9, None)], "g string, i long, h long")
    got = [(r.g, r.i) for r in K.greedy_distinct(df, "g", "i", "h").collect()]
    assert len(got) == len(want) and set(got) == want
    assert K.greedy_distinct(df.limit(0), "g", "i", "h").count() == 0
