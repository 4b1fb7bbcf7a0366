import random
import unicodedata as ud

import pyarrow as pa

from tallyloom.llm import lookalike as L


def fold(*texts):
    return L.fold_array(pa.array(list(texts), pa.string())).to_pylist()


ALIKE = [
    ("excellent", "ｅｘｃｅｌｌｅｎｔ"), ("muy débil", "muy débil"), ("off topic", "oﬀ topic"), ("good overall", "gօօԁ οverаll"), ("行人可见", "⾏⼈可​见"),
    ("daño leve", "dan​̃o leve"), ("Zugang", "Ζu­gang"), ("технический", "техничecкий"), ("ё", "ë"), ("한국", "한국"), ("ﾊﾞ", "バ"),
    ("q̣̇", "q̣̇"), ("What?", "Wһаt？"), ("Й", "Й"),
]
DIFFERENT = [("resume", "résumé"), ("Open", "open"), ("x²", "x2"), ("①", "1"), ("½", "1/2"), ("a b", "a  b"), ("что", "что?"), ("l", "1"), ("O", "0"), ("ſ", "s"), ("ı", "i")]


def test_alike_and_different():
    for a, b in ALIKE:
        assert fold(a) == fold(b), (a, b)
    for a, b in DIFFERENT:
        assert fold(a) != fold(b), (a, b)


def test_null_empty_invisible_and_long():
    assert fold(None, "", "​﻿", "a") == [None, "", "", "a"]
    assert fold("é" * 300_000) == fold("é" * 300_000)
    assert fold() == []


def test_equal_forms_by_the_standard_and_stability():
    random.seed(5)
    pool = [chr(c) for r in (range(0x20, 0x250), range(0x300, 0x345), range(0x386, 0x460), range(0x1E00, 0x1EFA), range(0xAC00, 0xAC40), range(0x3041, 0x30FF)) for c in r if ud.category(chr(c)) != "Cn"]
    texts = ["".join(random.choice(pool) for _ in range(random.randrange(8))) for _ in range(5000)]
    plain = fold(*texts)
    for form in ("NFC", "NFD"):
        assert fold(*(ud.normalize(form, t) for t in texts)) == plain
    assert fold(*plain) == plain
    one = [fold(t)[0] for t in texts[:300]]
    assert one == plain[:300]  # no text reaches into its neighbours


def test_sliced_arrays():
    a = pa.array(["x", None, "ａ", "b​", "é"])
    assert L.fold_array(a.slice(1, 3)).to_pylist() == [None, "a", "b"]


def test_matches_wordings(spark):
    q = "array<struct<name string, type string, instructions string, criteria array<struct<pos int, label string, desc string>>, target array<double>, negated string>>"
    rows = [
        (1, [("q1", "choice", "Ｇood?", [(0, "A", "bаd"), (1, "B", "bad"), (2, "C", None)], None, None)], "x"),
        (1, [("q1", "choice", "Ｇood?", [(0, "A", "bаd"), (1, "B", "bad"), (2, "C", None)], None, None)], "y"),
        (2, [(None, None, None, None, None, None)], None),
        (3, None, None),
        (None, [("q1", "noul", "Ｇood?", None, None, None)], None),
        (4, [("q2", "noul", "good?", [(0, "true", "Good?")], None, None)], None),
    ]
    records = spark.createDataFrame(rows, f"rec_key long, questions {q}, form string")
    w = spark.createDataFrame([(10, "instructions", "Good?"), (11, "criteria", "bad"), (12, "criteria", None), (13, None, "bad")], "wording_id long, field string, text string")
    assert sorted(tuple(r) for r in L.alike(records, w).collect()) == [(1, "q1", -1, 10), (1, "q1", 0, 11)]
    assert L.alike(records.limit(0), w).count() == 0 and L.alike(records, w.limit(0)).count() == 0
