import json
import random

from tallyloom.llm import overlap as O

Q = "array<struct<name string, type string, instructions string, criteria array<struct<pos int, label string, desc string>>, target array<double>, negated string>>"
SCHEMA = f"rec_key long, source string, split string, coco_id long, state_json string, images array<struct<path string, url string>>, questions {Q}, tkey string, side string"


def frame(spark, rows):
    full = [(r.get("k"), r.get("source", "s"), r.get("split"), r.get("coco"), r.get("state"), r.get("images"), r.get("questions"), "t", "u") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def ask(*texts):
    return [("q", "noul", t, None, None, None) for t in texts]


def brute(rows):
    known = {}
    for r in rows:
        if r.get("k") is not None and r.get("split") in (*O.TRAIN, *O.EVALUATION):
            t = O.record_text(r.get("state"), [q[2] for q in r.get("questions") or []])
            images = r.get("images") or []
            paths = [x for i in images for x in i]
            part = t and (not images or len(t) >= 200)
            known[r["k"]] = (r["split"] == "train", O._grams(t) if part else None, O.image_numbers(r.get("coco"), paths))
    out = set()
    for a, (ta, ga, ia) in known.items():
        for b, (tb, gb, ib) in known.items():
            if ta and not tb and (ia & ib or (ga and gb and len(ga & gb) >= 0.8 * len(ga | gb))):
                out.add((min(a, b), max(a, b)))
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    asked = [prose(6) + "?" for _ in range(12)]
    rows = []
    for i in range(260):
        split = rng.choice(["train", "train", "test", "validation", "calibration", "raw"])
        state = json.dumps({"doc": prose(50), "n": 5})
        rows.append({"k": i, "split": split, "state": state, "questions": ask(rng.choice(asked), rng.choice(asked)), "coco": rng.choice([None] * 20 + [1, 2, 3, 4])})
    for i in range(150):  # copies, near copies and others that are not near enough
        base = rng.choice(rows[:260])
        t = json.loads(base["state"])["doc"].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 12])):
            t[rng.randrange(len(t))] = word()
        state = json.dumps(rng.choice([" ".join(t), {"a": [" ".join(t)], "image": {"path": "zzz"}}]))
        rows.append({"k": 1000 + i, "split": rng.choice(["train", "test"]), "state": state, "questions": base["questions"]})
    rows += rows[:10]
    rows += [
        {"k": 5000, "split": "train", "images": [("../COCO_val2014_000000000077.jpg", None)], "state": '"x"'}, {"k": 5001, "split": "test", "coco": 77, "state": None},
        {"k": 5002, "split": "test", "images": [(None, "http://h/train2017/00077.jpg"), ("val2017/a.jpg", None)], "state": "{cut"}, {"k": 5003, "split": "train", "state": '"A  b"'},
        {"k": 5004, "split": "test", "state": '"a\\u00a0B"'}, {"k": 5005, "split": "train", "state": '"z"'}, {"k": 5006, "split": "test", "state": '"Z"'}, {"k": None, "split": "test", "state": '"z"'},
        {"k": 5007, "split": None, "state": '"z"'}, {"k": 5008, "split": "train", "state": '""'}, {"k": 5009, "split": "test", "state": "[]"}, {"k": 5010, "split": "train", "state": json.dumps("long " * 30_000)},
        {"k": 5011, "split": "test", "state": json.dumps("long " * 30_001)}, {"k": 5012, "split": "test", "state": '"z"', "images": [("p.jpg", None)]},
    ]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    assert len(want) > 60
    df = frame(spark, rows)
    assert {tuple(r) for r in O.found(df).collect()} == want
    monkeypatch.setattr(O, "MOST_SLOTS", 1 << 16)  # a full table lets chunks of one side pass and loses none
    monkeypatch.setattr(O, "SALTS", {k: 3 for k in range(O.LEVELS + 1)})
    assert {tuple(r) for r in O.found(df).collect()} == want


def test_report_and_empty(spark):
    df = frame(spark, corpus()[:50])
    assert set(O.report(df).columns) == {"split", "source", "kind", "pairs", "records", "mean_fraction"}
    assert O.found(frame(spark, [])).count() == 0
    assert O.found(frame(spark, [{"k": 1, "split": "train"}, {"k": 2, "split": "test"}])).count() == 0


def evenly(text, least=0.8, most=0.82):
    """The text with one character in every so many replaced, to a similarity of least to most; None if no step gives it."""
    a = O._grams(text)
    for step in range(40, 12, -1):
        t = list(text)
        for i in range(step // 2, len(t), step):
            t[i] = "#"
        b = O._grams("".join(t))
        if least <= len(a & b) / len(a | b) <= most:
            return "".join(t)
    return None


def test_edits_spread_evenly_are_found(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(150):
        text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(6, 110)))
        other = evenly(text)
        if other:
            rows += [{"k": 2 * i, "split": "train", "state": json.dumps(text)}, {"k": 2 * i + 1, "split": "test", "state": json.dumps(other)}]
            want.add((2 * i, 2 * i + 1))
    assert len(want) > 80 and want == brute(rows)
    assert {tuple(r) for r in O.found(frame(spark, rows)).collect()} == want


def test_pairs_without_a_common_chunk_are_found(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):  # short texts with a letter more have often no chunk in common
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 16)))
        rows += [{"k": 2 * i, "split": "train", "state": json.dumps(text)}, {"k": 2 * i + 1, "split": "test", "state": json.dumps(text + "z")}]
    for i in range(40):  # the same pieces in another order, and sizes at both ends of the threshold
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(rng.randrange(1, 30))]
        a, b = "".join(words), "".join(rng.sample(words, len(words)))
        rows += [{"k": 5000 + 2 * i, "split": "train", "state": json.dumps(a)}, {"k": 5001 + 2 * i, "split": "test", "state": json.dumps(b[: round(len(b) * (0.8 + i / 200))])}]
    want = brute(rows)
    assert len(want) > 250
    got = {tuple(r) for r in O.found(frame(spark, rows)).collect()}
    assert got - want == set() and want - got == set()


def test_copies_make_no_more_comparisons(spark, monkeypatch):
    rows = [{"k": 100 * c + i, "split": ["train", "test"][i % 2], "state": json.dumps(f"text {i // 2} of some words that are copied")} for c in range(40) for i in range(20)]
    met, candidates = [], O.candidates
    monkeypatch.setattr(O, "candidates", lambda signed: met.append(signed.count()) or candidates(signed))
    want = brute(rows)
    assert len(want) >= 16_000
    assert {tuple(r) for r in O.found(frame(spark, rows).repartition(40, "rec_key")).collect()} == want
    assert met == [20]  # a text of a side once, whatever the tasks


def test_strips_of_sketches_lose_no_pair(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(O, "STRIP", 8)
    assert {tuple(r) for r in O.found(frame(spark, rows)).collect()} == brute(rows)
