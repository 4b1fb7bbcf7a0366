"""Packing, prompts, pipeline rules, sampling and sources on small fixtures."""

import collections
import json
import threading

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rng
from tallyloom.functions import text as T
from tallyloom.operators import packing as K
from tallyloom.operators import pipeline as P
from tallyloom.operators import prompts as Q
from tallyloom.operators import relational as R
from tallyloom.sources import files
from tallyloom.streaming import ingest


def test_micro_batches_hold_the_budget(spark):
    rows = [(i, n) for i, n in enumerate([10, 50, 20, 40, 30, 60, 5, 45, 500] * 40)]
    got = K.micro_batches(spark.createDataFrame(rows, "k long, n int"), "k", "n", 100, buffer=4).collect()
    assert sorted(r.k for r in got) == [k for k, _ in rows]
    batches = collections.defaultdict(list)
    for r in got:
        batches[r["slice"], r.buffer, r.batch].append(r.len)
    assert all(max(b) * len(b) <= 100 or len(b) == 1 for b in batches.values())
    assert all(len(b) == 1 for b in batches.values() if max(b) == 500)


def test_request_chunks_are_greedy(spark):
    lens = [3, 9, 4, 4, 8, 20]
    got = {r.name: r.chunk for r in K.request_chunks(spark.createDataFrame([(1, f"q{i}", n) for i, n in enumerate(lens)], "g long, name string, len int"), "g", "name", "len", 16).collect()}
    want, batch, rows, = {}, 0, []
    for n, name in sorted((n, f"q{i}") for i, n in enumerate(lens)):
        if rows and n * (len(rows) + 1) > 16:
            batch, rows = batch + 1, []
        rows.append(n)
        want[name] = batch
    assert got == want


def test_state_text():
    assert Q.state_text('"a\\nb\\n"') == "a\nb"
    assert Q.state_text('{"a": 1, "b": {"c": ["x", {"d": null}]}, "e": [], "f": "1\\n2"}') == "a: 1\nb:\n  c:\n    1. x\n    2.\n      d: null\ne: []\nf:\n  1\n  2"
    assert Q.state_text('{"image": {"url": "p.png"}, "t": true}') == "[image]\nt: true"
    assert Q.state_text('{"image": {"path": "p.png"}, "t": true}') == "image:\n  path: p.png\nt: true"
    assert Q.state_text('{"image": {"path": "p.png"}, "t": true}', ("url", "path")) == "[image]\nt: true"
    assert Q.state_text(None) is None and Q.state_text("{cut") == "{cut"


def test_pictures_are_left_out_as_written():
    for state, want in [
        ('{"a": {"image" : {"url": "http://x/{id}.png"}}}', '{"a": {"image" : "[image omitted]"}}'), ('{"image":{"path":"p","box":{"x":1}},"b": [ 1 ]}', '{"image":"[image omitted]","b": [ 1 ]}'),
        ('{"image":{"caption":"c"},"x":1}', '{"image":{"caption":"c"},"x":1}'), ('{"image": {"in": {"image": {"path": "p"}}}}', '{"image": {"in": {"image": "[image omitted]"}}}'),
        ('"\\"image\\": {\\"path\\": 1}"', '"\\"image\\": {\\"path\\": 1}"'), ('{"image": {"path": "cut', '{"image": {"path": "cut'), ('{"image": "path"}', '{"image": "path"}'),
    ]:
        assert Q.without_images(state) == want


def test_jobs_of_a_record(spark):
    q = lambda n, t, neg=None: (n, t, "?", None, None, neg)
    schema = "rec_key long, images array<string>, questions array<struct<name string, type string, instructions string, criteria array<string>, target array<double>, negated string>>"
    r = spark.createDataFrame([(1, [], [q("a", "choice"), q("b", "score"), q("c", "noul", "not?")]), (2, ["x"], [q("a", "noul")]), (3, None, None)], schema)
    got = collections.Counter((x.rec_key, x.kind) for x in Q.jobs(r).collect())
    assert got == {(1, "main"): 1, (1, "repeat"): 1, (1, "order"): 1, (1, "negation"): 1, (1, "separate"): 3, (2, "main"): 1, (2, "repeat"): 1, (2, "jitter"): 1, (3, "main"): 1, (3, "repeat"): 1}
    got = collections.Counter((x.rec_key, x.kind) for x in Q.jobs(r, True).collect())
    assert got[1, "main_part"] == 3 and (1, "main") not in got and got[2, "main"] == 1


def test_layouts_and_messages(spark):
    rows = [(True, 1, 10, 5), (True, 2, 10, 5), (False, 3, 3000, 5), (False, 1, 3001, 5), (True, 1, 20_000, 5)]
    df = spark.createDataFrame(rows, "p boolean, n int, t int, l int")
    how = lambda **k: [x.h for x in df.select(Q.layout(*(F.col(c) for c in "pntl"), **k).alias("h")).collect()]
    assert how() == ["image_twice", "once", "state_twice", "once", "once"]
    assert how(image_read="qfirst", read_twice="full") == ["image_qfirst", "once", "full", "once", "image_qfirst"] and set(how(image_read="", read_twice="")) == {"once"}
    q = spark.createDataFrame([(("noul", " Is it? ", None),)], "q struct<type string, instructions string, criteria array<struct<label string, desc string>>>")
    text = lambda h: q.select(Q.messages(F.lit("S"), F.col("q"), F.lit(h))["user"].alias("u")).first().u
    end = "\n\nQuestion: Is it?\n\nAnswer Yes or No."
    assert text("once") == "State:\nS" + end and text("state_twice") == "State:\nS\n\nState (repeated):\nS" + end
    assert text("full") == text("image_twice") == "State:\nS\n\nQuestion: Is it?\n\nState (repeated):\nS" + end and text("image_qfirst") == "Question: Is it?\n\nState:\nS" + end


def test_occlusion_equals_all_pairs(spark):
    import random

    rnd = random.Random(2)
    boxes = []
    for i in range(400):
        x, y = rnd.randrange(1500), rnd.randrange(900)
        boxes.append((i % 3, i, x, y, x + rnd.randrange(0, 500), y + rnd.randrange(0, 400)))
    df = spark.createDataFrame(boxes, "screen int, box_id int, x0 int, y0 int, x1 int, y1 int")
    for share in (0.5, 0.2):
        want = set()
        for s, i, a, b, c, d in boxes:
            for s2, j, e, f, g, h in boxes:
                w, t = max(0, min(c, g) - max(a, e)), max(0, min(d, h) - max(b, f))
                if s == s2 and j > i and c > a and d > b and g > e and h > f and w * t >= share * (c - a) * (d - b):
                    want.add((s, i))
        assert {tuple(r) for r in R.occluded(df, "screen", share, 128).collect()} == want and want


@pytest.fixture
def within(spark):
    """Jobs are cancelled after a minute, which fails the test."""
    t = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    t.start()
    yield
    t.cancel()


def test_many_equal_boxes_and_points_meet_once(spark, within):
    n = 300_000  # nine times ten to the tenth pairs
    boxes = spark.range(n).selectExpr("1 AS screen", "id AS box_id", "10 AS x0", "10 AS y0", "20 + CAST(id % 3 AS INT) AS x1", "20 AS y1")
    points = spark.range(n).selectExpr("1 AS screen", "id AS point_id", "15 + CAST(id % 2 AS INT) * 6 AS x", "15 AS y")
    got = R.boxes_at(points, boxes, "screen").groupBy("box_id", "around").count().collect()
    assert {tuple(r) for r in got} == {(0, n, n // 2), (1, n // 3 * 2, n // 2)}


def test_many_equal_boxes_are_occluded_once(spark, within):
    n = 300_000
    boxes = spark.range(n).selectExpr("1 AS screen", "id AS box_id", "10 AS x0", "10 AS y0", "20 + CAST(id % 3 AS INT) AS x1", "20 AS y1")
    got = R.occluded(boxes, "screen").selectExpr("count(*) AS n", "max(box_id) AS last").first()
    assert tuple(got) == (n - 1, n - 2)


def test_common_prefix(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1, 2]), ([], [1]), ([2], [1])], "a array<int>, b array<int>")
    assert [r.n for r in df.select(K.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 1, 0, 0]


def test_split_rates_and_coverage(spark):
    grids = spark.range(50_000).select(F.concat(F.lit("s/"), "id").alias("g"))
    got = {r.split: r["count"] / 50_000 for r in grids.groupBy(P.by_hash(F.col("g")).alias("split")).count().collect()}
    assert abs(got["calibration"] - 0.03) < 0.004 and abs(got["validation"] - 0.03) < 0.004
    rows = [("few", f"few/{i}") for i in range(49)] + [("some", f"some/{i}") for i in range(50)] + [("many", f"many/{i // 4}") for i in range(3000)]
    c = P.covered_splits(spark.createDataFrame(rows, "source string, grid_id string"))
    seen = collections.defaultdict(set)
    for r in c.collect():
        seen[r.source].add(r.split)
    assert seen == {"few": {"train"}, "some": {"train", "calibration", "validation"}, "many": {"train", "calibration", "validation"}}


def test_chunks_use_each_question_once(spark, data):
    r = P.once(spark.read.parquet(f"{data}/records.parquet"))
    c = P.chunked(r).collect()
    assert len({(x.rec_key, x.name, x.derived) for x in c}) == len(c)
    assert max(collections.Counter((x.source, x.grid_id, x.state_key, x.chunk) for x in c).values()) <= 16


def test_uniforms_do_not_depend_on_partitions(spark):
    a = spark.range(100, numPartitions=1).select(rng.unit(1, F.col("id")).alias("u")).collect()
    b = spark.range(100, numPartitions=7).select(rng.unit(1, F.col("id")).alias("u")).collect()
    assert a == b and all(0 <= r.u < 1 for r in a)


def test_derangement_has_no_fixed_point(spark):
    rows = spark.createDataFrame([(g, g * 100 + i) for g in range(4) for i in range(g + 1)], "g long, k long")
    got = R.derangement(rows, "g", "k").collect()
    assert len(got) == 9 and all(r.k != r.donor for r in got) and len({r.donor for r in got}) == 9


def test_near_hashes_equal_brute_force(spark):
    import random

    random.seed(4)
    base = [random.getrandbits(64) - 2**63 for _ in range(60)]
    near = [b ^ sum(1 << p for p in random.sample(range(63), i % 8)) for i, b in enumerate(base)]
    got = {(r.l, r.r, r.distance) for r in R.near_hashes(spark.createDataFrame(list(enumerate(base)), "id long, h long"), spark.createDataFrame(list(enumerate(near)), "id long, h long")).collect()}
    want = {(i, j, bin((a ^ b) & (2**64 - 1)).count("1")) for i, a in enumerate(base) for j, b in enumerate(near)}
    assert got == {x for x in want if x[2] <= 4}


@pytest.mark.parametrize(("text", "value"), [("1,234.5", 1234.5), ("-3", -3.0), ("12%", 12.0), ("1e+3", 1000.0), ("%", None), ("1,23", None), ("", None), ("abc", None)])
def test_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(T.number(F.col("t")).alias("v")).first().v == value


def test_lettered_options(spark):
    rows = [("Q\nA. x\nB. y",), ("Q\n(A) x\n(C) y",), ("A. x\nB. x",), ("no",), (None,)]
    assert [r.o for r in spark.createDataFrame(rows, "t string").select(T.lettered(F.col("t")).alias("o")).collect()] == [["x", "y"], None, None, None, None]


def test_jsonl_source_and_valid_sink(spark, tmp_path):
    lines = [json.dumps({"id": "1", "source": "a"}), "", "  ", '{"id": "2", "sour', json.dumps({"id": "3", "source": "é"})]
    (tmp_path / "a.jsonl").write_text("\r\n".join(lines), encoding="utf-8")
    got = files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl").collect()
    assert sorted((r.id or "", r.bad) for r in got if not r.bad) == [("1", False), ("3", False)] and sum(r.bad for r in got) == 1
    df = spark.createDataFrame([(1, []), (2, ["bad"])], "k long, errors array<string>")
    assert files.write_valid(df, "errors", f"file://{tmp_path}/out") == {"kept": 1, "refused": 1}
    with pytest.raises(ValueError):
        files.write_valid(df.where("k = 2"), "errors", f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="repeated"):
        files.unique(spark.createDataFrame([(1,), (1,)], "k long"), "k").collect()


def test_stream_drops_repeats(spark, data, tmp_path):
    s = ingest.usable_lines(ingest.stream(spark, data, ingest.LINE, "raw_records.parquet"))
    got = ingest.run_to_end(s, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    assert got.count() == got.select("id").distinct().count() > 0
