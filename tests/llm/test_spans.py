import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import spans as S


def brute(docs, w=S.SPAN):
    where = {}
    for k, t in docs:
        if k is not None and t:
            for i in range(len(t) - w + 1):
                where.setdefault(t[i : i + w], set()).add(k)
    out = set()
    for k, t in set(docs):
        if k is None or not t:
            continue
        run = None
        for i in range(len(t) - w + 1):
            if len(where[t[i : i + w]]) > 1:
                if run and i <= run[1] + w:
                    run[1] = i
                else:
                    if run:
                        out.add((k, run[0], run[1] - run[0] + w))
                    run = [i, i]
        if run:
            out.add((k, run[0], run[1] - run[0] + w))
    return out


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    zh = lambda n: "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(n))
    docs = [prose(120) for _ in range(30)] + [zh(300) for _ in range(10)]
    for i in range(60):  # stretches of 110 to 180 characters put into other texts
        a, b = rng.randrange(40), rng.randrange(40)
        n = rng.choice([110, 119, 120, 121, 130, 180])
        at = rng.randrange(max(1, len(docs[a]) - n))
        cut = rng.randrange(len(docs[b]))
        docs[b] = docs[b][:cut] + docs[a][at : at + n] + docs[b][cut:]
    docs += [docs[0], "x" * 500, "y" + "x" * 130, "ab" * 200, "b" + "ab" * 70 + "c", "q" * 119, "", None, "short", "The cat. " * 60, "cat. The " * 30]
    docs += ["".join(rng.choice("ACGT") for _ in range(700))]
    docs += ["head " + docs[-1][100:400] + " tail", "😀" * 200, "a" + "😀" * 150]
    return [(i + 1, d) for i, d in enumerate(docs)] + [(None, docs[0])]


@pytest.mark.parametrize("bits", [30, 4])
def test_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "FILTER_BITS", bits)  # few bits force the way through a join
    docs = corpus()
    df = spark.createDataFrame([(k, t, "d", 1) for k, t in docs], "doc_id long, text string, digest string, pos int")
    assert {tuple(r) for r in S.shared_spans(df).collect()} == brute(docs)


def test_a_passage_of_a_third_of_all_documents(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(str(rng.randrange(10**5)) for _ in range(n))
    hot = prose(40)
    docs = [(i, prose(30) + (f" {hot} " + prose(5) if i % 3 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in S.shared_spans(df).collect()}
    assert got == brute(docs) and len(got) == 200
    ws = S.Workspace(spark)
    most = S.windows_near_repeats(df, ws).groupBy("digest").agg(F.count_distinct("doc_id").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 5  # one document a part of a task, not all


def test_repeated_rows_share_nothing(spark):
    t = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (2, "other " * 10)], "doc_id long, text string")
    assert S.shared_spans(df).count() == 0


def test_fractions_and_empty(spark):
    t = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (2, t), (3, None), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.shared_fraction) for r in S.shared_fractions(df).collect()} == {(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0)}
    assert S.shared_spans(df.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    df = spark.createDataFrame([(1, long), (2, "before " + long[500_000:700_000] + " after")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.shared_spans(df).collect()}
    assert got[1].start_pos <= 500_000 and got[1].span_chars >= 200_000 and got[2].span_chars >= 200_000
