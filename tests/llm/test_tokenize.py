import random

import pyarrow as pa
import pytest

from tallyloom.llm import tokenize as K

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def raw():
    try:
        with open(K.DEFAULT_VOCABULARY, "rb") as f:
            return f.read()
    except OSError:
        pytest.skip("no vocabulary here")


def expect(raw, texts):
    t = tokenizers.Tokenizer.from_str(raw.decode())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_merges(raw):
    random.seed(6)
    sets = ["ab", "aeiostrn", "the ", "0123", "éàü", "你好世界是的", "\x80 \n\t", "aA1.", "'s't're've'll d", "' \n'sdmr e", "😀é́  　"]
    texts = ["".join(random.choice(random.choice(sets)) if random.random() < 0.1 else random.choice(s) for _ in range(random.randrange(40))) for s in sets for _ in range(400)]
    texts += ["", "a" * 50_000, " " * 30_000, "ab" * 20_000, "é" * 10_000, "<|endoftext|>", "it's 'tis''s\n's"]
    flat, ends = K.Worker(raw).ids(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == expect(raw, texts)


def test_frame_with_null_and_clashing_columns(spark, raw):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (4, "x" * 20_000, 8), (1, "Hello world", 9), (None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in K.encode(docs).collect()]
    assert sorted(got, key=str) == sorted([(k, i) for (k, _, _), i in zip(rows, expect(raw, [t or "" for _, t, _ in rows]), strict=True)], key=str)
    n = {(r.doc_id, r.n_tokens) for r in K.token_counts(docs, ["doc_id"]).collect()}
    assert n == {(k, len(i)) for k, i in got}
    assert K.encode(docs.limit(0)).count() == 0
