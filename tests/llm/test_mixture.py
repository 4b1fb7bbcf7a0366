import pytest

from tallyloom.llm import mixture as M
from tallyloom.llm.tokenize import DEFAULT_VOCABULARY


@pytest.fixture(scope="module", autouse=True)
def vocabulary():
    from pathlib import Path

    if not Path(DEFAULT_VOCABULARY).exists():
        pytest.skip("no vocabulary here")


def tables(spark, docs, targets):
    return (
        spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, source string, text string, weight string, slice int"),
        spark.createDataFrame(targets, "source string, target_share double, max_repeats int"),
    )


def test_shares_caps_and_order(spark):
    docs = [(i, "big", "one two three four") for i in range(600)] + [(1000 + i, "mid", "one two") for i in range(300)] + [(2000 + i, "tiny", "word") for i in range(5)]
    docs += [(3000, None, "lost"), (3001, "unlisted", "lost"), (3002, "mid", None), (3003, "mid", "")] + docs[:7]
    d, t = tables(spark, docs, [("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.1, 2), ("gone", 0.2, 2), ("zero", 0.0, 2), (None, 0.3, 1)])
    mix = M.mix(d, t, budget=2000)
    rows = mix.collect()
    assert sum(r.n_tokens for r in rows) <= 2000 and sum(r.n_tokens for r in rows) > 1990
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    assert len({(r.doc_id, r.round) for r in rows}) == len(rows)
    assert {r.source for r in rows} == {"big", "mid", "tiny"}
    s = {r.source: r for r in M.shares(mix, t).collect()}
    assert s["tiny"].uses == 10 and s["tiny"].most_uses == 2 and s["gone"].tokens == 0
    assert s["big"].tokens / s["mid"].tokens == pytest.approx(0.5 / 0.4, rel=0.02)
    assert s["big"].most_uses == 1 and s["mid"].most_uses <= 3


def test_the_largest_budget_with_all_shares(spark):
    docs = [(i, "big", "one two three four") for i in range(600)] + [(1000 + i, "mid", "one two") for i in range(300)] + [(2000 + i, "tiny", "word") for i in range(20)]
    d, t = tables(spark, docs, [("big", 0.6, 1), ("mid", 0.3, 3), ("tiny", 0.05, 4), ("gone", 0.05, 9)])
    s = {r.source: r for r in M.shares(M.mix(d, t, "shares"), t).collect()}
    total = 20 * 4 / 0.05 * 0.95  # tiny is used up to its last repeat
    assert sum(r.tokens for r in s.values()) == pytest.approx(total, abs=8) and s["tiny"].most_uses == 4
    assert all(s[k].tokens / total == pytest.approx(w / 0.95, abs=0.005) for k, w in (("big", 0.6), ("mid", 0.3), ("tiny", 0.05)))
    assert M.mix(d.limit(0), t, "shares").count() == 0


def test_default_budget_and_empty(spark):
    d, t = tables(spark, [(1, "a", "x y z"), (2, "b", "x")], [("a", 0.5, None), ("b", 0.5, 10)])
    assert sum(r.n_tokens for r in M.mix(d, t).collect()) <= 4
    assert M.mix(d.limit(0), t).count() == 0
    assert M.mix(d, t.limit(0)).count() == 0
    assert M.shares(M.mix(d.limit(0), t), t).count() == 2
