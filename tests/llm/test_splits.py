import itertools
import random

import pytest

from tallyloom.llm import splits as S

SCHEMA = "rec_key long, source string, grid_id string, cluster string, group_key string, key string, loaded_at int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", i) for i, r in enumerate(rows)], SCHEMA)


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, s, g, c in rows:
        if k is None:
            continue
        find(k)
        if g is not None and g.strip() not in S.BLANK:
            parent[find(k)] = find("g:" + (g.strip() if "/" in g else f"{s or ''}/{g.strip()}"))
        if c is not None and c.strip() not in S.BLANK:
            parent[find(k)] = find("c:" + c.strip())
    groups = {}
    for k in {r[0] for r in rows} - {None}:
        groups.setdefault(find(k), set()).add(k)
    return {(k, min(g), len(g) > 1) for g in groups.values() for k in g}


def test_components_equal_union_find(spark):
    random.seed(1)
    rows = []
    for i in range(300):
        g = random.choice([None, "", "-", "nan", " None ", f"{random.randrange(120)}", f"a/{random.randrange(120)}", f" {random.randrange(50)} "])
        c = random.choice([None, " ", "None", f"u{random.randrange(150)}", "hot" if i % 7 == 0 else None])
        rows.append((random.choice([i, i, i, None if i % 50 == 0 else i]), random.choice(["a", "b", None]), g, c))
    rows += rows[:40]
    assert {tuple(r) for r in S.tied_groups(frame(spark, rows)).collect()} == brute(rows)


def test_long_chains(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    rows = [(k, "s", f"x/{i // 2}", f"c{(i + 1) // 2}") for i, k in enumerate(order)]
    assert {r.group_key for r in S.tied_groups(frame(spark, rows)).collect()} == {0}


def test_empty(spark):
    g = S.tied_groups(frame(spark, []))
    assert g.count() == 0
    t = spark.createDataFrame([("train", 1.0), ("test", 0.0)], "split string, target_share double")
    assert S.assign_splits(g, t).count() == 0


def test_closest_total_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randrange(1, 12) for _ in range(rng.randrange(0, 9))]
        sizes = {s: items.count(s) for s in items}
        target = rng.randrange(0, 60)
        got = S.closest_counts(sizes, target)
        assert all(got[s] <= sizes[s] for s in got)
        best = min(abs(sum(c) - min(target, sum(items))) for n in range(len(items) + 1) for c in itertools.combinations(items, n))
        assert abs(sum(s * k for s, k in got.items()) - min(target, sum(items))) == best
    assert sum(s * k for s, k in S.closest_counts({1: 500, 7: 300, 40: 200}, 3000).items()) == 3000


def test_closest_total_with_many_groups_equals_all_totals():
    rng = random.Random(5)
    for _ in range(60):  # multiplicities far beyond the reach of the filling, sizes with and without a common divisor
        step = rng.choice([1, 1, 2, 3])
        sizes = {step * rng.randrange(2, 14): rng.randrange(1, 400) for _ in range(rng.randrange(1, 5))}
        total = sum(s * c for s, c in sizes.items())
        bits = 1
        for s, c in sizes.items():
            for _ in range(c):
                bits |= bits << s
        target = rng.randrange(total + 1)
        got = S.closest_counts(sizes, target)
        assert all(0 <= got[s] <= sizes[s] for s in sizes)
        assert abs(sum(s * k for s, k in got.items()) - target) == min(abs(t - target) for t in range(total + 1) if bits >> t & 1)
    big = S.closest_counts({1: 10**10, 3: 10**9, 50: 10**7}, 6 * 10**9 + 1)
    assert sum(s * k for s, k in big.items()) == 6 * 10**9 + 1


def test_groups_stay_whole_and_shares_are_met(spark):
    rows = [(i, "s", f"{i // (1 + i % 5)}", None) for i in range(2000)]
    g = S.tied_groups(frame(spark, rows))
    t = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1), (None, 0.5)], "split string, target_share double")
    a = S.assign_splits(g, t).collect()
    assert len(a) == 2000
    by = {}
    for r in a:
        assert by.setdefault(r.group_key, r.split) == r.split
    n = {s: sum(r.split == s for r in a) for s in ("train", "test", "validation")}
    assert abs(n["test"] - 200) <= 1 and abs(n["validation"] - 200) <= 1
    assert sorted(r.split for r in S.split_report(S.assign_splits(g, t), t).collect()) == ["test", "train", "validation"]


def test_targets_are_needed(spark):
    with pytest.raises(ValueError):
        S.assign_splits(S.tied_groups(frame(spark, [(1, "s", None, None)])), spark.createDataFrame([], "split string, target_share double"))
