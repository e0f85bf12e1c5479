import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.operators import rankagg as ra, sequence as sq


def _panel(spark, n_items=6, n_experts=5, seed=0):
    rng = np.random.default_rng(seed)
    lists = {e: rng.permutation(n_items) + 1 for e in range(n_experts)}
    rows = [(e, f"i{j}", int(lists[e][j])) for e in lists for j in range(n_items)]
    return lists, spark.createDataFrame(rows, "expert int, item string, rank bigint")


def _ranks(df):
    return {r["item"]: r["rank"] for r in df.collect()}


def test_scores_become_permutations(spark, both_paths):
    df = spark.createDataFrame([(e, f"i{j}", float((j * 7 + e) % 4)) for e in range(3) for j in range(9)], "expert int, item string, score double")
    for e in range(3):
        got = sorted(r["rank"] for r in ra.to_ranks(df).where(f"expert = {e}").collect())
        assert got == list(range(1, 10))


def test_full_disagreement_and_single_item(spark):
    df = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "a", 2), (1, "b", 1)], "expert int, item string, rank bigint")
    assert _ranks(ra.borda(df)) == {"a": 1, "b": 2}
    one = spark.createDataFrame([(0, "a", 1), (1, "a", 1)], "expert int, item string, rank bigint")
    for method in ("borda", "median", "highest", "robust", "rrobin"):
        assert _ranks(ra.aggregate_ranks(one, method=method, scores=False)) == {"a": 1}


def test_partial_lists(spark):
    df = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "b", 1)], "expert int, item string, rank bigint")
    full = {(r.expert, r["item"]): r["rank"] for r in ra.supplement(df).collect()}
    assert full == {(0, "a"): 1, (0, "b"): 2, (0, "c"): 3, (1, "a"): 2, (1, "b"): 1, (1, "c"): 2}
    for stat, fn in (("mean", np.mean), ("median", np.median), ("geo", lambda v: math.exp(np.mean(np.log(v))))):
        got = {r["item"]: r.score for r in ra.partial_borda(df, stat=stat).collect()}
        for item in "abc":
            assert got[item] == pytest.approx(fn([full[(e, item)] for e in (0, 1)]), abs=1e-9)
    assert _ranks(ra.modified_borda(df)) == {"a": 1, "b": 2, "c": 3}


def test_groups_do_not_mix(spark):
    _, a = _panel(spark, seed=1)
    _, b = _panel(spark, seed=2)
    both = a.withColumn("g", F.lit("x")).unionByName(b.withColumn("g", F.lit("y")))
    for fn in (ra.borda, ra.robust, ra.median_rank, ra.round_robin):
        out = fn(both, group=["g"]).collect()
        assert {r["item"]: r["rank"] for r in out if r.g == "x"} == _ranks(fn(a))
        assert {r["item"]: r["rank"] for r in out if r.g == "y"} == _ranks(fn(b))


def _round_robin(lists):
    left, out, n = set(range(len(lists[0]))), {}, 0
    while left:
        e = lists[n % len(lists)]
        best = min(left, key=lambda j: e[j])
        n += 1
        out[f"i{best}"] = n
        left.remove(best)
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_round_robin(spark, seed):
    lists, df = _panel(spark, n_items=8, n_experts=3, seed=seed)
    assert _ranks(ra.round_robin(df)) == _round_robin(lists)


def _kendall(s, t):
    bad = sum((s[i] - s[j]) * (t[i] - t[j]) < 0 for i, j in itertools.combinations(range(len(s)), 2))
    return 2 * bad / (len(s) * (len(s) - 1))


def test_kendall_and_footrule(spark, both_paths):
    lists, df = _panel(spark, n_items=9, n_experts=4, seed=5)
    target = ra.borda(df)
    goal = _ranks(target)
    t = [goal[f"i{j}"] for j in range(9)]
    kendall = {r.expert: r.kendall for r in ra.kendall_distance(df, target).collect()}
    footrule = {r.expert: r.footrule for r in ra.footrule_distance(df, target).collect()}
    for e, s in lists.items():
        assert kendall[e] == pytest.approx(_kendall(s, t))
        assert footrule[e] == pytest.approx(2 * sum(abs(a - b) for a, b in zip(s, t)) / 81)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kemeny_pass(spark, seed):
    lists, df = _panel(spark, n_items=9, n_experts=4, seed=seed)
    # a poor start (worst items first) makes long runs of swaps
    start = ra.borda(df).withColumn("rank", 10 - F.col("rank")) if seed == 2 else ra.lowest_rank(df)
    first = _ranks(start)
    items = sorted(first, key=first.get)
    votes = [[int(lists[e][int(i[1:])]) for i in items] for e in lists]
    sigma = [first[i] for i in items]
    best = sum(_kendall(sigma, v) for v in votes)
    for i in range(len(items) - 1):
        other = list(sigma)
        other[i], other[i + 1] = other[i + 1], other[i]
        cost = sum(_kendall(other, v) for v in votes)
        if cost < best - 1e-12:
            sigma, best = other, cost
    assert _ranks(ra.kemeny_pass(start, df)) == dict(zip(items, sigma))


def test_unknown_method(spark):
    _, df = _panel(spark)
    with pytest.raises(ValueError):
        ra.aggregate_ranks(df, method="nope", scores=False)


def test_cluster_representatives(spark):
    rows = [("s", 1, True, "denovo1"), ("s", 2, False, "x"), ("s", 3, True, "denovo2"), ("s", 4, True, "y"), ("s", 5, False, "z")]
    out = sq.cluster_representatives(spark.createDataFrame(rows, "scan string, row_no int, is_top boolean, name string"))
    assert sorted((r.cluster_no, r.name) for r in out.collect()) == [(1, "x"), (3, "y")]
