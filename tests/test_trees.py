"""Best-first trees against a trainer that opens one leaf at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.functions.session import batches_of
from bindscape.operators import model as md, trees as tr


def plain_tree(bins, g, h, n_bins, leaves, depth, min_rows):
    """{rows of leaf: value} of a tree that splits the best open leaf, one after the other."""
    def best(rows, at):
        hist = np.zeros((3, bins.shape[1], n_bins))
        for j in range(bins.shape[1]):
            for k, v in enumerate((g, h, np.ones(len(g)))):
                np.add.at(hist[k, j], bins[rows, j], v[rows])
        out = (0.0, -1, 0)
        if depth is not None and at >= depth:
            return out
        for j in range(bins.shape[1]):
            for b in range(n_bins - 1):
                left, right = hist[:, j, : b + 1].sum(axis=1), hist[:, j, b + 1:].sum(axis=1)
                if min(left[2], right[2]) < max(min_rows, 1) or min(left[1], right[1]) <= 1e-12:
                    continue
                both = left + right
                gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - both[0] ** 2 / both[1]
                if gain > out[0] + 1e-9:
                    out = (gain, j, b)
        return out

    every = np.arange(len(g))
    open_ = [(every, 0, best(every, 0))]
    while len(open_) < leaves:
        i = max(range(len(open_)), key=lambda k: open_[k][2][0])
        rows, at, (gain, j, b) = open_[i]
        if gain <= 1e-9:
            break
        left = bins[rows, j] <= b
        open_[i: i + 1] = [(r, at + 1, best(r, at + 1)) for r in (rows[left], rows[~left])]
    return sorted((tuple(r.tolist()), -g[r].sum() / h[r].sum()) for r, _, _ in open_)


def data(n=2000, f=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, f)).round(2)
    x[:, 2] = rng.integers(0, 4, n)
    g = np.sin(2 * x[:, 0]) * (x[:, 2] - 1) + 0.3 * x[:, 1] + 0.1 * rng.normal(size=n)
    return x, g, rng.uniform(0.2, 1.0, n)


@pytest.mark.parametrize("leaves,depth,min_rows", [(2, None, 1), (20, None, 15), (63, None, 3), (40, 3, 1), (5, None, 900)])
def test_tree_equals_one_leaf_at_a_time(spark, leaves, depth, min_rows):
    x, g, h = data()
    edges = [np.unique(np.quantile(c, np.arange(1, 16) / 16))[:-1] for c in x.T]
    bins = tr.binned(x, edges)
    n_bins = max(map(len, edges)) + 1
    rows = spark.createDataFrame([(0, b.tobytes(), float(u), float(v)) for b, u, v in zip(bins, g, h)], "key int, bins binary, g double, h double")
    walk = tr.grow(rows.repartition(5), [0], n_features=5, n_bins=n_bins, leaves=leaves, depth=depth, min_rows=min_rows)[0]
    at = tr.leaf_of(walk, bins)
    got = sorted((tuple(np.flatnonzero(at == k).tolist()), walk[4][k]) for k in np.unique(at))
    want = plain_tree(bins, g, h, n_bins, leaves, depth, min_rows)
    assert [r for r, _ in got] == [r for r, _ in want] and len(got) <= leaves
    assert np.allclose([v for _, v in got], [v for _, v in want])
    tree = tr.with_thresholds(walk, edges)
    assert (tree.leaves(x) == at).all()


def rows_of(spark, n=1200):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * np.where(np.arange(n) % 3 == 0, -1, 1) + 0.4 * rng.normal(size=n) > 0.3).astype(int)
    return spark.createDataFrame(
        [(i, x[i].tolist(), int(y[i]), 1, i % 3, "train" if i % 4 else "valid") for i in range(n)],
        "id int, features array<double>, y int, weight int, part int, set_name string").cache()


def test_models_in_the_same_passes_equal_separate_ones(spark):
    df = rows_of(spark)
    edges = tr.bin_edges(df, "features", 31)
    options = dict(rounds=3, leaves=7, learning_rate=0.3, min_rows=10, edges=edges)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(run, name):
        sc.setJobGroup(name, name)
        out = run()
        n = len(tracker.getJobIdsForGroup(name))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return out, n

    three, n_three = jobs(lambda: md.train_boosted_by(df, "part", **options), "three")
    _, n_one = jobs(lambda: md.train_boosted_by(df.where("part = 0"), "part", **options), "one")
    assert n_three <= 1.5 * n_one
    x = np.array([r.features for r in df.orderBy("id").collect()])
    for k in range(3):
        alone = md.train_boosted(df.where(F.col("part") == k), **options)
        assert np.allclose(three[k].margins(x), alone.margins(x))
        assert three[k].history == alone.history and three[k].best_round == alone.best_round


def test_bins_and_missing_values(spark):
    df = spark.createDataFrame([([1.0, float(k % 3)], "train") for k in range(30)], "features array<double>, set_name string")
    edges = tr.bin_edges(df, "features", 8)
    assert edges[0].tolist() == [] and edges[1].tolist() == [0.0, 1.0]
    assert tr.binned(np.array([[1.0, np.nan], [9.0, 0.0], [0.0, 1.5]]), edges).tolist() == [[0, 2], [0, 0], [0, 2]]
    same = df.select("features", F.lit(1).alias("y"), F.lit(1).alias("weight"), "set_name")
    model = md.train_boosted(same, rounds=2)
    assert len(model.trees) == 2 and all(len(t.value) == 1 for t in model.trees)


def packed_rows(spark, n=3000):
    x, g, h = data(n)
    edges = [np.unique(np.quantile(c, np.arange(1, 16) / 16))[:-1] for c in x.T]
    rows = spark.createDataFrame(
        [(k % 2, "train", x[k].tolist(), float(g[k]), float(h[k]), 0.0) for k in range(n)],
        "key int, set_name string, features array<double>, y double, w double, margin double").repartition(3)
    return rows, x, edges, max(map(len, edges)) + 1


def test_plans_do_not_hold_the_passes_before(spark, monkeypatch):
    rows, _, edges, n_bins = packed_rows(spark)
    blocks = tr.packed(rows, edges).selectExpr("key", "bins", "y AS g", "w AS h").cache()
    sizes, write = [], tr.write_table

    def measured(df, path):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, path)

    monkeypatch.setattr(tr, "write_table", measured)
    tr.grow(blocks, [0, 1], n_features=5, n_bins=n_bins, leaves=40, min_rows=5)
    assert len(sizes) > 4 and max(sizes[1:]) <= 1.5 * sizes[1]


def test_blocks_give_the_trees_of_single_rows(spark):
    rows, x, edges, n_bins = packed_rows(spark)
    out = tr.packed(rows, edges).collect()
    assert {(r.key, r.set_name, r.fits) for r in out} == {(0, "train", True), (1, "train", True)}
    assert sum(len(r.bins) for r in out) == 5 * len(x) and sum(len(r.y) for r in out) == len(x)
    options = dict(n_features=5, n_bins=n_bins, leaves=9, min_rows=10)
    single = rows.select("key", tr_bins(edges)("features").alias("bins"), F.col("y").alias("g"), F.col("w").alias("h"))
    blocks = tr.packed(rows, edges).selectExpr("key", "bins", "y AS g", "w AS h")
    one, many = (tr.grow(d, [0, 1], **options) for d in (single, blocks))
    for k in (0, 1):
        assert all(np.allclose(a, b) for a, b in zip(one[k], many[k]))


def tr_bins(edges):
    return F.udf(lambda v: bytearray(tr.binned(np.array([v], float), edges).tobytes()), "binary")


def test_rows_without_weight_fit_no_tree(spark):
    rows = rows_of(spark)
    edges = tr.bin_edges(rows, "features", 31)
    some = rows.withColumn("weight", (F.col("id") % 5 > 0).cast("int"))
    options = dict(rounds=1, leaves=5, min_rows=10, edges=edges, objective=md.imbalance_logistic(1.0))
    x = np.array([r.features for r in rows.orderBy("id").collect()])
    one, other = md.train_boosted(some, **options), md.train_boosted(some.where("weight = 1"), **options)
    assert np.allclose(one.margins(x), other.margins(x))


def test_packing_bounds_batches_by_rows(spark, monkeypatch):
    rows, seen, settle = rows_of(spark), [], md.settle
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxBytesPerBatch", "maxRecordsPerBatch")]
    before = [spark.conf.get(n) for n in names]

    def noted(df):
        seen.append([int(spark.conf.get(n)) for n in names])
        return settle(df)

    monkeypatch.setattr(md, "settle", noted)
    md.train_boosted(rows, weight=None, rounds=1, leaves=3)
    # Spark sizes a batch for every row unless its bytes have no bound
    assert seen[0][0] == 2**31 - 1 and 0 < seen[0][1] <= int(before[1])
    assert [spark.conf.get(n) for n in names] == before
    with pytest.raises(ValueError), batches_of(spark, 1 << 20):
        assert int(spark.conf.get(names[1])) == 16
        raise ValueError
    assert [spark.conf.get(n) for n in names] == before


def test_arrays_of_several_lengths_are_refused(spark):
    rows = rows_of(spark)
    mixed = rows.withColumn("features", F.when(F.col("id") % 2 == 0, F.col("features")).otherwise(F.slice("features", 1, 2)))
    with pytest.raises(Exception, match="one length"):
        md.train_boosted(mixed.repartitionByRange(2, F.col("id") % 2), weight=None, rounds=1, leaves=3)
