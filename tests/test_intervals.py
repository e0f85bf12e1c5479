import random

import numpy as np
from pyspark.sql import functions as F

from bindscape.operators import intervals as iv, labels as lb

S = "chrom string, start bigint, stop bigint"


def _random(spark, n, seed, width=60, span=1500):
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, span, n)
    rows = [(f"c{int(rng.integers(0, 2))}", int(s), int(s + rng.integers(1, width))) for s in starts]
    return rows, spark.createDataFrame(rows, S)


def test_tile(spark):
    out = iv.tile(spark.createDataFrame([("a", 351), ("b", 200), ("c", 350)], "chrom string, length bigint"))
    got = sorted((r.chrom, r.start, r.stop) for r in out.collect())
    # start + 200 < length
    assert got == [("a", 0, 200), ("a", 50, 250), ("a", 100, 300), ("a", 150, 350), ("c", 0, 200), ("c", 50, 250), ("c", 100, 300)]


def test_overlap_counts_against_nested_loop(spark, both_paths):
    left, ldf = _random(spark, 80, 1)
    right, rdf = _random(spark, 120, 2)
    got = sorted((r.chrom, r.start, r.stop, r.n_overlap) for r in iv.count_overlaps(ldf, rdf).collect())
    want = sorted((c, s, e, sum(1 for d, a, b in right if d == c and a < e and s < b)) for c, s, e in left)
    assert got == want
    semi = sorted((r.chrom, r.start, r.stop) for r in iv.overlapping(ldf, rdf).collect())
    assert semi == sorted(w[:3] for w in want if w[3] > 0)


def test_touching_is_not_overlapping(spark):
    a = spark.createDataFrame([("c", 10, 20)], S)
    b = spark.createDataFrame([("c", 20, 30), ("c", 0, 10), ("d", 10, 20), ("c", 19, 20)], S)
    assert iv.count_overlaps(a, b).first().n_overlap == 1
    assert iv.count_overlaps(a, b.limit(0)).first().n_overlap == 0


def test_bin_counts_against_nested_loop(spark):
    rows, df = _random(spark, 60, 5, width=700)
    bins = iv.tile(spark.createDataFrame([("c0", 2000), ("c1", 900)], "chrom string, length bigint"))
    for r in iv.count_bins(bins, df).collect():
        assert r.n_overlap == sum(1 for c, s, e in rows if c == r.chrom and s < r.stop and r.start < e)


def _merge(rows, gap=0):
    out = []
    for c, s, e in sorted(rows):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1] = (c, out[-1][1], max(out[-1][2], e), out[-1][3] + 1)
        else:
            out.append((c, s, e, 1))
    return sorted(out)


def test_merge_random(spark, both_paths):
    rows, df = _random(spark, 150, 9, width=25)
    for gap in (0, 7):
        got = sorted((r.chrom, r.start, r.stop, r.n_members) for r in iv.merge_intervals(df, gap=gap).collect())
        assert got == _merge(rows, gap)


def test_merge_cases(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 21, 30), ("a", 22, 25), ("b", 5, 9), ("b", 5, 7)]
    df = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], S + ", score double")
    out = iv.merge_intervals(df, mean="score")
    got = sorted((r.chrom, r.start, r.stop, r.score) for r in out.collect())
    assert got == [("a", 0, 20, 0.5), ("a", 21, 30, 2.5), ("b", 5, 9, 4.5)]
    again = iv.merge_intervals(out)
    assert sorted((r.chrom, r.start, r.stop) for r in again.collect()) == [g[:3] for g in got]


def _label_inputs(spark, rows):
    df = spark.createDataFrame(rows, S + ", sample_id int, score double")
    bins = iv.tile(spark.createDataFrame([("c", 1001)], "chrom string, length bigint"))
    return bins, df


def test_labels(spark):
    # bin 0 only: summits of two samples; bin at 600: peaks of two samples, one summit
    bins, summits = _label_inputs(spark, [("c", 10, 11, 1, 9.0), ("c", 12, 13, 2, 9.0), ("c", 12, 14, 2, 9.0), ("c", 610, 611, 1, 9.0)])
    _, peaks = _label_inputs(spark, [("c", 605, 620, 1, 9.0), ("c", 600, 615, 2, 9.0), ("c", 990, 999, 2, 9.0)])
    out = {r.start: r.label for r in lb.consensus_labels(bins, summits, peaks, q=5).collect()}
    assert out[0] == "B" and out[600] == "A" and out[800] == "U" and out[300] == "U"
    assert {s for s, l in out.items() if l == "A"} == {450, 500, 550, 600}


def test_same_sample_twice_is_one_support(spark):
    bins, s = _label_inputs(spark, [("c", 10, 11, 1, 9.0), ("c", 12, 13, 1, 9.0)])
    reps = spark.createDataFrame([(1,), (2,)], "sample_id int")
    assert {r.label for r in lb.consensus_labels(bins, s, s, samples=reps).collect()} == {"U"}


def test_single_replicate(spark):
    bins, s = _label_inputs(spark, [("c", 10, 11, 1, 9.0), ("c", 300, 301, 1, 2.0)])
    out = {r.start: r.label for r in lb.consensus_labels(bins, s, s, q=5).collect()}
    assert out[0] == "B" and out[300] == "U"


def test_support_matrix_forms_agree(spark):
    bins, df = _label_inputs(spark, [("c", 10, 60, 1, 1.0), ("c", 40, 90, 2, 1.0), ("c", 700, 800, 2, 1.0)])
    long = {(r.start, r.sample_id) for r in iv.support_matrix(bins, df).collect()}
    wide = iv.support_matrix(bins, df, samples=[1, 2]).collect()
    assert long == {(r.start, s) for r in wide for s in (1, 2) if r[f"s_{s}"]}
    support = {r.start: r.support for r in iv.coverage_support(bins, df).collect()}
    assert all(support[r.start] == r.s_1 + r.s_2 for r in wide)


def test_interval_sets(spark):
    q = spark.createDataFrame([(0, "c", 0, 100), (0, "c", 500, 600)], "query_id int, " + S)
    db = spark.createDataFrame([(7, "c", 50, 60), (7, "c", 550, 560), (8, "c", 5000, 5100)], "set_id int, " + S)
    ranked = iv.rank_interval_sets(q, db, query_ids=[0], genome=100_000)
    got = {r.set_id: (r.n_overlap, r.n_hit) for r in ranked.collect()}
    assert got == {7: (2, 2), 8: (0, 0)}
    assert iv.best_interval_set(ranked).first().set_id == 7


def test_interval_set_sweep_against_brute_force(spark):
    rng = random.Random(11)

    def intervals(n, sets):
        rows = []
        for _ in range(n):
            start = rng.randrange(3000) if rng.random() < 0.7 else rng.randrange(100)
            rows.append((rng.choice(sets), rng.choice(["c", "d"]), start, start + rng.choice([0, 1, 2, 30, 200, 2500])))
        return rows

    for tile, cell_rows in ((1 << 16, 1 << 18), (128, 1 << 18), (500, 7)):
        db, q = intervals(160, [1, 2, 3]), intervals(120, ["x", "y"])
        want = {}
        for s, c, a, b in db:
            for k in "xy":
                n = sum(1 for qs, qc, qa, qb in q if (qs, qc) == (k, c) and qa < b and a < qb and a < b and qa < qb)
                if n:
                    total, hit = want.get((s, k), (0, 0))
                    want[s, k] = total + n, hit + 1
        got = iv.overlaps_between(
            spark.createDataFrame(db, "set_id int, " + S), spark.createDataFrame(q, "query_id string, " + S), tile=tile, cell_rows=cell_rows)
        assert {(r.set_id, r.query_id): (r.n_overlap, r.n_hit) for r in got.collect()} == want
    empty = spark.createDataFrame([], "set_id int, " + S)
    assert iv.overlaps_between(empty, spark.createDataFrame(q, "query_id string, " + S)).count() == 0


def test_reproducible(spark):
    bins, df = _label_inputs(spark, [("c", 0, 10, 1, 1.0), ("c", 5, 12, 2, 1.0), ("c", 50, 60, 1, 1.0)])
    regions = iv.merge_intervals(df)
    kept = iv.keep_reproducible(iv.reproducible(regions, df, samples=[1, 2])).collect()
    assert [(r.start, r.n_support) for r in kept] == [(0, 2)]
    lone = iv.keep_reproducible(iv.reproducible(regions, df.where(F.col("sample_id") == 1), samples=[1]))
    assert lone.count() == 2
