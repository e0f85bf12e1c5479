import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.functions.scalars import log_gamma, normal_upper_tail, poisson_upper_tail, regularized_gamma_upper
from bindscape.operators import metrics as mt, peaks as pk, stats as st


def _tail(k, mu):
    return sum(math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1)) for i in range(k + 1, k + 400))


def test_poisson_values(spark):
    # mode 0.5 and 1.5 tie -> 0.5; mean of excess below 1 -> mean 1
    margins = [0.5, 0.5, 1.5, 1.5, 0.2, 3.65, 60.0]
    df = spark.createDataFrame([("c", i * 50, m) for i, m in enumerate(margins)], "chrom string, start bigint, margin double")
    got = {r.start: r.neglog10p for r in pk.poisson_neglog10p(df).collect()}
    mu = max(np.mean([max(round(m - 0.5, 2), 0) for m in margins]), 1)
    for i, m in enumerate(margins):
        k = math.floor(max(round(m - 0.5, 2), 0))
        assert got[i * 50] == pytest.approx(-math.log10(max(_tail(k, mu), 1e-16)), abs=1e-9)
    assert got[300] == pytest.approx(16.0)


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (5.0,)], "v double")
    assert pk.most_frequent(df, "v").first()[0] == 1.0


def _bh(p):
    p = np.asarray(p)
    order = np.argsort(-p)
    n = len(p)
    adj = np.minimum(1, np.minimum.accumulate(n / np.arange(n, 0, -1) * p[order]))
    out = np.empty(n)
    out[order] = adj
    return out


def test_bh(spark, both_paths):
    rng = np.random.default_rng(0)
    p = np.round(rng.uniform(0, 1, 200) ** 3, 3).tolist() + [0.0, 1.0, 1.0]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(p)], "chrom string, start bigint, p double")
    got = {r.start: r.fdr for r in pk.bh_adjust(df, "p", decimals=None).collect()}
    assert len(got) == len(p)
    assert np.allclose([got[i] for i in range(len(p))], _bh(p))


@pytest.mark.parametrize("p", [[0.3] * 5, [0.04], [1.0, 1.0]])
def test_bh_degenerate(spark, p):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(p)], "chrom string, start bigint, p double")
    got = [r.fdr for r in pk.bh_adjust(df, "p").orderBy("start").collect()]
    assert np.allclose(got, _bh(p))


def test_top_n_ties_by_position(spark, both_paths):
    df = spark.createDataFrame([("c", i, float(i % 5)) for i in range(100)], "chrom string, start bigint, score double")
    got = [(r.start, r.score) for r in pk.top_n(df, 25).collect()]
    want = sorted(((i, float(i % 5)) for i in range(100)), key=lambda x: (-x[1], x[0]))[:25]
    assert got == want
    assert pk.top_n(df, 1000).count() == 100


def test_call_peaks_end_to_end(spark, both_paths):
    margins = [0.0] * 400
    margins[100:104] = [40.0] * 4
    margins[300] = 30.0
    df = spark.createDataFrame(
        [("c", i * 50, i * 50 + 200, m) for i, m in enumerate(margins)], "chrom string, start bigint, stop bigint, margin double"
    )
    got = [(r.start, r.stop) for r in pk.call_peaks(df).collect()]
    assert got == [(5000, 5350), (15000, 15200)]


def _curve(y, s):
    y, s = np.asarray(y), np.asarray(s)
    ap, tp_before = 0.0, 0
    auc = 0.0
    for v in sorted(set(s), reverse=True):
        tp, n = y[s >= v].sum(), (s >= v).sum()
        ap += (tp - tp_before) / y.sum() * tp / n
        neg = ((s == v) & (y == 0)).sum()
        auc += neg * (tp_before + ((s == v) & (y == 1)).sum() / 2)
        tp_before = tp
    return ap, auc / (y.sum() * (1 - y).sum())


def test_curve_metrics(spark, both_paths):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300).tolist()
    s = np.round(rng.normal(size=300) + np.array(y), 1).tolist()
    df = spark.createDataFrame(list(zip(y, s)), "y int, score double")
    ap, auc = _curve(y, s)
    assert mt.average_precision(df).first().auprc == pytest.approx(ap)
    assert mt.auroc(df).first().auroc == pytest.approx(auc)
    warped = df.withColumn("score", F.exp("score"))
    assert mt.average_precision(warped).first().auprc == pytest.approx(ap)


def test_metric_edges(spark):
    equal = spark.createDataFrame([(1, 2.0), (0, 2.0), (0, 2.0)], "y int, score double")
    assert mt.auroc(equal).first().auroc == 0.5
    assert mt.average_precision(equal).first().auprc == pytest.approx(1 / 3)
    perfect = spark.createDataFrame([(1, 3.0), (0, 2.0), (0, 1.0)], "y int, score double")
    assert mt.auroc(perfect).first().auroc == 1.0 and mt.auprc_trapezoid(perfect).first().auprc == 1.0
    none = spark.createDataFrame([(0, 3.0), (0, 2.0)], "y int, score double")
    assert mt.average_precision(none).first().auprc == 0.0 and mt.auroc(none).first().auroc is None


def test_special_functions(spark):
    row = spark.range(1).select(
        normal_upper_tail(F.lit(1.96)).alias("n"), normal_upper_tail(F.lit(-1.0)).alias("m"),
        poisson_upper_tail(F.lit(3), F.lit(2.0)).alias("p"), log_gamma(F.lit(4.5)).alias("g"),
        regularized_gamma_upper(F.lit(2.0), F.lit(3.0)).alias("q"), regularized_gamma_upper(F.lit(2.0), F.lit(0.5)).alias("r"),
    ).first()
    assert row.n == pytest.approx(math.erfc(1.96 / math.sqrt(2)) / 2, rel=1e-6)
    assert row.m == pytest.approx(1 - math.erfc(1 / math.sqrt(2)) / 2, rel=1e-6)
    assert row.p == pytest.approx(_tail(3, 2.0))
    assert row.g == pytest.approx(math.lgamma(4.5), abs=1e-10)
    assert row.q == pytest.approx(math.exp(-3) * 4, abs=1e-10)  # Q(2, x) = e^-x (1 + x)
    assert row.r == pytest.approx(math.exp(-0.5) * 1.5, abs=1e-10)


def test_gamma_p_is_monotone(spark):
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate([0, 0, 0, 0, 1, 2, 3, 5, 9, 30])], "chrom string, start bigint, margin double")
    out = [r.neglog10p for r in pk.gamma_neglog10p(df).orderBy("margin").collect()]
    assert out == sorted(out) and max(out) <= 16 and out[0] == pytest.approx(0.0)


def test_rank_sum(spark):
    x, z = [5.0, 6.0, 7.0, 7.0, 9.0], [1.0, 2.0, 5.0, 7.0]
    df = spark.createDataFrame([(1, v) for v in x] + [(0, v) for v in z], "g int, v double")
    out = st.rank_sum_test(df, value="v", group="g").first()
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in z)
    n, ties = 9, (2**3 - 2) + (3**3 - 3)
    sd = math.sqrt(20 / 12 * (10 - ties / (n * (n - 1))))
    p = math.erfc((u - 10 - 0.5) / sd / math.sqrt(2)) / 2
    assert out.neglog10p == pytest.approx(-math.log10(p), rel=1e-5)
    assert st.rank_sum_test(df.where("g = 0 OR v = 9"), value="v", group="g").first().neglog10p == 0.0


def test_constant_inputs_give_no_evidence(spark):
    from bindscape.operators import peaks, samples, stats

    tied = spark.createDataFrame([(i % 2, 3.0) for i in range(20)], "g int, v double")
    assert stats.rank_sum_test(tied, value="v", group="g").first()["neglog10p"] == 0
    flat = spark.createDataFrame([("c", i, 0.0 if i < 6 else 5.0) for i in range(10)], "chrom string, start bigint, margin double")
    assert {r.margin: r.neglog10p for r in peaks.gamma_neglog10p(flat).collect()} == {0.0: 0.0, 5.0: 0.0}
    meta = spark.createDataFrame([(i, "F", "L", "K", "T") for i in (1, 2)], "sample_id int, factor string, line string, kind string, tissue string")
    loaded = spark.createDataFrame([(1,)], "sample_id int")
    assert [(r.sample_id, r.weight) for r in samples.select_chip(meta, "F", "L", loaded).collect()] == [(1, 2)]


def test_curves_and_cofactors_have_no_cap(spark):
    from bindscape.operators import metrics, sequence

    scores = spark.range(500).selectExpr("id / 500.0 AS score", "CAST(id % 2 AS INT) AS y")
    assert metrics.precision_recall_curve(scores).count() == 500
    assert metrics.precision_recall_curve(scores, max_points=50).count() == 50
    report = spark.createDataFrame([(0, i, True, f"m{i:02d}") for i in range(25)], "scan int, row_no int, is_top boolean, name string")
    z = report.selectExpr("scan", "name", "CAST(-row_no AS DOUBLE) AS zscore")
    assert sequence.choose_cofactors(report, z, n=20).count() == 20
