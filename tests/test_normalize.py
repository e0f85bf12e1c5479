import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.functions.session import settle
from bindscape.operators import normalize as nm, stats as st


def _qt(x, train, n_quantiles):
    q = np.quantile(train, np.linspace(0, 1, min(n_quantiles, len(train))))
    ref = np.linspace(0, 1, len(q))
    y = 0.5 * (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1]))
    y[x >= q[-1]] = 1
    y[x <= q[0]] = 0
    return y


def test_quantile_transform(spark, both_paths):
    rng = np.random.default_rng(0)
    cols = {0: rng.normal(size=60), 1: np.round(rng.normal(size=60), 1), 2: np.full(60, 3.0)}
    rows = [("c", i, f, float(v[i])) for f, v in cols.items() for i in range(60)]
    df = spark.createDataFrame(rows, "chrom string, start bigint, feature_idx int, value double")
    fitted = settle(nm.fit_quantiles(df, n_quantiles=20))
    # values outside the fitted range clamp to 0 and 1
    more = df.unionByName(spark.createDataFrame([("c", 60, 0, 99.0), ("c", 61, 0, -99.0)], df.schema))
    out = nm.apply_quantiles(more, fitted, name="q").collect()
    for f, v in cols.items():
        got = [r.q for r in sorted(out, key=lambda r: r.start) if r.feature_idx == f and r.start < 60]
        assert np.allclose(got, _qt(v, v, 20)), f
    assert {r.start: r.q for r in out if r.start >= 60} == {60: 1.0, 61: 0.0}


def test_transform_of_nan_and_null_keys(spark, both_paths):
    nan = float("nan")
    rows = [("c", i, None, v) for i, v in enumerate([1.0, 2.0, 3.0, nan, None])]
    df = spark.createDataFrame(rows, "chrom string, start bigint, feature_idx int, value double")
    out = [r.value for r in nm.fit_apply(df, by=["feature_idx"]).orderBy("start").collect()]
    assert out == [0.0, 0.5, 1.0, None, None]


def test_transform_keeps_zeros(spark):
    x = [0.0, 0.0, 1.0, 2.0, 4.0]
    df = spark.createDataFrame([("c", i, 0, v) for i, v in enumerate(x)], "chrom string, start bigint, feature_idx int, value double")
    out = [r.value for r in nm.fit_apply(df, by=["feature_idx"], skip_zero=True).orderBy("start").collect()]
    assert out == [0.0, 0.0, 0.0, 0.5, 1.0]


def test_rank_map(spark, both_paths):
    rng = np.random.default_rng(1)
    s, r = rng.permutation(50), rng.normal(size=50)
    a = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(s)], "chrom string, start bigint, value double")
    b = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(r)], "chrom string, start bigint, ref_value double")
    got = [x.qt for x in nm.qt_to_reference(a, b).orderBy("start").collect()]
    assert np.allclose(got, np.sort(r)[s.argsort().argsort()])


def test_segments(spark, both_paths):
    ids = [".", "p1,p2", "p1", "p3", ".", "0", "p3"] * 4
    df = spark.createDataFrame([("c", i * 50, v) for i, v in enumerate(ids)], "chrom string, start bigint, cp_id string")
    want, old, k = [], "0", 0
    for v in ids:
        new = ("0" if v == "." else v).split(",")[0]
        k, old = k + (new != old), new
        want.append(k)
    assert [r.segment for r in nm.run_segments(df).orderBy("start").collect()] == want


def test_correlations_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5))
    x[:, 4] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    got = {(r.a, r.b): r.r for r in nm.column_correlations(df, 5).collect()}
    want = np.round(np.corrcoef(x[:, :4].T), 3)
    assert all(got[(a, b)] == pytest.approx(want[a, b], abs=1e-3) for a in range(4) for b in range(4))
    assert got[(4, 0)] is None


def _blend(raw, sqt, ref, q, r_min):
    def corr(a, b):
        with np.errstate(all="ignore"):
            v = np.round(np.corrcoef(a, b)[0, 1], 3)
        return max(0.0 if np.isnan(v) else v, 0.0)

    r = np.array([corr(sqt, ref[:, k]) for k in range(ref.shape[1])])
    cut = np.quantile(r, q)
    used = (r > cut) & (r > r_min)
    if not used.any():
        used = r > cut
    out = sqt.copy()
    if used.any():
        out = sqt * np.mean(1 - r[used]) + ref[:, used] @ r[used] / used.sum()
    out[raw == 0] = 0
    return out


def test_knn_blend(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for seg in range(4):
        ref = rng.uniform(0, 5, size=(12, 6))
        raw = np.round(ref[:, seg] + rng.uniform(0, 2, 12), 2)
        raw[0] = 0.0
        sqt = raw * 1.5 + 0.1
        if seg == 3:
            sqt[:] = 2.0
        out = _blend(raw, sqt, ref, 0.8, 0.6)
        for i in range(12):
            rows.append((seg, seg * 100 + i, float(raw[i]), float(sqt[i]), ref[i].tolist()))
            want[seg * 100 + i] = out[i]
    df = spark.createDataFrame(rows, "segment int, start bigint, raw double, sqt double, panel array<double>")
    out = nm.knn_blend(df, raw="raw", normed="sqt", panel="panel", n_panel=6, q=0.8).collect()
    assert len(out) == 48
    assert all(r.blend == pytest.approx(want[r.start], abs=0.0051) for r in out)


def test_spline_removes_trend(spark):
    rng = np.random.default_rng(4)
    t = rng.uniform(1, 50, 300)
    r = 3 * t**0.8
    df = spark.createDataFrame([("c", i, float(a), float(b), True) for i, (a, b) in enumerate(zip(r, t))], "chrom string, start bigint, ref double, tar double, common boolean")
    out = nm.spline_normalize(df, ref="ref", target="tar", common="common").collect()
    assert np.median([abs(x.normed / x.ref - 1) for x in out]) < 0.01


def test_domain_shift(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(30, 3)) @ np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]])
    rows = [("a", v.tolist()) for v in a] + [("b", v.tolist()) for v in b]
    got = st.domain_shift(spark.createDataFrame(rows, "side string, features array<double>"), 3).first().fro_norm
    z = lambda m: (m - m.mean(0)) / m.std(0)
    assert got == pytest.approx(np.linalg.norm(np.cov(z(a).T) - np.cov(z(b).T)))


def test_common_rows(spark):
    flags = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 0), (3, 1), (3, 0)], "id int, significant int")
    out = {r.id: (r.common_peak, r.common_background) for r in st.common_rows(flags, ["id"], q=0.95).collect()}
    assert out == {1: (True, False), 2: (False, True), 3: (False, False)}


def test_chimera(spark):
    def row(s, start, x):
        return (s, "c", start, [float(x)] * 40)

    tensor = spark.createDataFrame(
        [row(9, i * 50, v) for i, v in enumerate([1, 2, 3, 9, 5, 1])]
        + [row(1, i * 50, v) for i, v in enumerate([2, 4, 6, 0, 1, 2])]
        + [row(2, i * 50, v) for i, v in enumerate([3, 2, 1, 18, 10, 2])],
        "sample_id int, chrom string, start bigint, features array<double>",
    )
    labels = tensor.select("sample_id", "chrom", "start", F.concat(F.lit("L"), "sample_id").alias("label"))
    segs = tensor.select("chrom", "start", F.floor(F.col("start") / 150).alias("segment")).distinct()
    out = {r.start: r.label for r in nm.chimera(tensor, labels, segs, 9, [1, 2]).collect()}
    assert out == {0: "L1", 50: "L1", 100: "L1", 150: "L2", 200: "L2", 250: "L2"}
