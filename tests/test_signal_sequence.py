import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.operators import sequence as sq, signal as sg
from bindscape.plans.sequence_queries import MOTIFS


def test_alignment_flags(spark):
    flags = [0, 16, 4, 8, 256, 512, 1024, 1024 + 16]
    df = spark.createDataFrame([("c", i, f, 30) for i, f in enumerate(flags)] + [("c", 99, 0, 29)], "chrom string, pos bigint, flag int, mapq int")
    out = {r.pos: r.strand for r in sg.with_strand(sg.keep_alignments(df)).collect()}
    assert out == {0: "forward", 1: "reverse"}


@pytest.mark.parametrize("edges", ["variable", "50", "100"])
def test_cut_profile_matches_histogram(spark, edges):
    rng = np.random.default_rng(0)
    cuts = {s: sorted(set(rng.integers(0, 3000, 120).tolist())) for s in ("forward", "reverse")}
    rows = [("c", p, s) for s, ps in cuts.items() for p in ps]
    df = spark.createDataFrame(rows + rows[:5], "chrom string, pos bigint, strand string")
    sizes = spark.createDataFrame([("c", 3000)], "chrom string, length bigint")
    out = sg.cut_profile(df, sizes, edges=edges).collect()
    assert max(r.start for r in out) == 2750  # start + 200 < length
    for r in out:
        want = []
        for s in ("forward", "reverse"):
            off = np.array([p - r.start + 600 for p in cuts[s] if 0 <= p - r.start + 600 < 1400])
            n, marks = np.histogram(off, bins=sg.EDGES[edges])
            want += (n / np.diff(marks)).tolist()
        assert np.allclose(r.features, want)


def test_profile_names(spark):
    names = {r.feature_idx: r.feature_name for r in sg.rename_features(sg.profile_names(spark), prefix="median_").collect()}
    assert len(names) == 48 and names[0] == "median_DNase_5_end_-700_-600_forward" and names[47].endswith("600_700_reverse")


def test_offsets_clamp(spark):
    df = spark.createDataFrame([("c", i * 50, [float(i), float(-i)]) for i in range(50)], "chrom string, start bigint, features array<double>")
    for block in (4096, 16):
        for r in sg.offset_features(df, [-7, 0, 5], block=block).collect():
            i = r.start // 50
            want = [v for o in (-7, 0, 5) for v in (min(max(i + o, 0), 49), -min(max(i + o, 0), 49))]
            assert r.features == want


def test_profile_rebuild(spark):
    n = 40
    a, b = np.arange(n) * 25.0, np.arange(n) * 50.0
    df = spark.createDataFrame([("c", i * 50, float(a[i]), float(b[i])) for i in range(n)], "chrom string, start bigint, a double, b double")
    out = {r.start // 50: r.profile for r in sg.profile_from_centre(df, "a", "b").collect()}
    c12, c13 = a / 25, b / 25
    x50 = (c12 + c13) / 2
    mid = out[20]
    assert mid[12] == c12[20] and mid[13] == c13[20] and mid[14] == c12[21] and mid[4] == x50[14] and mid[16] == x50[22]
    assert mid[0] == pytest.approx((c12[6] + c13[6] + c12[7] + c13[7]) / 4)
    assert out[0][0] == 0.0 and out[39][23] == 0.0  # nothing wraps around the ends


def test_shares_and_scales(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [4.0, 0.0])], "chrom string, start bigint, features array<double>")
    assert [r.features for r in sg.scale_by_chrom_max(df, "b").orderBy("chrom").collect()] == [[0.25, 0.0], [1.0, 0.0]]
    assert [r.features for r in sg.scale_by_column_max(df, 2).orderBy("chrom").collect()] == [[0.25, 0.0], [1.0, 0.0]]
    bad = spark.createDataFrame([([float("nan"), None, 2.0],)], "features array<double>")
    assert sg.fill_missing(bad).first().features == [0.0, 0.0, 2.0]


def _pwms(spark, names=("m4", "m9")):
    rows = [(m, i, *[float(x) / 4 for x in w]) for m in names for i, w in enumerate(MOTIFS[m])]
    return spark.createDataFrame(rows, "motif string, pos int, a double, c double, g double, t double")


def _scores(seq, mat, reverse, longest):
    pad = longest - len(mat)
    m = np.vstack([np.zeros((pad // 2, 4)), np.array(mat) / 4, np.zeros((pad - pad // 2, 4))])
    code = np.array(["ACGT".index(c if c in "ACGT" else "A") for c in seq.upper()])
    if reverse:
        m, code = m[::-1], 3 - code
    code = np.concatenate([np.zeros(longest // 2, int), code])
    n = len(seq) - longest + 1
    return np.array([sum(m[j, code[p + j]] for j in range(longest)) for p in range(max(n, 0))])


def test_pwm_scan(spark):
    rng = np.random.default_rng(1)
    seqs = {"a": "".join(rng.choice(list("ACGTNacgt"), 137)), "short": "ACG", "b": "ACGT" * 20}
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    for strand in "+-":
        got = {}
        for r in sq.pwm_scan(df, _pwms(spark), strand=strand, chunk=50).collect():
            got.setdefault((r.chrom, r.motif), {})[r.pos] = r.score
        assert {c for c, _ in got} == {"a", "b"}
        for (c, m), by_pos in got.items():
            want = _scores(seqs[c], MOTIFS[m], strand == "-", 9)
            assert sorted(by_pos) == list(range(len(want)))
            assert np.allclose([by_pos[p] for p in range(len(want))], want)


def test_top_scores(spark):
    rng = np.random.default_rng(2)
    seqs = {"a": "".join(rng.choice(list("ACGT"), 655)), "edge": "".join(rng.choice(list("ACGT"), 200)), "tiny": "ACGT"}
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    out = sq.motif_top_scores(df, _pwms(spark), chunk_bins=3).collect()
    assert {(r.chrom, r.start) for r in out} == {("a", 50 * i) for i in range(10)} | {("edge", 0)}
    for r in out:
        both = []
        for rev in (False, True):
            s = _scores(seqs[r.chrom], MOTIFS[r.motif], rev, 9)
            fits = r.start + 200 <= len(s)
            both += sorted(s[r.start : r.start + 200], reverse=True)[:3]
        want = sorted(both, reverse=True)[:4] if fits else [0.0] * 4
        assert np.allclose(r.top, want)


def test_encode(spark):
    df = spark.createDataFrame([("acgtNX",)], "s string").select(sq.encode(F.col("s")).alias("c"))
    assert df.first().c == "012300"
    hot = df.select(sq.one_hot(F.col("c")).alias("h")).first().h
    assert hot[3] == [0, 0, 0, 1] and len(hot) == 6


def test_motif_feature_names(spark):
    names = sq.motif_feature_names(spark.createDataFrame([("x",), ("y",)], "motif string")).orderBy("feature_idx").collect()
    assert len(names) == 9 * 2 * 4 and names[0].feature_name == "x_offset_-7_top_0" and names[4].feature_name == "y_offset_-7_top_0"


def test_profile_mean_counts_absent_cuts(spark):
    """Two samples with one cut each: bins without cuts are zeros in the mean."""
    cuts = spark.createDataFrame([(0, "c", 700, "forward"), (1, "c", 3000, "forward")], "sample_id int, chrom string, pos bigint, strand string")
    sizes = spark.createDataFrame([("c", 6000)], "chrom string, length bigint")
    t = sg.cut_profile(cuts, sizes, by=["sample_id"])
    assert t.groupBy("sample_id").count().select("count").distinct().collect() == [(116,)]
    roles = spark.createDataFrame([(0, "train"), (1, "train")], "sample_id int, role string")
    mean = sg.mean_signal(t, roles, 48)
    assert mean.agg(F.max(F.array_max("features"))).first()[0] == 0.02


def test_neighbours_by_coordinate(spark):
    df = spark.createDataFrame([("c", s, [float(s)]) for s in (0, 50, 300, 350)], "chrom string, start bigint, features array<double>")
    got = {r.start: r.features for r in sg.offset_features(df, (-1, 0, 1), block=2).collect()}
    assert got == {0: [0, 0, 50], 50: [0, 50, 0], 300: [0, 300, 350], 350: [300, 350, 350]}
    one = df.select("chrom", "start", F.element_at("features", 1).alias("x"))
    got = {r.start: r.y for r in sg.shifted(one, {"y": ("x", 1)}, block=2).collect()}
    assert got == {0: 50, 50: 0, 300: 350, 350: 0}


def test_motif_without_rows_keeps_its_columns(spark):
    top = spark.createDataFrame([("c", 0, "a", [1.0]), ("c", 0, "b", [2.0]), ("c", 50, "b", [3.0])], "chrom string, start bigint, motif string, top array<double>")
    motifs = spark.createDataFrame([("a",), ("b",)], "motif string")
    got = {r.start: r.features for r in sq.motif_features(top, motifs, offsets=(0,)).collect()}
    assert got == {0: [1.0, 2.0], 50: [0.0, 3.0]}
