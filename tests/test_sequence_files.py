import numpy as np
import pytest

from bindscape.operators import normalize as nm, sequence as sq
from bindscape.sources import readers as rd, writers as wr


def _pieces(seqs, size, before, after):
    out = []
    for chrom, seq in seqs:
        for c in range(0, max(len(seq), 1), size):
            lead = min(c, before)
            out.append((chrom, len(seq), c, lead, seq[c - lead : c + size + after]))
    return sorted(out)


def _got(chunks):
    return sorted(tuple(r) for r in chunks.select("chrom", "length", "chunk_start", "lead", "seq").collect())


@pytest.mark.parametrize("hot", [False, True])
def test_fasta_lines_across_blocks(spark, tmp_path, monkeypatch, hot):
    """Ranges across line and file-block borders equal those of a plain read."""
    if hot:
        monkeypatch.setattr("bindscape.functions.prefix.BROADCAST_ROWS", 0)
    rng = np.random.default_rng(8)
    one = [("big", "".join(rng.choice(list("ACGTNacgt"), 20_011))), ("none", ""), ("x1", "AC"), ("tail", "".join(rng.choice(list("ACGT"), 907)))]
    two = [("big", "".join(rng.choice(list("ACGT"), 3_000)))]
    text = "before any header\n"
    for i, (chrom, seq) in enumerate(one):
        width = (61, 60, 60, 1)[i]
        text += f">{chrom} some > note\n" + "".join(seq[j : j + width] + ("\r\n" if i == 3 else "\n") for j in range(0, len(seq), width)) + "\n"
    (tmp_path / "one.fa").write_text(text)
    (tmp_path / "two.fa").write_text(f">{two[0][0]}\n{two[0][1]}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = rd.read_fasta_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20
        for size, lead, after in ((100, 10, 20), (64, 70, 200), (50_000, 0, 0)):
            assert _got(sq.chunk_sequences(lines, size=size, before=lead, after=after)) == _pieces(one + two, size, lead, after)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_written_fasta(spark, tmp_path):
    seqs = [("a", "ACGT" * 30), ("b", "A" * 61), ("c", "")]
    wr.write_fasta(spark.createDataFrame(seqs, "chrom string, seq string"), str(tmp_path / "f"))
    assert _got(sq.chunk_sequences(rd.read_fasta_lines(spark, str(tmp_path / "f")), size=50, before=5, after=7)) == _pieces(seqs, 50, 5, 7)
    assert max(len(r.line) for r in rd.read_fasta_lines(spark, str(tmp_path / "f")).collect()) == 60
    (tmp_path / "empty.fa").write_text("")
    assert _got(sq.chunk_sequences(rd.read_fasta_lines(spark, str(tmp_path / "empty.fa")), size=50, before=5, after=7)) == []


@pytest.mark.parametrize("width, step, count", [(200, 50, 3), (200, 60, 3), (7, 3, 3), (6, 6, 2), (12, 4, 4)])
def test_window_best(width, step, count):
    scores = np.round(np.random.default_rng(1).normal(size=(3, 731)), 1)
    bins = (731 - width) // step + 1
    got = np.sort(sq.window_best(scores, bins, width, step, count), axis=2)
    want = np.array([[np.sort(row[i * step : i * step + width])[-count:] for i in range(bins)] for row in scores])
    assert (got == want).all()


@pytest.mark.parametrize("shuffled", [False, True])
def test_large_motif_library(spark, monkeypatch, shuffled):
    """2,000 matrices of lengths 3 to 9: every motif and bin as one matrix alone gives it."""
    if shuffled:
        monkeypatch.setattr(sq, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    mats = {f"m{i:04d}": np.round(rng.normal(size=(3 + i % 7, 4)), 2) for i in range(2000)}
    rows = [(m, p, *map(float, w)) for m, mat in mats.items() for p, w in enumerate(mat)]
    pwms = spark.createDataFrame(rows, "motif string, pos int, a double, c double, g double, t double")
    seq = "".join(rng.choice(list("ACGT"), 420))
    df = spark.createDataFrame([("s", seq)], "chrom string, seq string")
    got = {(r.motif, r.start): r.top for r in sq.motif_top_scores(df, pwms, chunk_bins=2).collect()}
    assert len(got) == 2000 * 5
    codes = np.array(["ACGT".index(b) for b in seq])
    for m in list(mats)[::97]:
        padded = np.zeros((9, 4))
        low = (9 - len(mats[m])) // 2
        padded[low : low + len(mats[m])] = mats[m]
        both = []
        for rev in (False, True):
            x = np.concatenate([np.zeros(4, int), 3 - codes if rev else codes])
            w = padded[::-1] if rev else padded
            both.append(np.array([sum(w[j, x[i + j]] for j in range(9)) for i in range(len(seq) - 9 + 1)]))
        for start in range(0, 221, 50):
            want = np.zeros(4)
            if start + 200 <= len(both[0]):
                want = np.sort(np.concatenate([np.sort(s[start : start + 200])[-3:] for s in both]))[::-1][:4]
            assert np.allclose(got[m, start], want, atol=1e-5), (m, start)


def test_chosen_motifs_are_padded_like_the_library(spark):
    rows = [("long", p, 1.0, 0.0, 0.0, 0.5) for p in range(9)] + [("short", p, 0.0, 1.0, 2.0, 0.0) for p in range(4)]
    pwms = spark.createDataFrame(rows, "motif string, pos int, a double, c double, g double, t double")
    df = spark.createDataFrame([("s", "ACGGTTAC" * 60)], "chrom string, seq string")
    whole = sq.motif_top_scores(df, pwms).where("motif = 'short'")
    chosen = sq.motif_top_scores(df, pwms, motifs=spark.createDataFrame([("short",)], "motif string"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, chosen.collect()))
    assert sq.motif_top_scores(df, pwms.limit(0)).count() == 0


def test_gram_matrix_far_from_zero(spark):
    """One pass keeps what a product about zero would lose, over tasks of unequal means."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) + 1e8 + np.repeat([[0, 5, 9]], 400, axis=0)
    x[200:] += 3
    side = ["a" if i % 3 else "b" for i in range(400)]
    df = spark.createDataFrame([(s, v.tolist()) for s, v in zip(side, x)], "side string, features array<double>").repartition(5)
    got = {(r.a, r.b): r for r in nm.gram_matrix(df, 3).collect()}
    d = x - x.mean(0)
    assert np.allclose([[got[a, b].sxy for b in range(3)] for a in range(3)], d.T @ d, rtol=1e-6)
    assert {r.n for r in got.values()} == {400}
    for r in nm.gram_matrix(df, 3, by="side").collect():
        part = d[np.array(side) == r.side]
        assert r.n == len(part)
        assert np.allclose([r.sx, r.sy, r.sxy], [part[:, r.a].sum(), part[:, r.b].sum(), part[:, r.a] @ part[:, r.b]], rtol=1e-5, atol=1e-5)
    assert nm.gram_matrix(df.limit(0), 3).count() == 0


def test_scan_gives_arrays_to_spark_and_skips_missing_sequences(spark):
    df = spark.createDataFrame([("a", "ACGTNACGTA"), ("b", None), ("c", "AC"), (None, "ACGT")], "chrom string, seq string")
    pwms = spark.createDataFrame(
        [("m", i, 1.0 * i, 2.0, 3.0, 4.0) for i in range(3)] + [("n", 0, 1.0, 5.0, 0.0, 0.0)],
        "motif string, pos int, a double, c double, g double, t double")
    got = sq.pwm_scan(df, pwms, chunk=4)
    assert "posexplode" in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert len({(r.chrom, r.motif, r.pos) for r in rows}) == len(rows) == 2 * 8 + 2 * 2
    whole = {(r.chrom, r.motif, r.pos, r.score) for r in sq.pwm_scan(df, pwms).collect()}
    assert whole == {tuple(r) for r in rows}
    top = sq.motif_top_scores(df, pwms, width=4, step=2).collect()
    assert {r.chrom for r in top} == {"a", None} and all(len(r.top) == 4 for r in top)
