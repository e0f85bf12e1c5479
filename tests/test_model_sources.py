import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.operators import clusters as cl, model as md, samples as sm
from bindscape.sources import readers as rd, writers as wr


def _rows(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n)) > 0.5).astype(int)
    w = (rng.uniform(size=n) > 0.1).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), int(w[i]), "train" if i % 5 else "valid") for i in range(n)]
    return x, y, w, spark.createDataFrame(rows, "id int, features array<double>, y int, weight int, set_name string")


def test_boosting_follows_the_newton_steps(spark):
    x, y, w, df = _rows(spark)
    model = md.train_boosted(df, rounds=4, depth=3, learning_rate=0.2, min_rows=5, patience=None, settle_every=3)
    model.best_round = 4
    train = np.arange(len(y)) % 5 != 0
    beta = -np.log10(2 * train.sum() / y[train].sum() - 1)
    fit = train & (w > 0)
    f = np.zeros(len(y))
    losses = []
    for tree in model.trees:
        side = 2 * y - 1
        p = 1 / (1 + np.exp(-(beta + side * f)))
        losses.append(-np.log(p[fit]).mean())
        k = 1 - y + side * 0.5
        g, h = k * side * (p - 1), k * (1 - p) * p
        at = tree.leaves(x)
        for leaf in np.unique(at[fit]):
            rows = fit & (at == leaf)
            assert tree.value[leaf] == pytest.approx(-g[rows].sum() / h[rows].sum(), rel=1e-6)
        f += 0.2 * tree.value[at]
    assert losses == sorted(losses, reverse=True)
    got = [r.margin for r in md.score(model, df).orderBy("id").collect()]
    assert np.allclose(got, f)
    leaves = md.leaf_outputs(model, df).orderBy("id").collect()
    assert np.allclose([sum(r.leaves) for r in leaves], f)
    again = md.Booster.from_table(model.to_table(spark), 0.2)
    assert np.allclose(again.margins(x), f)


def test_early_stop_keeps_best_round(spark):
    _, _, _, df = _rows(spark)
    falling = iter([0.5, 0.7, 0.6, 0.65, 0.1, 0.1])
    seen = []
    model = md.train_boosted(
        df, rounds=10, depth=2, patience=2, metric=lambda d: {"valid": next(falling)}, on_round=lambda r, v: seen.append(r)
    )
    assert model.best_round == 2 and seen == [1, 2, 3, 4] and len(model.used()) == 2


def test_importance_finds_the_column(spark):
    _, _, _, df = _rows(spark)
    model = md.train_boosted(df, rounds=5, depth=3, learning_rate=0.3)
    sets = md.importance_blocks(4, half=2)
    out = {r.shuffled: r.auprc for r in md.permutation_importance(model, df, sets, 4, key=["id"]).collect()}
    assert out["none"] == max(out.values()) and out["column_0"] == min(out[f"column_{j}"] for j in range(4))


def test_permuted_columns_keep_their_values(spark):
    x, _, _, df = _rows(spark, n=50)
    out = md.permute_columns(df, 4, key=["id"]).orderBy("id").collect()
    p = np.array([r.permuted for r in out])
    assert not np.allclose(p, x)
    for j in range(4):
        assert np.allclose(np.sort(p[:, j]), np.sort(x[:, j])) and not np.allclose(p[:, j], x[:, j])


def test_clustered_models_cover_all_rows(spark):
    _, _, _, df = _rows(spark)
    far = df.where("id < 100").withColumn("features", F.transform("features", lambda v: v + 50)).withColumn("y", F.lit(0)).withColumn("id", F.col("id") + 1000)
    out = md.clustered_models(df.unionByName(far), df.unionByName(far), 2, rounds=2, depth=2)
    rows = out.collect()
    assert len(rows) == 700 and all(r.margin == -10.0 for r in rows if r.id >= 1000) and any(r.margin != -10.0 for r in rows)


def test_ensemble_and_trials(spark):
    _, _, _, df = _rows(spark)
    out = md.run_trials(df, md.trial_parameters({"depth": [1, 3]}, 3, seed=1), rounds=2)
    assert out.count() == 3 and out.agg(F.max("loss")).first()[0] < 1
    folds = md.cross_validate(sm.fold_column(df.drop("set_name"), 2, key=["id"]), 2, rounds=2, depth=2)
    assert folds.count() == 2


def test_kmeans_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(6, 1, (30, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, features array<double>")
    centres, out = cl.kmeans(df, x[[0, 69]])
    assign = lambda c: np.linalg.norm(x[:, None] - c[None], axis=2)
    steps = [x[[0, 69]]]
    for _ in range(20):
        near = assign(steps[-1]).argmin(1)
        steps.append(np.array([x[near == k].mean(0) for k in range(2)]))
    cost = [assign(c).min(1).mean() for c in steps]
    done = next(i for i in range(1, 20) if abs(cost[i] - cost[i - 1]) <= 1e-3 * cost[i - 1])
    c, near = steps[done], assign(steps[done]).argmin(1)
    assert np.allclose(centres, c)
    assert [r.cluster for r in out.orderBy("id").collect()] == near.tolist()
    _, two = cl.kmeans_two_pass(df, 2, key=["id"])
    assert two.count() == 70


def test_sampling(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "id int")
    a = [r.id for r in sm.sample_rows(df, 50, key=["id"], replace=False).collect()]
    assert len(set(a)) == 50
    b = sm.sample_rows(df.repartition(5), 500, key=["id"]).collect()
    assert len(b) == 500 and {r.draw for r in b} == set(range(500))
    s = sm.shuffle_column(df.withColumn("v", F.col("id")), "v", key=["id"]).collect()
    assert sorted(r.v for r in s) == list(range(200)) and all(r.v != r.id for r in s)


def test_sample_choice(spark):
    meta = spark.createDataFrame(
        [(1, "HepG2", "e", "l", 0.9, "X"), (2, "none", "B", "Blood", 0.5, "X"), (3, "HEPG2", "e", "l", 0.05, "X"), (4, "hepg2", "e", "l", 0.4, "Y")],
        "sample_id int, line string, kind string, tissue string, quality double, factor string",
    )
    cells = spark.createDataFrame([("train", "HepG2"), ("test", "NONE_b_blood")], "role string, cell string")
    out = sm.select_samples(meta, cells, spark.createDataFrame([(1,), (2,), (3,)], "sample_id int")).collect()
    assert sorted((r.sample_id, r.role) for r in out) == [(1, "train"), (2, "test")]
    assert sm.select_chip(meta, "Y", "HepG2").first().weight == 2


def test_file_formats(spark, tmp_path):
    (tmp_path / "pwm").mkdir()
    (tmp_path / "pwm" / "CTCF.pwm").write_text(">CTCF\n0.1\t0.2\t0.3\t0.4\n1\t2\t3\t4\n")
    (tmp_path / "pwm" / "other").write_text("# note\n5\t6\t7\t8\n")
    got = sorted(tuple(r) for r in rd.read_pwms(spark, str(tmp_path / "pwm")).collect())
    assert got == [("CTCF", 0, 0.1, 0.2, 0.3, 0.4), ("CTCF", 1, 1.0, 2.0, 3.0, 4.0), ("other", 0, 5.0, 6.0, 7.0, 8.0)]
    (tmp_path / "g.fa").write_text(">chr1 first\nACGT\nAC\n>chr2\nNN\n")
    assert sorted(tuple(r) for r in rd.read_fasta(spark, str(tmp_path / "g.fa")).collect()) == [("chr1", "ACGTAC"), ("chr2", "NN")]
    (tmp_path / "list.json").write_text(json.dumps(["a", "b"]))
    assert [r.item for r in rd.read_json_list(spark, str(tmp_path / "list.json")).collect()] == ["a", "b"]
    (tmp_path / "77_sort_summits.bed").write_text("c\t5\t6\tn\t2.5\nc\t1\t2\tn\t9\n")
    rows = rd.read_peaks(spark, str(tmp_path / "77_sort_summits.bed"), "summit").orderBy("file_rank").collect()
    assert [(r.sample_id, r.start, r.score, r.file_rank) for r in rows] == [("77", 1, 9.0, 1), ("77", 5, 2.5, 2)]
    rows = rd.read_peaks(spark, str(tmp_path / "77_sort_summits.bed"), "summit", rank_by="file").orderBy("file_rank").collect()
    assert [(r.start, r.file_rank) for r in rows] == [(5, 1), (1, 2)]
    line = "\t".join(f"v{i}" if i != 27 else "0.5" for i in range(1, 30))
    (tmp_path / "meta.tsv").write_text("\t".join(f"h{i}" for i in range(1, 30)) + "\n" + line + "\n")
    m = rd.read_positional(spark, str(tmp_path / "meta.tsv"), rd.ACCESSIBILITY_COLUMNS).first()
    assert (m.sample_id, m.line, m.quality) == ("v1", "v7", 0.5)
    (tmp_path / "sizes").write_text("c\t900\n")
    assert rd.read_sizes(spark, str(tmp_path / "sizes")).first().length == 900
    (tmp_path / "clusters.csv").write_text("sample,cluster,Tissue,celltypes,celllines,included,annotation\ns1,3,Liver,a,b,Y,note\n")
    assert rd.read_clusters(spark, str(tmp_path / "clusters.csv")).first().cluster == 3


def test_written_files_read_back(spark, tmp_path):
    lab = spark.createDataFrame([("c", 0, 200, "x", "B"), ("c", 50, 250, "y", "A")], "chrom string, start bigint, stop bigint, cell_type string, label string")
    wr.write_labels(lab, str(tmp_path / "lab"), ["x", "y"])
    back = {(r.start, r.cell_type): r.label for r in rd.read_labels(spark, str(tmp_path / "lab")).collect()}
    assert back == {(0, "x"): "B", (0, "y"): "U", (50, "x"): "U", (50, "y"): "A"}
    m = spark.createDataFrame([("c", 0, 200, 1.236), ("d", 50, 250, -0.5)], "chrom string, start bigint, stop bigint, margin double")
    wr.write_margins(m, str(tmp_path / "m"))
    assert sorted((r.chrom, r.margin) for r in rd.read_margins(spark, str(tmp_path / "m")).collect()) == [("c", 1.24), ("d", -0.5)]
    wr.write_report(m, str(tmp_path / "r"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "r")).count() == 2
