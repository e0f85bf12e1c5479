"""Training, scoring and clustering queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bindscape.functions.hashing import hash_below
from bindscape.functions.session import settle, spread
from bindscape.operators import clusters as cl, model as md, samples as sm, stats as st
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
NF = 8
FAST = dict(rounds=3, depth=4, learning_rate=0.3)


def rows(spark, sf):
    """Lineitem as labelled feature rows: price and date features, returnflag labels."""
    # training passes over these rows many times: spread a single input file first
    li = spread(v.table(spark, sf, "lineitem"), *KEY)
    feats = F.array(
        F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100,
        F.year("l_shipdate").cast("double"), F.month("l_shipdate").cast("double"),
        F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 50).cast("double"),
    )
    label = F.when(F.col("l_returnflag") == "R", "B").when(F.col("l_returnflag") == "A", "A").otherwise("U")
    out = li.select(*KEY, feats.alias("features"), label.alias("label"))
    out = out.withColumn("y", (F.col("label") == "B").cast("int")).withColumn("weight", (F.col("label") != "A").cast("int"))
    return out.withColumn("set_name", F.when(hash_below(2019, 20, *KEY), "valid").otherwise("train"))


GRAD = "SELECT l_orderkey, l_linenumber, margin AS f, CAST(label='B' AS INTEGER)*1.0 AS y FROM scored_labels"


def _grads(spark, sf, objective):
    df = v.scored_labels(spark, sf).withColumn("y", (F.col("label") == "B").cast("double"))
    g, h = objective(F.col("margin"), F.col("y"))
    return df.select("l_orderkey", "l_linenumber", (F.round(g, 6) + 0.0).alias("grad"), F.round(h, 6).alias("hess"))


@query(sql("""SELECT l_orderkey, l_linenumber, round((1-y+(2*y-1)*0.5)*(2*y-1)*(p-1), 6)+0.0 AS grad, round((1-y+(2*y-1)*0.5)*1.0*(1-p)*p, 6) AS hess
    FROM (SELECT *, 1/(1+exp(-(-0.7+(2*y-1)*f))) AS p FROM g)""", g=GRAD))
def focal_gradients(spark, sf):
    return _grads(spark, sf, md.focal_isoform(0.5, -0.7, 1.0))


@query(sql("""SELECT l_orderkey, l_linenumber, round((1+(3.0-1)*y)*(2*y-1)*(p-1), 6)+0.0 AS grad, round((1+(3.0-1)*y)*2.0*(1-p)*p, 6) AS hess
    FROM (SELECT *, 1/(1+exp(-((2*y-1)*2.0*f))) AS p FROM g)""", g=GRAD))
def focal_positive_gradients(spark, sf):
    return _grads(spark, sf, md.focal_positive(3.0, 0.0, 2.0))


@query(sql("""SELECT l_orderkey, l_linenumber, round(4.0*p*y+p-5.0*y, 6)+0.0 AS grad, round((4.0*y+1)*p*(1-p), 6) AS hess
    FROM (SELECT *, 1/(1+exp(-f)) AS p FROM g)""", g=GRAD))
def imbalance_gradients(spark, sf):
    return _grads(spark, sf, md.imbalance_logistic(5.0))


TS = {
    # samples in pairs: two feature tables over the chromosomes of each pair
    "one": "SELECT chrom || '_' || CAST(sample_id//2 AS VARCHAR) AS chrom, start, features FROM tensor WHERE sample_id%2=0",
    "two": "SELECT chrom || '_' || CAST(sample_id//2 AS VARCHAR) AS chrom, start, features FROM tensor WHERE sample_id%2=1",
    "la": "SELECT chrom, start, CASE features[1]%3 WHEN 0 THEN 'U' WHEN 1 THEN 'B' ELSE 'A' END AS label FROM one",
    "lbl": "SELECT chrom, start, CASE features[2]%3 WHEN 0 THEN 'U' WHEN 1 THEN 'B' ELSE 'A' END AS label FROM one",
}


@query(sql("""SELECT la.chrom, la.start, la.label, CAST(la.label='B' AS INTEGER) AS y, CAST(la.label<>'A' AS INTEGER) AS weight,
    round(list_sum(one.features) + list_sum(two.features)*1.0/m.m, 6) AS total FROM la JOIN lbl ON la.chrom=lbl.chrom AND la.start=lbl.start AND la.label=lbl.label
    JOIN one ON one.chrom=la.chrom AND one.start=la.start JOIN two ON two.chrom=la.chrom AND two.start=la.start
    CROSS JOIN (SELECT max(list_max(features)) AS m FROM two WHERE chrom='chr2_0') m""", **TS))
def training_set_assembly(spark, sf):
    t = settle(v.tensor(spark, sf))
    as_double = F.transform("features", lambda x: x.cast("double"))
    pair = F.concat("chrom", F.lit("_"), F.floor(F.col("sample_id") / 2).cast("string")).alias("chrom")
    one = t.where("sample_id % 2 = 0").select(pair, "start", as_double.alias("features"))
    two = t.where("sample_id % 2 = 1").select(pair, "start", as_double.alias("features"))

    def labels(i):
        r = F.get("features", F.lit(i)) % 3
        return one.select("chrom", "start", F.when(r == 0, "U").when(r == 1, "B").otherwise("A").alias("label"))

    out = md.training_set(one, two, labels(0), labels(1), chroms=[f"chr{c}_{k}" for c in (2, 1) for k in range(5)], scale_chrom="chr2_0")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return out.select("chrom", "start", "label", "y", "weight", F.round(total, 6).alias("total"))


@query()
def boosted_margins(spark, sf):
    df = settle(rows(spark, sf))
    model = md.train_boosted(df, **{**FAST, "depth": None})  # 63 leaves, as deep as they come
    return md.score(model, df).select(*KEY, "set_name", F.round("margin", 2).alias("margin"))


@query()
def boosting_history(spark, sf):
    """Average precision per round of two validation sets, with early stopping."""
    df = rows(spark, sf).withColumn(
        "set_name", F.when(F.col("set_name") == "valid", F.concat(F.lit("valid_"), (F.col("l_suppkey") % 2).cast("string"))).otherwise("train")
    )
    model = md.train_boosted(df, patience=2, **{**FAST, "rounds": 4})
    return spark.createDataFrame(model.history, "round int, set_name string, auprc double")


@query()
def boosted_tree_table(spark, sf):
    return md.train_boosted(rows(spark, sf), **FAST).to_table(spark)


@query()
def warm_started_margins(spark, sf):
    df = settle(rows(spark, sf))
    first = md.train_boosted(df, **{**FAST, "rounds": 2})
    again = md.train_boosted(md.score(first, df, name="old_margin"), init_margin="old_margin", **{**FAST, "rounds": 2})
    out = md.score(again, md.score(first, df, name="old_margin"))
    return out.select(*KEY, F.round(F.col("margin") + F.col("old_margin"), 4).alias("margin"))


@query()
def tree_leaf_outputs(spark, sf):
    df = settle(rows(spark, sf))
    model = md.train_boosted(df, **FAST)
    return md.leaf_outputs(model, df).select(*KEY, F.transform("leaves", lambda x: F.round(x, 6)).alias("leaves"))


@query()
def leaf_domain_shift(spark, sf):
    df = settle(rows(spark, sf))
    model = md.train_boosted(df, **FAST)
    out = md.leaf_outputs(model, df, name="leaves").withColumn("side", F.when(F.col("l_suppkey") % 2 == 0, "source").otherwise("target"))
    return st.domain_shift(out, len(model.used()), features="leaves")


@query()
def ensemble_margins(spark, sf):
    """Two models (trained on different halves) scored over all rows."""
    df = settle(rows(spark, sf))
    models = {
        f"half_{i}": md.train_boosted(df.where(F.col("l_suppkey") % 2 == i), **{**FAST, "rounds": 2}) for i in range(2)
    }
    return md.ensemble_score(models, df, KEY).select(*KEY, "model_id", F.round("margin", 4).alias("margin"))


@query()
def ablation_scores(spark, sf):
    """Signal-only and motif-only models: average precision on the hold-out rows."""
    df = settle(rows(spark, sf))
    parts = {"signal_only": (1, 4), "motif_only": (5, 4)}
    out = []
    for name, (a, n) in parts.items():
        d = df.withColumn("features", F.slice("features", a, n))
        model = md.train_boosted(d, **{**FAST, "rounds": 2})
        out += [(name, r, value) for r, _, value in model.history]
    return spark.createDataFrame(out, "family string, round int, auprc double")


@query()
def permutation_importance(spark, sf):
    df = settle(rows(spark, sf))
    model = md.train_boosted(df, **FAST)
    sets = md.importance_blocks(NF, half=2, block=2, first=4)
    out = md.permutation_importance(model, df.where("set_name = 'valid'"), sets, NF, key=KEY)
    return out.withColumn("auprc", F.round("auprc", 6))


@query()
def clustered_model_margins(spark, sf):
    df = settle(rows(spark, sf))
    out = md.clustered_models(df, df.where("set_name = 'valid'"), 2, **{**FAST, "rounds": 2})
    return out.select(*KEY, "cluster", F.round("margin", 4).alias("margin"))


@query()
def self_prediction_margins(spark, sf):
    """A model scores the rows it was trained on."""
    df = settle(rows(spark, sf)).where("set_name = 'train'")
    return md.score(md.train_boosted(df, **{**FAST, "rounds": 2, "patience": None}), df).select(*KEY, F.round("margin", 2).alias("margin"))


@query()
def chrom_set_margins(spark, sf):
    """Two sets: each is scored by the model of the other."""
    df = settle(rows(spark, sf).withColumn("part", F.col("l_orderkey") % 2))
    out = [md.score(md.train_boosted(df.where(F.col("part") != k), **{**FAST, "rounds": 2}), df.where(F.col("part") == k)) for k in (0, 1)]
    return out[0].unionByName(out[1]).select(*KEY, "part", F.round("margin", 2).alias("margin"))


@query()
def clustered_cross_set_margins(spark, sf):
    """Local models of one set score the rows of the other."""
    df = settle(rows(spark, sf).withColumn("part", F.col("l_orderkey") % 2))
    out = md.clustered_models(df.where("part = 0").drop("part"), df.where("part = 1").drop("part"), 2, **{**FAST, "rounds": 2})
    return out.select(*KEY, "cluster", F.round("margin", 4).alias("margin"))


@query()
def cross_validated_metric(spark, sf):
    df = sm.fold_column(rows(spark, sf).drop("set_name"), 3, key=KEY)
    return md.cross_validate(settle(df), 3, **{**FAST, "rounds": 2})


@query()
def parameter_trials(spark, sf):
    trials = md.trial_parameters({"depth": [2, 3, 4], "learning_rate": [0.1, 0.3]}, 2, seed=7)
    return md.run_trials(settle(rows(spark, sf)), trials, rounds=2, patience=2)


@query(sql("""SELECT t.sample_id, t.chrom, t.start, CAST(l.features[1]>10 AS INTEGER) AS y, len(t.features) AS n FROM tensor t
    JOIN tensor l ON l.sample_id=0 AND l.chrom=t.chrom AND l.start=t.start"""))
def stacked_replicates(spark, sf):
    t = v.tensor(spark, sf)
    label = F.when(F.get("features", F.lit(0)) > 10, "B").otherwise("U")
    # one label table for all replicates of a bin: sample 0's
    labels = t.where("sample_id = 0").select("chrom", "start", label.alias("label"))
    out = md.stack_replicates(t, labels)
    return out.select("sample_id", "chrom", "start", "y", F.size("features").cast("bigint").alias("n"))


def _centres(spark, sf, k=4):
    rows_ = v.tensor(spark, sf).where("start = 0 AND chrom = 'chr1'").orderBy("sample_id").limit(k).collect()
    return np.array([r["features"] for r in rows_], dtype=float)


_CEN = {"cen": "SELECT row_number() OVER (ORDER BY sample_id)-1 AS c, features AS cf FROM (SELECT * FROM tensor WHERE start=0 AND chrom='chr1' ORDER BY sample_id LIMIT 4)"}


def _dist_sql(expr):
    return f"SELECT sample_id, chrom, start, CAST(c AS INTEGER) AS c, round({expr}, 5) AS d FROM tensor CROSS JOIN cen"


_EUC = "sqrt(list_sum(list_transform(list_zip(features, cf), lambda p: (p[1]-p[2])*(p[1]-p[2]))))"
_LQ = "list_avg(list_transform(list_zip(features, cf), lambda p: sqrt(abs(p[1]-p[2]))))"


@query(sql(_dist_sql(_EUC), **_CEN))
def distance_matrix(spark, sf):
    out = cl.distances(v.tensor(spark, sf), _centres(spark, sf))
    return out.select("sample_id", "chrom", "start", F.posexplode("distances").alias("c", "d")).withColumn("d", F.round("d", 5))


@query(sql(_dist_sql(_LQ), **_CEN))
def lq_distance_matrix(spark, sf):
    out = cl.distances(v.tensor(spark, sf), _centres(spark, sf), metric="lq")
    return out.select("sample_id", "chrom", "start", F.posexplode("distances").alias("c", "d")).withColumn("d", F.round("d", 5))


@query(sql(f"SELECT sample_id, chrom, start, CAST(c AS INTEGER) AS cluster, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom, start ORDER BY d, c) AS r FROM (SELECT *, {_EUC} AS d FROM tensor CROSS JOIN cen)) WHERE r=1", **_CEN))
def nearest_centre(spark, sf):
    out = cl.nearest_centre(v.tensor(spark, sf), _centres(spark, sf))
    return out.select("sample_id", "chrom", "start", "cluster", F.round("distance", 5).alias("distance"))


@query()
def kmeans_clusters(spark, sf):
    df = settle(v.tensor(spark, sf))
    _, out = cl.kmeans(df, _centres(spark, sf), max_iter=10)
    return out.select("sample_id", "chrom", "start", "cluster", F.round("distance", 4).alias("distance"))


@query()
def kmeans_two_pass(spark, sf):
    df = settle(v.tensor(spark, sf))
    _, out = cl.kmeans_two_pass(df, 3, key=["sample_id", "chrom", "start"], metric="correlation", max_iter=8)
    return out.select("sample_id", "chrom", "start", "cluster", F.round("distance", 4).alias("distance"))


@query(sql(f"""SELECT cluster, CAST(i AS BIGINT) AS q_idx, round(quantile_cont(d, 0.5), 4) AS radius FROM near CROSS JOIN (SELECT 0 AS i) GROUP BY ALL
    UNION ALL SELECT cluster, CAST(1 AS BIGINT), round(quantile_cont(d, 0.9), 4) FROM near GROUP BY cluster""",
           near=f"SELECT CAST(c AS INTEGER) AS cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom, start ORDER BY d, c) AS r FROM (SELECT *, {_EUC} AS d FROM tensor CROSS JOIN cen)) WHERE r=1", **_CEN))
def cluster_radius(spark, sf):
    out = cl.radius_percentiles(cl.nearest_centre(v.tensor(spark, sf), _centres(spark, sf)))
    return out.withColumn("radius", F.round("radius", 4))


@query()
def segment_profile_reduction(spark, sf):
    df = v.tensor(spark, sf).select(
        "sample_id", "chrom", "start", F.transform(F.slice("features", 49, 8), lambda x: x.cast("double")).alias("panel"),
        F.concat(F.col("sample_id").cast("string"), F.lit("_"), F.floor(F.col("start") / 600).cast("string")).alias("segment"),
    )
    out = cl.reduce_profiles(df, 8, 3, max_iter=4)
    return out.select("sample_id", "chrom", "start", "assign", F.transform("centres", lambda x: F.round(x, 4)).alias("centres"))


