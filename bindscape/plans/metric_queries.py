"""Classifier metrics over labelled scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions.scalars import sigmoid
from bindscape.operators import labels as lb, metrics as mt
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql

KEY = ["l_orderkey", "l_linenumber"]
CURVE = {
    "clean": "SELECT *, CAST(label='B' AS INTEGER) AS y FROM scored_labels WHERE label<>'A'",
    "curve": """SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen,
      sum(pos) OVER () AS tpos, sum(n) OVER () AS tot FROM (SELECT score, sum(y) AS pos, count(*) AS n FROM clean GROUP BY score)""",
    "mcurve": """SELECT *, sum(pos) OVER (PARTITION BY model_id ORDER BY margin DESC) AS tp,
      sum(n) OVER (PARTITION BY model_id ORDER BY margin DESC) AS seen,
      sum(pos) OVER (PARTITION BY model_id) AS tpos, sum(n) OVER (PARTITION BY model_id) AS tot
      FROM (SELECT model_id, margin, sum(y) AS pos, count(*) AS n FROM clean GROUP BY ALL)""",
}


def _clean(spark, sf):
    df = lb.drop_ambiguous(v.scored_labels(spark, sf))
    return df.withColumn("y", (F.col("label") == "B").cast("int"))


@query(sql("SELECT l_orderkey, l_linenumber, label, score FROM clean", **CURVE))
def ambiguous_dropped(spark, sf):
    return lb.drop_ambiguous(v.scored_labels(spark, sf)).select(*KEY, "label", "score")


@query(sql("SELECT l_orderkey, l_linenumber, CAST(label='B' AS INTEGER) AS y, CAST(label<>'A' AS INTEGER) AS weight FROM scored_labels"))
def ambiguous_zero_weight(spark, sf):
    return lb.weighted_target(v.scored_labels(spark, sf)).select(*KEY, "y", "weight")


@query(sql("SELECT round(sum((n-pos)*(tp-pos+pos/2.0))/(max(tpos)*(max(tot)-max(tpos))), 6) AS auroc FROM curve", **CURVE))
def auroc(spark, sf):
    return mt.auroc(_clean(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


@query(sql("""SELECT model_id, round(sum((n-pos)*(tp-pos+pos/2.0))/(max(tpos)*(max(tot)-max(tpos))), 6) AS auroc
    FROM mcurve GROUP BY model_id""", **CURVE))
def auroc_by_model(spark, sf):
    return mt.auroc(_clean(spark, sf), score="margin", by=["model_id"]).withColumn("auroc", F.round("auroc", 6))


@query(sql("SELECT round(sum(pos/tpos*tp/seen), 6) AS auprc FROM curve", **CURVE))
def average_precision(spark, sf):
    return mt.average_precision(_clean(spark, sf)).select(F.round("auprc", 6).alias("auprc"))


@query(sql("SELECT model_id, round(sum(pos/tpos*tp/seen), 6) AS auprc FROM mcurve GROUP BY model_id", **CURVE))
def average_precision_by_model(spark, sf):
    return mt.average_precision(_clean(spark, sf), score="margin", by=["model_id"]).withColumn("auprc", F.round("auprc", 6))


@query(sql("""SELECT round(sum(pos/tpos*(tp/seen + CASE WHEN seen=n THEN 1.0 ELSE (tp-pos)/(seen-n) END)/2), 6) AS auprc
    FROM curve""", **CURVE))
def auprc_trapezoid(spark, sf):
    return mt.auprc_trapezoid(_clean(spark, sf)).select(F.round("auprc", 6).alias("auprc"))


@query(sql("SELECT model_id, margin AS threshold, round(tp/seen, 6) AS precision, round(tp/tpos, 6) AS recall FROM mcurve", **CURVE))
def precision_recall_points(spark, sf):
    out = mt.precision_recall_curve(_clean(spark, sf), score="margin", by=["model_id"])
    return out.select("model_id", "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(sql("SELECT score, CAST(tp AS BIGINT) AS tp, CAST(seen AS BIGINT) AS seen FROM curve", **CURVE))
def cumulative_counts(spark, sf):
    return mt.score_curve(_clean(spark, sf)).select("score", "tp", "seen")


@query(sql("""SELECT model_id, count(*) AS all_regions, count(*) FILTER (p>=0.5 AND y=1) AS true_positive,
    count(*) FILTER (p>=0.5 AND y=0) AS false_positive, count(*) FILTER (p<0.5 AND y=1) AS false_negative
    FROM (SELECT *, 1/(1+exp(-margin)) AS p FROM clean) GROUP BY model_id""", **CURVE))
def confusion_counts(spark, sf):
    return mt.confusion(_clean(spark, sf), by=["model_id"])


@query(sql("""SELECT * FROM (SELECT l_orderkey, l_linenumber, model_id, round(1/(1+exp(-margin)),6) AS pred, y,
    CASE WHEN margin>=0 AND y=1 THEN 'true_positive' WHEN margin>=0 THEN 'false_positive'
    WHEN y=1 THEN 'false_negative' END AS class FROM clean) WHERE class IS NOT NULL""", **CURVE))
def confusion_regions(spark, sf):
    out = mt.confusion_regions(_clean(spark, sf))
    return out.select(*KEY, "model_id", F.round("pred", 6).alias("pred"), "y", "class")


@query(sql("""SELECT model_id, round(2.0*sum(h*y)/(sum(h)+sum(y)), 6) AS f1 FROM
    (SELECT *, CAST(1/(1+exp(-margin))>0.5 AS INTEGER) AS h FROM clean) GROUP BY model_id""", **CURVE))
def f1_by_model(spark, sf):
    return mt.f1(_clean(spark, sf), by=["model_id"]).withColumn("f1", F.round("f1", 6))


@query(sql("""SELECT round(avg(-(5*y*ln(p)+(1-y)*ln(1-p))), 6) AS error FROM
    (SELECT y, least(greatest(1/(1+exp(-margin)), 1e-6), 1-1e-6) AS p FROM clean)""", **CURVE))
def weighted_log_loss(spark, sf):
    df = _clean(spark, sf).withColumn("prob", sigmoid(F.col("margin")))
    return mt.weighted_log_loss(df).withColumn("error", F.round("error", 6))


@query(sql("SELECT l_orderkey, round(avg(1/(1+exp(-margin))), 6) AS prob FROM scored_labels GROUP BY l_orderkey"))
def ensemble_mean_score(spark, sf):
    return mt.model_mean(v.scored_labels(spark, sf), ["l_orderkey"]).withColumn("prob", F.round("prob", 6))


@query(sql("""SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(-log10(2.0*count(*)/sum(y)-1), 6) AS beta FROM clean""", **CURVE))
def positive_prior(spark, sf):
    return mt.positive_prior(_clean(spark, sf)).withColumn("beta", F.round("beta", 6))


_HIST = {"hist": """SELECT CAST(month(l_shipdate) AS INTEGER) AS round, CASE WHEN l_suppkey%3=0 THEN 'train'
    ELSE 'set' || CAST(l_suppkey%3 AS VARCHAR) END AS set_name, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n
    FROM lineitem GROUP BY ALL"""}


def _history(spark, sf):
    li = v.table(spark, sf, "lineitem")
    name = F.when(F.col("l_suppkey") % 3 == 0, "train").otherwise(F.concat(F.lit("set"), (F.col("l_suppkey") % 3).cast("string")))
    return li.groupBy(F.month("l_shipdate").alias("round"), name.alias("set_name")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1))).alias("auprc")
    )


@query(sql("SELECT round, round(avg(q*1.0/n), 6) AS auprc FROM hist WHERE set_name<>'train' GROUP BY round", **_HIST))
def mean_metric_per_round(spark, sf):
    return mt.metric_mean(_history(spark, sf)).withColumn("auprc", F.round("auprc", 6))


@query(sql("SELECT round(q*1.0/n, 6) AS loss, round AS trial, set_name FROM hist ORDER BY 1, 2, 3", **_HIST))
def trial_leaderboard(spark, sf):
    trials = _history(spark, sf).select(F.round("auprc", 6).alias("loss"), F.col("round").alias("trial"), "set_name")
    return mt.leaderboard(trials)


@query(sql("SELECT round(q*1.0/n, 6) AS loss, round AS trial, set_name FROM hist ORDER BY 1, 2, 3 LIMIT 1", **_HIST))
def lowest_loss_trial(spark, sf):
    trials = _history(spark, sf).select(F.round("auprc", 6).alias("loss"), F.col("round").alias("trial"), "set_name")
    return mt.best_trial(trials)


_EVAL = {
    "preds": """SELECT CAST(model_id AS VARCHAR) AS model, y, 1/(1+exp(-margin)) AS prob FROM clean
      UNION ALL SELECT 'average', max(y), round(avg(1/(1+exp(-margin))), 12) FROM clean GROUP BY l_orderkey""",
    "ecurve": """SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY model) AS tpos,
      sum(n) OVER (PARTITION BY model) AS tot FROM (SELECT model, prob, sum(y) AS pos, count(*) AS n FROM preds GROUP BY ALL)
      WINDOW w AS (PARTITION BY model ORDER BY prob DESC)""",
}


@query(sql("""SELECT model, CAST(max(tot) AS BIGINT) AS all_regions, round(sum((n-pos)*(tp-pos+pos/2.0))/(max(tpos)*(max(tot)-max(tpos))), 5) AS auroc,
    round(sum(pos/tpos*tp/seen), 5) AS auprc, CAST(sum(CASE WHEN prob>=0.5 THEN pos ELSE 0 END) AS BIGINT) AS true_positive,
    CAST(sum(CASE WHEN prob>=0.5 THEN n-pos ELSE 0 END) AS BIGINT) AS false_positive,
    CAST(sum(CASE WHEN prob<0.5 THEN pos ELSE 0 END) AS BIGINT) AS false_negative FROM ecurve GROUP BY model""", **CURVE, **_EVAL))
def evaluation_report(spark, sf):
    out = mt.evaluate(_clean(spark, sf), key=["l_orderkey"])
    return out.withColumn("auroc", F.round("auroc", 5)).withColumn("auprc", F.round("auprc", 5))


@query(sql("SELECT count(*) AS n FROM scored_labels"))
def row_count(spark, sf):
    return v.scored_labels(spark, sf).agg(F.count(F.lit(1)).alias("n"))
