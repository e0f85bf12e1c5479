"""Classifier metrics from scores and 0/1 targets.

Every curve metric collapses to distinct scores first, so ties are handled
exactly and the ordered part runs on the collapsed table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bindscape.functions.prefix import cumulative_by_value, hash_index
from bindscape.functions.scalars import clip, sigmoid
from bindscape.functions.session import broadcast_if_small

AUPRC_CLIP = 1e-6


def score_curve(df: DataFrame, *, score: str = "score", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """One row per threshold: counts at it (``pos``, ``n``), at or above it
    (``tp``, ``seen``), and overall (``total_pos``, ``total``)."""
    by = list(by)
    flat = df.select(*by, score, F.col(y).cast("bigint").alias("pos"), F.lit(1).cast("bigint").alias("n"))
    run = cumulative_by_value(flat, by, score, {"tp": "pos", "seen": "n"}, descending=True)
    totals = run.groupBy(*by).agg(F.sum("pos").alias("total_pos"), F.sum("n").alias("total"))
    if by:
        return run.join(broadcast_if_small(totals), by)
    return run.withColumn("total_pos", totals.select("total_pos").scalar()).withColumn(
        "total", totals.select("total").scalar()
    )


def _grouped(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def auroc_expr() -> Column:
    above = F.col("tp") - F.col("pos")
    won = (F.col("n") - F.col("pos")) * (above + F.col("pos") / 2)
    return F.try_divide(F.sum(won), F.max("total_pos") * (F.max("total") - F.max("total_pos")))


def average_precision_expr() -> Column:
    return F.sum(F.coalesce(F.try_divide("pos", "total_pos"), F.lit(0.0)) * F.col("tp") / F.col("seen"))


def auprc_trapezoid_expr() -> Column:
    before_seen, before_tp = F.col("seen") - F.col("n"), F.col("tp") - F.col("pos")
    before = F.coalesce(F.try_divide(before_tp, before_seen), F.lit(1.0))
    return F.sum(F.coalesce(F.try_divide("pos", "total_pos"), F.lit(0.0)) * (F.col("tp") / F.col("seen") + before) / 2)


def auroc(df: DataFrame, **kw) -> DataFrame:
    return _grouped(score_curve(df, **kw), kw.get("by", ()), auroc_expr().alias("auroc"))


def average_precision(df: DataFrame, **kw) -> DataFrame:
    return _grouped(score_curve(df, **kw), kw.get("by", ()), average_precision_expr().alias("auprc"))


def auprc_trapezoid(df: DataFrame, **kw) -> DataFrame:
    return _grouped(score_curve(df, **kw), kw.get("by", ()), auprc_trapezoid_expr().alias("auprc"))


def precision_recall_curve(df: DataFrame, *, max_points: int | None = None, seed: int = 1, **kw) -> DataFrame:
    """(threshold, precision, recall) rows, one per threshold; with ``max_points``
    a plotting table of so many points per curve at most, picked by hash."""
    by, score = list(kw.get("by", ())), kw.get("score", "score")
    points = score_curve(df, **kw).select(
        *by,
        F.col(score).alias("threshold"),
        (F.col("tp") / F.col("seen")).alias("precision"),
        F.try_divide("tp", "total_pos").alias("recall"),
    )
    if max_points is None:
        return points
    return hash_index(points, by, ["threshold"], seed).where(F.col("idx") < max_points).drop("idx")


def confusion_class(prob: Column, y: Column, cutoff: float = 0.5) -> Column:
    return (
        F.when((prob >= cutoff) & (y == 1), "true_positive")
        .when((prob >= cutoff) & (y == 0), "false_positive")
        .when((prob < cutoff) & (y == 1), "false_negative")
        .otherwise("true_negative")
    )


def confusion(df: DataFrame, *, margin: str = "margin", y: str = "y", by: Sequence[str] = (), cutoff: float = 0.5) -> DataFrame:
    kind = confusion_class(sigmoid(F.col(margin)), F.col(y), cutoff)
    return _grouped(
        df.withColumn("__k", kind),
        by,
        F.count(F.lit(1)).alias("all_regions"),
        *[F.count_if(F.col("__k") == k).alias(k) for k in ("true_positive", "false_positive", "false_negative")],
    )


def confusion_regions(df: DataFrame, *, margin: str = "margin", y: str = "y", cutoff: float = 0.5) -> DataFrame:
    """Rows of each error class with their probability (true negatives left out)."""
    prob = sigmoid(F.col(margin))
    return (
        df.withColumn("pred", prob)
        .withColumn("class", confusion_class(prob, F.col(y), cutoff))
        .where("class <> 'true_negative'")
    )


def f1(df: DataFrame, *, margin: str = "margin", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """F1 of the rounded prediction (exactly 0.5 rounds to 0)."""
    hit = (sigmoid(F.col(margin)) > 0.5).cast("int")
    tp = F.sum(hit * F.col(y))
    return _grouped(df, by, F.try_divide(2 * tp, F.sum(hit) + F.sum(y)).alias("f1"))


def weighted_log_loss(
    df: DataFrame, *, prob: str = "prob", y: str = "y", by: Sequence[str] = (), miss_weight: float = 5.0
) -> DataFrame:
    p = clip(F.col(prob), AUPRC_CLIP, 1 - AUPRC_CLIP)
    loss = -(miss_weight * F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p))
    return _grouped(df, by, F.avg(loss).alias("error"))


def model_mean(df: DataFrame, key: Sequence[str], *, margin: str = "margin") -> DataFrame:
    """Ensemble probability: mean over models of the sigmoid of the margin."""
    return df.groupBy(*key).agg(F.avg(sigmoid(F.col(margin))).alias("prob"))


def positive_prior(df: DataFrame, *, y: str = "y") -> DataFrame:
    """Row count, positives, and the log prior shift -log10(2n/n_pos - 1)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos")).select(
        "n", "n_pos", (-F.log10(F.try_divide(2 * F.col("n"), F.col("n_pos")) - 1)).alias("beta")
    )


def metric_mean(history: DataFrame, *, step: str = "round", metric: str = "auprc", skip: str = "train") -> DataFrame:
    """Mean metric over the validation sets, per boosting round."""
    return history.where(F.col("set_name") != skip).groupBy(step).agg(F.avg(metric).alias(metric))


def leaderboard(trials: DataFrame, *, loss: str = "loss") -> DataFrame:
    return trials.orderBy(loss, *[c for c in trials.columns if c != loss])


def best_trial(trials: DataFrame, *, loss: str = "loss") -> DataFrame:
    others = [c for c in trials.columns if c != loss]
    return trials.agg(F.min(F.struct(loss, *others)).alias("b")).select("b.*")


def evaluate(pred: DataFrame, *, key: Sequence[str], model: str = "model_id", cutoff: float = 0.5) -> DataFrame:
    """AUROC, average precision and confusion counts of every model and of the
    model mean (``average``); ambiguous rows must already be gone.

    ``pred`` has ``key, model, margin, y``.
    """
    each = pred.select(F.col(model).cast("string").alias("model"), "y", sigmoid(F.col("margin")).alias("prob"))
    # rounded, so that the order of summation cannot split or join ties
    prob = F.round(F.avg(sigmoid(F.col("margin"))), 12)
    mean = pred.groupBy(*key).agg(prob.alias("prob"), F.max("y").alias("y")).select(
        F.lit("average").alias("model"), "y", "prob"
    )
    both = each.unionByName(mean)
    curve = score_curve(both, score="prob", by=["model"])
    hit = F.col("prob") >= cutoff
    return curve.groupBy("model").agg(
        F.max("total").alias("all_regions"),
        auroc_expr().alias("auroc"),
        average_precision_expr().alias("auprc"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("true_positive"),
        F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("false_positive"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("false_negative"),
    )
