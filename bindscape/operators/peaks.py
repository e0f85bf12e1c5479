"""From margins to called peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindscape.functions.prefix import cumulative_by_value, exact_quantiles, join_values, running_by_value
from bindscape.functions.session import broadcast_if_small, settle
from bindscape.functions.scalars import (
    neg_log10,
    poisson_tail_table,
    regularized_gamma_upper,
)
from bindscape.operators.intervals import merge_intervals

P_FLOOR = 1e-16


def most_frequent(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent value, the smallest one on ties."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    pick = F.max_by(value, F.struct(F.col("__n"), (-F.col(value)).alias("neg"))).alias(name)
    return counted.groupBy(*by).agg(pick) if by else counted.agg(pick)


def _excess(value: str, mode: Column) -> Column:
    # rounding first: 1.15 - 0.15 must count as 1, not as 0.999...
    return F.greatest(F.round(F.col(value) - mode, 2), F.lit(0.0))


def poisson_neglog10p(
    scores: DataFrame, *, value: str = "margin", by: Sequence[str] = (), decimals: int = 2, name: str = "neglog10p"
) -> DataFrame:
    """-log10 Poisson p of the score's excess over the background mode.

    Excess = score - mode, floored at 0; mean = max(average excess, 1);
    p = P(X > floor(excess)), floored at 1e-16.  The tail depends on an
    integer only, so it is looked up in a short array, not joined per row.
    """
    by = list(by)
    df = scores.withColumn(value, F.round(F.col(value), decimals))
    # one row per distinct score: all background statistics come from here
    counted = settle(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    pick = F.max_by(value, F.struct(F.col("__n"), (-F.col(value)).alias("neg"))).alias("mode")
    if not by:
        mode = F.lit(counted.agg(pick).first()[0])
        excess = _excess(value, mode)
        mean = counted.agg(F.greatest(F.sum(excess * F.col("__n")) / F.sum("__n"), F.lit(1.0)).alias("mu"))
        # evaluated once, then a constant of the plan
        tail = settle(mean).select(poisson_tail_table(F.col("mu"), P_FLOOR)).first()[0]
        out = df.withColumn("__k", F.floor(excess).cast("int")).withColumn("__tail", F.lit(tail))
    else:
        stats = (
            counted.join(counted.groupBy(*by).agg(pick), by)
            .groupBy(*by)
            .agg(
                F.first("mode").alias("mode"),
                F.greatest(
                    F.sum(_excess(value, F.col("mode")) * F.col("__n")) / F.sum("__n"), F.lit(1.0)
                ).alias("mu"),
            )
            .select(*by, "mode", poisson_tail_table(F.col("mu"), P_FLOOR).alias("__tail"))
        )
        out = df.join(broadcast_if_small(stats), by)
        out = out.withColumn("__k", F.floor(_excess(value, F.col("mode"))).cast("int")).drop("mode")
    p = F.coalesce(F.get("__tail", F.col("__k")), F.lit(P_FLOOR))
    return out.withColumn(name, neg_log10(p, P_FLOOR)).drop("__k", "__tail")


def gamma_neglog10p(scores: DataFrame, *, value: str = "margin", cap: float = 16.0, name: str = "neglog10p") -> DataFrame:
    """-log10 Gamma p with moments matched on the rows above the median.

    Where these rows have no variance, values above their mean get ``cap`` and
    the others 0."""
    base = scores.select(F.col(value).cast("double").alias(value))
    base = settle(base)
    mode = F.lit(most_frequent(base, value).first()[0])
    median = exact_quantiles(base, (), value, [0.5]).first()["quantile"]
    lifted = F.greatest(F.col(value) - mode, F.lit(0.0))
    fit = base.where(F.col(value) > median).agg(
        F.avg(lifted).alias("m"), F.var_pop(lifted).alias("v")
    ).first()
    if not fit.v or not fit.m:
        above = lifted > F.lit(fit.m if fit.m is not None else 0.0) * (1 + 1e-12)
        return scores.withColumn(name, F.when(above, F.lit(float(cap))).otherwise(F.lit(0.0)))
    shape, scale = F.lit(fit.m * fit.m / fit.v), F.lit(fit.v / fit.m)
    # few distinct scores: evaluate the special function once per value
    table = (
        base.groupBy(value)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__q", regularized_gamma_upper(shape, lifted / scale))
        .withColumn(name, F.least(-F.log10(F.greatest(F.col("__q"), F.lit(1e-300))), F.lit(cap)))
    )
    return join_values(scores, table, [value], [name], weight="__n", spread=scores.columns)


def bh_adjust(
    df: DataFrame,
    p: str,
    *,
    by: Sequence[str] = (),
    decimals: int | None = 5,
    spread: Sequence[str] = ("chrom", "start"),
    name: str = "fdr",
) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    Works on distinct p-values: ``p * n / rank`` with the rank of the last
    tie, then the running minimum from the largest p down.
    """
    by = list(by)
    flat = settle(df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("__n")))
    table = running_by_value(flat, by, p, sums={"__rank": "__n"})
    if by:
        table = table.join(broadcast_if_small(flat.groupBy(*by).agg(F.sum("__n").alias("__total"))), by)
    else:
        table = table.withColumn("__total", F.lit(flat.agg(F.sum("__n")).first()[0]))
    # running minimum over larger p = running maximum of the negated value
    table = settle(table.withColumn("__neg", -(F.col(p) * F.col("__total") / F.col("__rank"))))
    table = running_by_value(table, by, p, maxes={"__best": "__neg"}, descending=True)
    adjusted = F.least(-F.col("__best"), F.lit(1.0))
    if decimals is not None:
        adjusted = F.round(adjusted, decimals)
    table = table.select(*by, p, "__n", adjusted.alias(name))
    return join_values(df, table, [*by, p], [name], weight="__n", spread=spread)


def significant(df: DataFrame, *, neglog10p: str = "neglog10p", fdr: float = 0.01, decimals: int = 5) -> DataFrame:
    """Rows with BH-adjusted p at most ``fdr`` and ``score = round(-log10 p, 5) / 16``.

    The adjusted value is rounded before the cut.
    """
    withp = df.withColumn("__p", F.pow(F.lit(10.0), -F.col(neglog10p)))
    adj = bh_adjust(withp, "__p", decimals=decimals)
    return (
        adj.where(F.col("fdr") <= fdr)
        .withColumn("score", F.round(F.col(neglog10p), decimals) / 16)
        .drop("__p")
    )


def top_n(df: DataFrame, n: int, *, score: str = "score", tie: Sequence[str] = ("chrom", "start")) -> DataFrame:
    """The ``n`` rows with the largest score, ties in key order.

    A running count over distinct scores finds the cut first, so the final
    top-k sees little more than ``n`` rows however large the input is.
    """
    counted = df.select(score).withColumn("__n", F.lit(1).cast("bigint"))
    run = cumulative_by_value(counted, (), score, {"__seen": "__n"}, descending=True)
    cut = run.where(F.col("__seen") >= n).agg(F.max(score)).first()[0]
    kept = df if cut is None else df.where(F.col(score) >= F.lit(cut))
    return kept.orderBy(F.col(score).desc(), *[F.col(t).asc() for t in tie]).limit(n)


def genome_sort(df: DataFrame) -> DataFrame:
    """Chromosome name, then numeric start."""
    return df.orderBy("chrom", "start")


def call_peaks(
    margins: DataFrame, *, value: str = "margin", fdr: float = 0.01, top_bins: int = 100_000, top_peaks: int = 10_000
) -> DataFrame:
    """Margins to peaks: p-values, FDR cut, best bins, merge with mean, best peaks."""
    margins = settle(margins.select("chrom", "start", "stop", value))
    kept = top_n(settle(significant(poisson_neglog10p(margins, value=value), fdr=fdr)), top_bins)
    merged = settle(merge_intervals(kept.select("chrom", "start", "stop", "score"), mean="score"))
    return genome_sort(top_n(merged.select("chrom", "start", "stop", "score"), top_peaks))


def best_row_per(df: DataFrame, by: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *[F.col(t) for t in tie])
    return df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
