"""Tests and summary statistics on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bindscape.functions.prefix import running_by_value
from bindscape.functions.scalars import normal_upper_tail
from bindscape.functions.session import broadcast_if_small, settle
from bindscape.operators.normalize import gram_matrix
from bindscape.operators.peaks import bh_adjust


def upper_half_moments(df: DataFrame, value: str, cut, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance of the values above ``cut``."""
    kept = df.where(F.col(value) > cut)
    aggs = [F.avg(value).alias("mean"), F.var_pop(value).alias("var")]
    return kept.groupBy(*by).agg(*aggs) if by else kept.agg(*aggs)


def fdr_flags(long: DataFrame, *, column: str = "feature_idx", value: str = "value", alpha: float = 0.1,
              spread: Sequence[str] = ("chrom", "start"), name: str = "significant") -> DataFrame:
    """Per column: z-score, normal upper tail, BH at ``alpha``."""
    stats = long.groupBy(column).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = (F.col(value) - F.col("__m")) / F.col("__s")
    scored = long.join(broadcast_if_small(stats), column).withColumn("__z", F.round(z, 9))
    scored = scored.withColumn(
        "__p", F.when(F.col("__s") == 0, F.lit(1.0)).otherwise(normal_upper_tail(F.col("__z")))
    ).drop("__m", "__s", "__z")
    adjusted = bh_adjust(scored, "__p", by=[column], decimals=None, spread=spread, name="__adj")
    return adjusted.withColumn(name, (F.col("__adj") <= alpha).cast("int")).drop("__p", "__adj")


def common_rows(flags: DataFrame, keys: Sequence[str], *, q: float = 0.95, flag: str = "significant") -> DataFrame:
    """Rows significant in at least a share ``q`` of the columns (common peak)
    or in none (common background)."""
    return flags.groupBy(*keys).agg(
        F.sum(flag).cast("bigint").alias("n_significant"), F.count(F.lit(1)).alias("n_columns")
    ).select(
        *keys,
        (F.col("n_significant") >= F.col("n_columns") * q).alias("common_peak"),
        (F.col("n_significant") == 0).alias("common_background"),
    )


def rank_sum_test(df: DataFrame, *, value: str, group: str, by: Sequence[str] = (), min_rows: int = 2) -> DataFrame:
    """One-sided rank-sum test that ``group`` = 1 exceeds ``group`` = 0.

    -log10 p by the normal approximation with tie and continuity correction;
    0 where the first side has fewer than ``min_rows`` rows or all values tie.
    """
    by = list(by)
    flat = settle(
        df.groupBy(*by, value).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(group).cast("bigint")).alias("n1")
        )
    )
    run = running_by_value(flat, by, value, sums={"upto": "n"})
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    agg = [
        F.sum(F.col("n1") * mid).alias("ranks"), F.sum("n1").alias("n1"), F.sum("n").alias("total"),
        F.sum(n * n * n - n).alias("ties"),
    ]
    s = run.groupBy(*by).agg(*agg) if by else run.agg(*agg)
    n1, total = F.col("n1").cast("double"), F.col("total").cast("double")
    n0 = total - n1
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1)))
    # no variance (one value only): no evidence
    z = F.try_divide(u - n1 * n0 / 2 - 0.5, F.sqrt(var))
    p = F.greatest(normal_upper_tail(z), F.lit(1e-300))
    ok = (F.col("n1") >= min_rows) & (n0 > 0)
    return s.select(*by, F.col("n1").cast("bigint").alias("n1"), (total - n1).cast("bigint").alias("n0"),
                    F.when(ok & z.isNotNull(), -F.log10(p)).otherwise(F.lit(0.0)).alias("neglog10p"))


def domain_shift(leaves: DataFrame, n_features: int, *, side: str = "side", features: str = "features") -> DataFrame:
    """Frobenius distance between the covariances of standardised leaf outputs
    of two sample sets (``side`` takes two values)."""
    gram = settle(gram_matrix(leaves, n_features, features=features, by=side))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    full = gram.withColumn("c", cov)
    diag = full.where("a = b").select(side, "a", F.col("c").alias("va"))
    diag_b = diag.select(side, F.col("a").alias("b"), F.col("va").alias("vb"))
    r = full.join(diag, [side, "a"]).join(diag_b, [side, "b"])
    # constant leaves standardise to 0; the covariance divides by n - 1
    scaled = r.withColumn(
        "s",
        F.when((F.col("va") <= 0) | (F.col("vb") <= 0), F.lit(0.0)).otherwise(
            F.col("c") / F.sqrt(F.col("va") * F.col("vb")) * F.col("n") / (F.col("n") - 1)
        ),
    )
    diff = scaled.groupBy("a", "b").agg((F.max("s") - F.min("s")).alias("d"))
    return diff.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("fro_norm"))
