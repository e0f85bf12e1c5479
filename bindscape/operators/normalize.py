"""Quantile transforms, rank maps, segments and nearest-profile blending."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from bindscape.functions.prefix import (
    BUCKET,
    position_bucket,
    bucketed_prefix,
    exact_quantiles,
    join_null_safe,
    join_values,
    running_by_value,
    value_index,
)
from bindscape.functions.hashing import HASH_BITS, stable_hash
from bindscape.functions.session import broadcast_if_small, settle
from bindscape.operators.signal import profile_from_centre

def fit_quantiles(
    long: DataFrame,
    *,
    by: Sequence[str] = ("feature_idx",),
    value: str = "value",
    n_quantiles: int = 1000,
    subsample: int | None = None,
    key: Sequence[str] = (),
    seed: int = 6,
) -> DataFrame:
    """Evenly spaced quantiles of each group: ``by, q_idx, n_q, quantile``.

    Null and NaN values are left out.  All other rows count unless ``subsample`` asks for about that many per group,
    chosen by the hash of ``key``.
    """
    if subsample is not None:
        sizes = long.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
        share = stable_hash(seed, *by, *key) / F.lit(float(1 << HASH_BITS))
        long = long.join(broadcast_if_small(sizes), list(by)).where(share * F.col("__size") < subsample)
    return exact_quantiles(long.where(~F.isnan(F.col(value).cast("double"))), by, value, n_quantiles=n_quantiles)


def apply_quantiles(
    long: DataFrame,
    quantiles: DataFrame,
    *,
    by: Sequence[str] = ("feature_idx",),
    value: str = "value",
    name: str | None = None,
    skip_zero: bool = False,
    spread: Sequence[str] = ("chrom", "start"),
) -> DataFrame:
    """Map values to [0, 1] by the mean of the left and right interpolation.

    The smallest fitted value and everything below map to 0, the largest and
    above to 1, a constant column to 0; null and NaN map to null.  Distinct
    values are matched with the quantiles by position in value order.
    """
    name = name or value
    out = _interpolate_ordered(long, quantiles, by, value, "__q", spread)
    result = F.col("__q")
    if skip_zero:
        result = F.when(F.col(value) == 0, F.lit(0.0)).otherwise(result)
    return out.withColumn(name, result).drop("__q")


def _interpolate_ordered(
    long: DataFrame, quantiles: DataFrame, by: Sequence[str], value: str, name: str, spread: Sequence[str]
) -> DataFrame:
    by = list(by)
    none = F.lit(None).cast("bigint")
    points = quantiles.groupBy(*by, F.col("quantile").cast("double").alias("__v")).agg(
        F.min("q_idx").alias("lo"), F.max("q_idx").alias("hi")
    )
    number = F.col(value).cast("double")
    values = long.where(~F.isnan(number)).groupBy(*by, number.alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    flat = settle(
        points.withColumn("n", F.lit(0).cast("bigint"))
        .unionByName(values.withColumn("lo", none).withColumn("hi", none))
        .groupBy(*by, "__v")
        .agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        .withColumn("at", F.when(F.col("lo").isNotNull(), F.col("__v")))
        .withColumn("neg_lo", -F.col("lo"))
        .withColumn("neg_at", -F.col("at"))
    )
    up = settle(running_by_value(flat, by, "__v", maxes={"left_i": "hi", "left_v": "at"}))
    both = running_by_value(up, by, "__v", maxes={"neg_right_i": "neg_lo", "neg_right_v": "neg_at"}, descending=True)
    top = quantiles.groupBy(*by).agg(
        (F.max("n_q") - 1).alias("top"), F.min("quantile").alias("low_v"), F.max("quantile").alias("high_v")
    )
    right_i, right_v = -F.col("neg_right_i"), -F.col("neg_right_v")
    frac = (F.col("__v") - F.col("left_v")) / (right_v - F.col("left_v"))
    table = join_null_safe(both, broadcast_if_small(top), by).select(
        *by,
        F.col("__v").alias("__value"),
        "n",
        F.when(F.col("__v") <= F.col("low_v"), F.lit(0.0))
        .when(F.col("__v") >= F.col("high_v"), F.lit(1.0))
        .when(F.col("lo").isNotNull(), (F.col("lo") + F.col("hi")) / 2 / F.col("top"))
        .otherwise((F.col("left_i") + frac * (right_i - F.col("left_i"))) / F.col("top"))
        .alias(name),
    ).where("n > 0")
    rows = long.withColumn("__value", F.col(value).cast("double"))
    return join_values(rows, table, [*by, "__value"], [name], weight="n", spread=spread).drop("__value")


def fit_apply(long: DataFrame, *, by: Sequence[str], value: str = "value", skip_zero: bool = False, n_quantiles: int = 1000, **kw) -> DataFrame:
    """Fit and transform in one step; ``skip_zero`` fits on non-zeros and keeps zeros."""
    fitted = fit_quantiles(long.where(F.col(value) != 0) if skip_zero else long, by=by, value=value, n_quantiles=n_quantiles)
    return apply_quantiles(long, settle(fitted), by=by, value=value, skip_zero=skip_zero, **kw)


def qt_to_reference(
    sample: DataFrame, reference: DataFrame, *, by: Sequence[str] = (), value: str = "value", ref_value: str = "ref_value",
    tie: Sequence[str] = ("chrom", "start"), name: str = "qt",
) -> DataFrame:
    """Replace each value by the reference value of equal rank."""
    left = value_index(sample, by, value, tie, name="__rank")
    right = value_index(reference, by, ref_value, tie, name="__rank").select(
        *by, "__rank", F.col(ref_value).alias(name)
    )
    return left.join(right, [*by, "__rank"]).drop("__rank")


def run_segments(df: DataFrame, *, ids: str = "cp_id", by: Sequence[str] = ("chrom",), order: str = "start", name: str = "segment") -> DataFrame:
    """Number the runs of equal first tokens; '.' counts as '0' and the walk
    starts from '0'."""
    by = list(by)
    token = F.trim(F.element_at(F.split(F.when(F.col(ids) == ".", "0").otherwise(F.col(ids)), ","), 1))
    rows = settle(df.withColumn("__token", token))
    bucket = position_bucket(rows, by, order)
    rows = rows.withColumn(BUCKET, bucket if bucket is not None else F.lit(0).cast("bigint"))
    keys = by + [BUCKET]
    inside = Window.partitionBy(*keys).orderBy(order)
    # the last token of the previous non-empty bucket carries over
    last = rows.groupBy(*keys).agg(F.max_by("__token", order).alias("__last"))
    carry = last.select(*keys, F.lag("__last").over(Window.partitionBy(*by).orderBy(BUCKET)).alias("__before"))
    marked = rows.join(carry, keys).withColumn(
        "__new",
        (F.col("__token") != F.coalesce(F.lag("__token").over(inside), F.col("__before"), F.lit("0"))).cast("bigint"),
    )
    marked = settle(marked.drop(BUCKET, "__before"))
    return bucketed_prefix(marked, by, [order], bucket, sums={name: "__new"}).drop("__new", "__token")


def pearson(x: Column, y: Column) -> Column:
    """Pearson r, null when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlate(
    df: DataFrame, by: Sequence[str], x: str, panel: str, n_panel: int, *, decimals: int | None = 3, name: str = "r"
) -> DataFrame:
    """Pearson r of a column with every entry of an array column, per group.

    Undefined correlations (a constant side) come out null.
    """
    def one(i: int) -> Column:
        r = pearson(F.col(x).cast("double"), F.get(panel, F.lit(i)).cast("double"))
        return F.round(r, decimals) if decimals is not None else r

    aggs = F.array(*[one(i) for i in range(n_panel)]).alias(name)
    return df.groupBy(*by).agg(aggs) if by else df.agg(aggs)


def best_reference(df: DataFrame, by: Sequence[str], x: str, panel: str, n_panel: int) -> DataFrame:
    """Index of the panel profile with the largest r (first on ties)."""
    r = correlate(df, by, x, panel, n_panel)
    known = F.transform("r", lambda v: F.coalesce(v, F.lit(-2.0)))
    return r.select(*by, (F.array_position(known, F.array_max(known)) - 1).cast("int").alias("ref_id"), F.array_max(known).alias("r"))


def column_correlations(df: DataFrame, n_features: int, *, features: str = "features", decimals: int = 3) -> DataFrame:
    """Correlation matrix of the feature columns as ``(a, b, r)``.

    Every task folds its rows into one matrix of products; only those small
    matrices are shuffled, never row pairs.
    """
    gram = gram_matrix(df, n_features, features=features)
    cov = F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * F.col("sy") / F.col("n")
    full = gram.withColumn("cov", cov)
    diag = full.where("a = b").select("a", F.col("cov").alias("var"))
    other = diag.select(F.col("a").alias("b"), F.col("var").alias("var_b"))
    joined = full.join(diag, "a").join(other, "b")
    return joined.select("a", "b", (F.round(F.try_divide(F.col("cov"), F.sqrt(F.col("var") * F.col("var_b"))), decimals) + 0.0).alias("r"))


def gram_matrix(df: DataFrame, n_features: int, *, features: str = "features", by: str | None = None) -> DataFrame:
    """``(by, a, b, n, sx, sy, sxy)`` sums over all rows, about the column means.

    The rows are read once: every task folds them into counts, means and products about its own
    means, and these small tables are moved to the means of all rows when they are added up.
    """
    key = [df.schema[by]] if by else []
    schema = T.StructType(
        key + [T.StructField(c, T.IntegerType()) for c in ("a", "b")]
        + [T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("ma", "mb", "c")]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            groups = pdf.groupby(by) if by else [(None, pdf)] if len(pdf) else []
            for k, part in groups:
                x = np.stack(part[features].to_numpy()).astype(float)
                m = x.mean(0)
                x -= m
                n, mean, c = total.get(k, (0, 0.0, 0.0))
                gap, both = m - mean, n + len(x)
                total[k] = (both, mean + gap * len(x) / both, c + x.T @ x + np.outer(gap, gap) * (n * len(x) / both))
        a, b = np.divmod(np.arange(n_features * n_features), n_features)
        for k, (n, mean, c) in total.items():
            out = pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32"), "n": n, "ma": mean[a], "mb": mean[b], "c": c.ravel()})
            if by:
                out.insert(0, by, k)
            yield out

    cols = ([by] if by else []) + [features]
    parts = settle(df.select(*cols).mapInPandas(fold, schema))
    mean = parts.where("a = b").groupBy("a").agg((F.sum(F.col("n") * F.col("ma")) / F.sum("n")).alias("mean"))
    mean = broadcast_if_small(mean)
    moved = parts.join(mean.withColumnRenamed("mean", "__x"), "a").join(mean.select(F.col("a").alias("b"), F.col("mean").alias("__y")), "b")
    dx, dy, n = F.col("ma") - F.col("__x"), F.col("mb") - F.col("__y"), F.col("n")
    return moved.groupBy(*([by] if by else []), "a", "b").agg(
        F.sum("n").alias("n"), F.sum(n * dx).alias("sx"), F.sum(n * dy).alias("sy"), F.sum(F.col("c") + n * dx * dy).alias("sxy"))


def array_quantile(values: Column, q: float | Column) -> Column:
    """Linear-interpolated quantile of an array column."""
    ordered = F.array_sort(values)
    h = (q if isinstance(q, Column) else F.lit(q)) * (F.size(values) - 1)
    low = F.get(ordered, F.floor(h).cast("int"))
    high = F.get(ordered, F.ceil(h).cast("int"))
    return low + (high - low) * (h - F.floor(h))


def knn_blend(
    df: DataFrame, *, raw: str, normed: str, panel: str, n_panel: int, q: float, r_min: float = 0.6,
    by: Sequence[str] = ("segment",), name: str = "blend",
) -> DataFrame:
    """Blend the normalised signal with the panel profiles it resembles.

    Per segment: profiles with r above the q-quantile and above ``r_min``
    (else just above the quantile) add value*r/n, and the signal keeps
    mean(1 - r).  Zeros of the raw signal stay 0; undefined results fall back
    to raw.
    """
    weights = broadcast_if_small(blend_weights(df, normed, panel, n_panel, q, r_min, by))
    mixed = F.aggregate(
        F.zip_with(panel, "__w", lambda v, w: v * w), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))
    )
    blended = F.col(normed) * F.col("__own") + mixed
    blended = F.coalesce(F.nanvl(blended, F.lit(None).cast("double")), F.col(raw).cast("double"))
    return (
        df.join(weights, list(by))
        .withColumn(name, F.round(F.when(F.col(raw) == 0, F.lit(0.0)).otherwise(blended), 2))
        .drop("__w", "__own")
    )


def blend_weights(df: DataFrame, normed: str, panel: str, n_panel: int, q: float, r_min: float, by: Sequence[str]) -> DataFrame:
    r = correlate(df, by, normed, panel, n_panel)
    r = r.withColumn("r", F.transform("r", lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0))))
    r = r.withColumn("__cut", array_quantile(F.col("r"), q))
    strong = F.filter("r", lambda v: (v > F.col("__cut")) & (v > r_min))
    r = r.withColumn("__min", F.when(F.size(strong) > 0, F.lit(r_min)).otherwise(F.lit(-1.0)))
    r = r.withColumn("__used", F.filter("r", lambda v: (v > F.col("__cut")) & (v > F.col("__min"))))
    n = F.size("__used")
    own = F.when(n > 0, F.aggregate("__used", F.lit(0.0), lambda a, v: a + (1 - v)) / n).otherwise(F.lit(1.0))
    weight = F.transform(
        "r", lambda v: F.when((v > F.col("__cut")) & (v > F.col("__min")), v / n).otherwise(F.lit(0.0))
    )
    return r.select(*by, weight.alias("__w"), own.alias("__own"))


def nearest_reference_per_segment(df: DataFrame, *, x: str, panel: str, n_panel: int, by: Sequence[str] = ("segment",)) -> DataFrame:
    """Most correlated panel profile of every segment."""
    return best_reference(df, by, x, panel, n_panel)


def sqtknn(
    signal: DataFrame, panels: dict[str, tuple[str, str]], n_panel: int, *, n_reduced: int,
    centre: dict[str, tuple[int, int]] | None = None, k: int = 1, r_min: float = 0.6, pseudo: float = 1.0,
    bin_size: int = 25, step: int = 50, keys: Sequence[str] = ("chrom",),
) -> DataFrame:
    """Segment-wise quantile and nearest-profile normalisation, for each value of
    ``keys`` (a chromosome, or a sample's chromosome) by itself.

    ``signal`` has ``keys, start, segment, features`` and, per strand, a full
    and a reduced panel array (``panels[strand]`` names both).  The central
    columns of each strand are matched to their best profile, rank-mapped to
    it, blended per segment, and the 24-column profile is rebuilt from them.
    """
    keys = list(keys)
    centre = centre or {"forward": (12, 13), "reverse": (36, 37)}
    base = signal
    built = []
    for strand, (full, reduced) in panels.items():
        cols = []
        for i in centre[strand]:
            raw, normed, out = f"__raw{i}", f"__qt{i}", f"__knn{i}"
            df = settle(base.withColumn(raw, F.get("features", F.lit(i)) * bin_size))
            lifted = df.withColumn("__x", F.col(raw) + pseudo).withColumn(
                "__p", F.transform(full, lambda v: v + pseudo)
            )
            best = broadcast_if_small(best_reference(lifted, keys, "__x", "__p", n_panel).drop("r"))
            ref = df.join(best, keys).select(*keys, "start", F.get(full, F.col("ref_id")).alias("__ref"))
            mapped = qt_to_reference(df, ref, by=keys, tie=["start"], value=raw, ref_value="__ref", name=normed)
            blended = knn_blend(
                mapped, raw=raw, normed=normed, panel=reduced, n_panel=n_reduced, q=1 - k / n_reduced,
                r_min=r_min, by=[*keys, "segment"], name=out,
            )
            cols.append(blended.select(*keys, "start", out))
        pair = cols[0].join(cols[1], [*keys, "start"])
        a, b = (f"__knn{i}" for i in centre[strand])
        built.append(
            profile_from_centre(pair, a, b, keys=keys, bin_size=bin_size, step=step).select(
                *keys, "start", F.col("profile").alias(f"__{strand}")
            )
        )
    out = signal.select(*keys, "start")
    for b in built:
        out = out.join(b, [*keys, "start"])
    whole = F.concat(*[F.col(f"__{s}") for s in panels])
    return out.select(*keys, "start", F.transform(whole, lambda v: F.round(v, 3)).alias("features"))


def chimera(
    tensor: DataFrame, labels: DataFrame, segments: DataFrame, target: str | int, train: Sequence, *,
    centre: Sequence[int] = (12, 13, 36, 37),
) -> DataFrame:
    """Per segment, the training sample most correlated with the target: its
    features and its label.

    ``tensor``: sample_id, chrom, start, features; ``labels``: sample_id,
    chrom, start, label; ``segments``: chrom, start, segment.
    """
    level = sum((F.get("features", F.lit(i)) for i in centre[1:]), F.get("features", F.lit(centre[0]))) / len(centre)
    kept = tensor.where(F.col("sample_id").isin([target, *train])).withColumn("__level", level)
    keyed = settle(kept.join(segments, ["chrom", "start"]))
    aim = keyed.where(F.col("sample_id") == target).select("chrom", "start", "segment", F.col("__level").alias("__aim"))
    pairs = keyed.where(F.col("sample_id") != target).join(aim, ["chrom", "start", "segment"])
    r = pairs.groupBy("segment", "sample_id").agg(pearson(F.col("__level"), F.col("__aim")).alias("__r"))
    r = r.withColumn("__r", F.round(F.coalesce("__r", F.lit(-2.0)), 3))
    best = r.groupBy("segment").agg(
        F.max_by("sample_id", F.struct("__r", (-F.col("sample_id")).alias("t"))).alias("sample_id"),
        F.max("__r").alias("r"),
    )
    chosen = keyed.join(broadcast_if_small(best), ["segment", "sample_id"])
    return chosen.join(labels, ["sample_id", "chrom", "start"]).select(
        "chrom", "start", "segment", "sample_id", "r",
        F.transform("features", lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("features"),
        "label",
    )


def spline_normalize(
    df: DataFrame, *, ref: str, target: str, common: str, pseudo: float = 1.0, pieces: int = 5, name: str = "normed"
) -> DataFrame:
    """MA-normalisation: a cubic spline of the log-ratio on the mean log level
    is fitted on ``common`` rows and added to every target log value."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    df = settle(
        df.withColumn("__lr", F.log2(F.col(ref) + pseudo)).withColumn("__lt", F.log2(F.col(target) + pseudo))
        .withColumn("__a", (F.col("__lr") + F.col("__lt")) / 2).withColumn("__m", F.col("__lr") - F.col("__lt"))
    )
    low, high = df.where(common).agg(F.min("__a"), F.max("__a")).first()
    gap = (high if high > 0 else 1.0) / pieces
    knots = [low + gap * i for i in range(1, pieces + 1) if low + gap * i < high]
    a = F.col("__a")
    basis = [a, a * a, a * a * a] + [F.pow(F.greatest(a - k, F.lit(0.0)), F.lit(3)) for k in knots]
    ready = df.withColumn("__x", array_to_vector(F.array(*basis)))
    model = LinearRegression(featuresCol="__x", labelCol="__m", predictionCol="__fit").fit(ready.where(common))
    moved = F.greatest(F.pow(F.lit(2.0), F.col("__lt") + F.col("__fit")) - pseudo, F.lit(0.0))
    out = model.transform(ready).withColumn(name, F.when(F.col(target) == 0, F.lit(0.0)).otherwise(moved))
    return out.drop("__lr", "__lt", "__a", "__m", "__x", "__fit")


def standardize(df: DataFrame, n_features: int, *, features: str = "features") -> DataFrame:
    """z-score of every feature (population deviation; constant columns become 0)."""
    stats = df.agg(
        F.array(*[F.avg(F.get(features, F.lit(i))) for i in range(n_features)]).alias("m"),
        F.array(*[F.stddev_pop(F.get(features, F.lit(i))) for i in range(n_features)]).alias("s"),
    )
    return (
        df.withColumn("__m", stats.select("m").scalar())
        .withColumn("__s", stats.select("s").scalar())
        .withColumn(features, F.zip_with(features, "__m", lambda x, m: x - m))
        .withColumn(features, F.zip_with(features, "__s", lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / s)))
        .drop("__m", "__s")
    )
