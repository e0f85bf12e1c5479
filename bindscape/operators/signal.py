"""Alignments to cut positions to per-bin feature arrays.

A feature tensor row is ``(sample_id, chrom, start, features ARRAY)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindscape.functions.scalars import zero_if_missing
from bindscape.functions.session import broadcast_if_small, spread

C = ("chrom", "start")
DROP_FLAGS = 1804  # unmapped, mate unmapped, secondary, failed quality, duplicate
REVERSE_FLAG = 16
CELL = 25
WINDOW_BEFORE, WINDOW = 600, 1400

# fixed values: where the bins of a profile begin in the window
EDGES = {
    "50": list(range(0, WINDOW + 50, 50)),
    "100": list(range(0, WINDOW + 100, 100)),
    "variable": [
        0, 100, 200, 300, 400, 450, 500, 550, 600, 625, 650, 675, 700,
        725, 750, 775, 800, 850, 900, 950, 1000, 1100, 1200, 1300, 1400,
    ],
}


def keep_alignments(df: DataFrame, *, min_mapq: int = 30) -> DataFrame:
    return df.where((F.col("flag").bitwiseAND(DROP_FLAGS) == 0) & (F.col("mapq") >= min_mapq))


def with_strand(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "strand", F.when(F.col("flag").bitwiseAND(REVERSE_FLAG) == 0, "forward").otherwise("reverse")
    )


def pile_up(df: DataFrame, *, ignore_duplicates: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """1-bp 5'-end signal per strand; repeated positions count once by default."""
    value = F.lit(1).cast("bigint") if ignore_duplicates else F.count(F.lit(1))
    return df.groupBy(*by, "chrom", "pos", "strand").agg(F.first(value).alias("value") if ignore_duplicates else value.alias("value"))


def cut_cells(cuts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct cut positions per 25-bp cell and strand (all profile edges are
    multiples of 25, so cells carry everything the profiles need)."""
    distinct = cuts.groupBy(*by, "chrom", "strand", "pos").agg(F.lit(1).alias("__one"))
    return distinct.groupBy(
        *by, "chrom", "strand", (F.floor(F.col("pos") / CELL) * CELL).cast("bigint").alias("cell")
    ).agg(F.count(F.lit(1)).alias("n"))


def cut_profile(
    cuts: DataFrame, sizes: DataFrame, *, edges: str = "variable", by: Sequence[str] = (), step: int = 50, width: int = 200
) -> DataFrame:
    """Cut density of every bin of the grid, for every ``by`` that has cuts.

    Window [start-600, start+800) per strand, counts of distinct positions
    divided by the width of the profile bin; forward features first.  Bins
    with ``start + width >= length`` do not exist; bins that no cut reaches hold
    zeros.  Returns ``by, chrom, start, features``.
    """
    marks = EDGES[edges]
    pieces = len(marks) - 1
    low = F.greatest(F.lit(0), F.floor((F.col("cell") - (WINDOW - WINDOW_BEFORE)) / step) + 1).cast("bigint")
    high = F.floor((F.col("cell") + WINDOW_BEFORE) / step).cast("bigint")
    reach = (
        cut_cells(cuts, by)
        .join(broadcast_if_small(sizes.select("chrom", "length")), "chrom")
        .withColumn("__hi", F.least(high, F.floor((F.col("length") - width - 1) / step).cast("bigint")))
        .withColumn("__lo", low)
        .where("__lo <= __hi")
        .select(*by, "chrom", "strand", "cell", "n", F.explode(F.sequence(F.col("__lo") * step, F.col("__hi") * step, F.lit(step).cast("bigint"))).alias("start"))
        .withColumn("offset", F.col("cell") - (F.col("start") - WINDOW_BEFORE))
    )
    # every bin of the grid takes part with a cut count of zero
    last = F.floor((F.col("length") - width - 1) / step).cast("bigint")
    grid = sizes.where(F.col("length") > width)
    for c in by:  # the few values of each key, as a list
        grid = grid.withColumn(c, F.explode(cuts.agg(F.collect_set(c)).scalar()))
    if len(by) > 1:
        grid = grid.join(broadcast_if_small(cuts.select(*by).distinct()), list(by), "left_semi")
    grid = spread(grid.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / 4096)))))
    low_bin, high_bin = F.col("__part") * 4096, F.least(F.col("__part") * 4096 + 4095, last)
    grid = grid.select(*by, "chrom", F.explode(F.sequence(low_bin * step, high_bin * step, F.lit(step).cast("bigint"))).alias("start"))
    reach = reach.select(*by, "chrom", "start", "strand", "offset", "n").unionByName(grid.select(
        *by, "chrom", "start", F.lit("forward").alias("strand"), F.lit(0).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("n")))
    features = []
    for strand in ("forward", "reverse"):
        for a, b in zip(marks[:-1], marks[1:]):
            inside = (F.col("strand") == strand) & (F.col("offset") >= a) & (F.col("offset") < b)
            features.append(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)) / F.lit(float(b - a)))
    assert len(features) == 2 * pieces
    return reach.groupBy(*by, "chrom", "start").agg(F.array(*features).alias("features"))


def profile_names(spark, edges: str = "variable", prefix: str = "DNase_5_end") -> DataFrame:
    """Name table ``(feature_idx, feature_name)`` of a cut profile."""
    marks = EDGES[edges]
    rows = [
        (s * (len(marks) - 1) + i, a - 700, b - 700, strand)
        for s, strand in enumerate(("forward", "reverse"))
        for i, (a, b) in enumerate(zip(marks[:-1], marks[1:]))
    ]
    df = spark.createDataFrame(rows, "feature_idx int, low int, high int, strand string")
    return df.select("feature_idx", F.format_string(prefix + "_%d_%d_%s", "low", "high", "strand").alias("feature_name"))


def rename_features(names: DataFrame, *, prefix: str = "", suffix: str = "") -> DataFrame:
    return names.withColumn("feature_name", F.concat(F.lit(prefix), "feature_name", F.lit(suffix)))


def explode_features(tensor: DataFrame, keys: Sequence[str], *, features: str = "features") -> DataFrame:
    return tensor.select(*keys, F.posexplode(features).alias("feature_idx", "value"))


def _each(n: int, agg, features: str = "features") -> Column:
    return F.array(*[agg(F.get(features, F.lit(i))) for i in range(n)])


def stack_signal(tensor: DataFrame, samples: DataFrame) -> DataFrame:
    """Tensor rows of the listed samples."""
    return tensor.join(broadcast_if_small(samples.select("sample_id").distinct()), "sample_id", "left_semi")


def mean_signal(tensor: DataFrame, roles: DataFrame, n_features: int) -> DataFrame:
    """Mean over the samples of each role, per bin and feature."""
    return tensor.join(broadcast_if_small(roles), "sample_id").groupBy("role", *C).agg(_each(n_features, F.avg).alias("features"))


def slice_roles(samples: DataFrame, first: int, then: int) -> DataFrame:
    """Roles by position in the sample list: ``first`` train, ``then`` test."""
    order = Window.orderBy("sample_id")  # one row per sample: a short list
    n = samples.select("sample_id").distinct().withColumn("n", F.row_number().over(order))
    return n.where(F.col("n") <= first + then).select(
        "sample_id", F.when(F.col("n") <= first, "train").otherwise("test").alias("role")
    )


def sum_signal(tensor: DataFrame, cluster_map: DataFrame, n_features: int) -> DataFrame:
    """Sum of the samples of each cluster; samples without data are absent."""
    clusters = broadcast_if_small(cluster_map.select("sample_id", "cluster"))
    return tensor.join(clusters, "sample_id").groupBy("cluster", *C).agg(
        _each(n_features, F.sum).alias("features")
    )


def median_signal(tensor: DataFrame, n_features: int, bins: DataFrame | None = None) -> DataFrame:
    """Median over samples, per bin and feature (optionally for chosen bins)."""
    kept = tensor if bins is None else tensor.join(bins.select(*C), list(C), "left_semi")
    return kept.groupBy(*C).agg(_each(n_features, F.median).alias("features"))


def scale_by_chrom_max(df: DataFrame, chrom: str, *, features: str = "features") -> DataFrame:
    """Divide every feature by the largest value on one chromosome."""
    top = df.where(F.col("chrom") == chrom).agg(F.max(F.array_max(features))).scalar()
    return df.withColumn("__top", top).withColumn(
        features, F.transform(features, lambda x: x / F.col("__top"))
    ).drop("__top")


def scale_by_column_max(df: DataFrame, n_features: int, *, features: str = "features") -> DataFrame:
    """Divide each feature by its own maximum (0 where the maximum is 0)."""
    top = df.agg(_each(n_features, F.max, features)).scalar()
    return df.withColumn("__top", top).withColumn(
        features,
        F.zip_with(features, "__top", lambda x, m: F.when(m == 0, F.lit(0.0)).otherwise(x / m)),
    ).drop("__top")


def fold_strands(df: DataFrame, *, features: str = "features") -> DataFrame:
    """Add the reverse half onto the forward half."""
    half = (F.size(features) / 2).cast("int")
    return df.withColumn(
        features,
        F.zip_with(F.slice(features, F.lit(1), half), F.slice(features, half + 1, half), lambda a, b: a + b),
    )


def central_sum(df: DataFrame, *, features: str = "features", blocks=((9, 8), (33, 8)), name: str = "central") -> DataFrame:
    """Sum of the central 200 bp of both strands."""
    parts = [
        F.aggregate(F.slice(features, a, n), F.lit(0.0), lambda acc, x: acc + x) for a, n in blocks
    ]
    return df.withColumn(name, sum(parts[1:], parts[0]))


def fill_missing(df: DataFrame, *, features: str = "features") -> DataFrame:
    return df.withColumn(features, F.transform(features, lambda x: zero_if_missing(x.cast("double"))))


def feature_block(df: DataFrame, block: int, *, size: int = 120, features: str = "features") -> DataFrame:
    return df.withColumn(features, F.slice(features, block * size + 1, size))


def join_features(left: DataFrame, right: DataFrame, *, keys: Sequence[str] = C, features: str = "features") -> DataFrame:
    """Feature arrays of two tables side by side, matched by key."""
    other = right.select(*keys, F.col(features).alias("__right"))
    return left.join(other, list(keys)).withColumn(features, F.concat(features, "__right")).drop("__right")


def append_binary(left: DataFrame, extra: DataFrame, value: str, *, keys: Sequence[str] = C) -> DataFrame:
    """Append a 0/1 covariate (value > 0) to the feature array."""
    flagged = extra.select(*keys, F.array((F.col(value) > 0).cast("double")).alias("features"))
    return join_features(left, flagged, keys=keys)


def neighbour_blocks(df: DataFrame, keys: Sequence[str], halo: int, step: int, block: int = 4096) -> DataFrame:
    """Rows tagged with their block of ``block`` bins, plus copies of the
    ``halo`` rows next to each border, so that a window over one block sees
    every neighbour and no window covers a whole chromosome."""
    block = max(block, halo)
    idx = F.floor(F.col("start") / step).cast("bigint")
    home = F.floor(F.col("__idx") / block).cast("bigint")
    inside = F.col("__idx") - F.col("__home") * block
    copies = F.array_compact(
        F.array(
            F.col("__home"),
            F.when((inside < halo) & (F.col("__home") > 0), F.col("__home") - 1),
            F.when(inside >= block - halo, F.col("__home") + 1),
        )
    )
    return df.withColumn("__idx", idx).withColumn("__home", home).withColumn("__block", F.explode(copies))


def offset_features(
    df: DataFrame,
    offsets: Sequence[int],
    *,
    keys: Sequence[str] = ("chrom",),
    features: str = "features",
    step: int = 50,
    block: int = 4096,
) -> DataFrame:
    """Concatenate the feature arrays of the bins at ``offsets`` (offset-major).

    Neighbours are found by coordinate.  Those past the first or last bin of a
    chromosome repeat that bin; a bin missing in between counts as zeros.
    """
    halo = max(abs(o) for o in offsets)
    w = Window.partitionBy(*keys, "__block").orderBy("__idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = df.groupBy(*keys).agg(F.min("start").alias("__first"), F.max("start").alias("__last"))
    out = neighbour_blocks(df.join(broadcast_if_small(ends), list(keys)), keys, halo, step, block)
    zeros = F.transform(features, lambda x: x * 0)
    parts = []
    for o in offsets:
        if o == 0:
            parts.append(F.col(features))
            continue
        there = F.coalesce(F.first(features).over(w.rangeBetween(o, o)), zeros)
        at = F.col("start") + o * step
        parts.append(
            F.when(at < F.col("__first"), F.first(features).over(whole))
            .when(at > F.col("__last"), F.last(features).over(whole)).otherwise(there)
        )
    return (
        out.withColumn("__all", F.concat(*parts))
        .where("__block = __home")
        .withColumn(features, F.col("__all"))
        .drop("__all", "__idx", "__home", "__block", "__first", "__last")
    )


def shifted(
    df: DataFrame, wanted: Mapping[str, tuple[str, int]], *, keys: Sequence[str] = ("chrom",), step: int = 50, block: int = 4096
) -> DataFrame:
    """Add columns holding another row's value: name -> (column, offset).

    Rows are found by coordinate; where there is none, as past the chromosome
    ends, the value is 0.
    """
    halo = max(abs(o) for _, o in wanted.values())
    w = Window.partitionBy(*keys, "__block").orderBy("__idx")
    out = neighbour_blocks(df, keys, halo, step, block)
    cols = {
        name: F.col(c) if o == 0 else F.coalesce(F.first(c).over(w.rangeBetween(o, o)), F.lit(0.0))
        for name, (c, o) in wanted.items()
    }
    return out.withColumns(cols).where("__block = __home").drop("__idx", "__home", "__block")


def profile_from_centre(df: DataFrame, a: str, b: str, *, keys: Sequence[str] = ("chrom",), bin_size: int = 25, step: int = 50) -> DataFrame:
    """Rebuild the 24-column profile from the two central 25-bp columns: 25-,
    50- and 100-bp means taken at growing distances."""
    base = df.withColumn("__c12", F.round(F.col(a) / bin_size, 3)).withColumn("__c13", F.round(F.col(b) / bin_size, 3))
    base = shifted(base, {"__c14": ("__c12", 1), "__c15": ("__c13", 1)}, keys=keys, step=step)
    base = base.withColumn("__x50", F.round((F.col("__c12") + F.col("__c13")) / 2, 3)).withColumn(
        "__x100", F.round((F.col("__c12") + F.col("__c13") + F.col("__c14") + F.col("__c15")) / 4, 3)
    )
    # fixed values: source column and row distance of each profile column
    layout = (
        [("__x100", o) for o in (-14, -12, -10, -8)]
        + [("__x50", o) for o in (-6, -5, -4, -3)]
        + [("__c12", -2), ("__c13", -2), ("__c12", -1), ("__c13", -1), ("__c12", 0), ("__c13", 0), ("__c12", 1), ("__c13", 1)]
        + [("__x50", o) for o in (2, 3, 4, 5)]
        + [("__x100", o) for o in (6, 8, 10, 12)]
    )
    wanted = {f"__p{i}": spec for i, spec in enumerate(layout)}
    out = shifted(base, wanted, keys=keys, step=step)
    return out.withColumn("profile", F.array(*[F.col(n) for n in wanted])).drop(
        *wanted, "__c12", "__c13", "__c14", "__c15", "__x50", "__x100"
    )
