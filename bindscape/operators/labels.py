"""Bound / ambiguous / unbound labels from replicate peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bindscape.functions.scalars import label_of
from bindscape.operators.intervals import bins_hit


def at_least(df: DataFrame, quality: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= quality)


def consensus_labels(
    bins: DataFrame,
    summits: DataFrame,
    peaks: DataFrame,
    *,
    q: float | None = None,
    top_n: int | None = None,
    min_support: int = 2,
    samples: DataFrame | None = None,
    sample: str = "sample_id",
    width: int = 200,
    step: int = 50,
) -> DataFrame:
    """B where enough replicates have a summit in the bin, A where only peaks
    do, U elsewhere.

    Support counts distinct samples.  ``samples`` is the replicate list
    (default: the samples seen in ``peaks``); a lone replicate is enough by
    itself.  Rows are chosen by score (``q``) or file order (``top_n``).
    """
    listed = samples if samples is not None else peaks.select(sample)
    n_rep = listed.agg(F.count_distinct(F.col(sample))).scalar()

    def chosen(df: DataFrame) -> DataFrame:
        if q is not None:
            df = df.where(F.col("score") >= q)
        if top_n is not None:
            df = df.where(F.col("file_rank") <= top_n)
        return df.select("chrom", "start", "stop", sample)

    hits = bins_hit(
        chosen(summits).withColumn("kind", F.lit(1)).unionByName(chosen(peaks).withColumn("kind", F.lit(0))),
        width=width,
        step=step,
    )
    # one row per (bin, sample): in the peak set, in the summit set, or both
    per_sample = hits.groupBy("chrom", F.col("bin_start").alias("start"), sample).agg(
        F.max("kind").alias("summit"), F.max(1 - F.col("kind")).alias("peak")
    )
    stacked = bins.select(
        "chrom", "start", F.lit(1).alias("grid"), F.lit(0).alias("summit"), F.lit(0).alias("peak")
    ).unionByName(per_sample.select("chrom", "start", F.lit(0).alias("grid"), "summit", "peak"))
    counted = (
        stacked.groupBy("chrom", "start")
        .agg(
            F.max("grid").alias("grid"),
            F.sum("summit").cast("bigint").alias("summit_support"),
            F.sum("peak").cast("bigint").alias("peak_support"),
        )
        .where("grid = 1")
    )
    need = F.least(F.lit(min_support), n_rep)
    return counted.select(
        "chrom",
        "start",
        (F.col("start") + width).alias("stop"),
        "summit_support",
        "peak_support",
        label_of(F.col("summit_support") >= need, F.col("peak_support") >= need).alias("label"),
    )


def cluster_labels(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per cluster column: U where the count is 0, else B."""
    return counts.select(
        "chrom", "start", "stop",
        *[F.when(F.col(c) == 0, F.lit("U")).otherwise(F.lit("B")).alias(c) for c in columns],
    )


def binary_labels(labels: DataFrame, chrom: str | None = None) -> DataFrame:
    """Label B as 1, anything else as 0, optionally for one chromosome."""
    kept = labels if chrom is None else labels.where(F.col("chrom") == chrom)
    return kept.select("chrom", "start", "stop", (F.col("label") == "B").cast("int").alias("y"))


def agreeing(a: DataFrame, b: DataFrame, on: Sequence[str], label: str = "label") -> DataFrame:
    """Rows on which two label tables agree."""
    other = b.select(*on, F.col(label).alias("__other"))
    return a.join(other, list(on)).where(F.col(label) == F.col("__other")).drop("__other")


def drop_ambiguous(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != "A")


def weighted_target(df: DataFrame, label: str = "label") -> DataFrame:
    """``y`` = bound, ``weight`` = 0 on ambiguous rows."""
    return df.withColumn("y", (F.col(label) == "B").cast("int")).withColumn(
        "weight", (F.col(label) != "A").cast("int")
    )


def drop_shared_peaks(df: DataFrame, fold: str = "log2fc", y: str = "y", limit: float = 2.0) -> DataFrame:
    """Keep negatives, and positives whose peak differs between the samples."""
    return df.where((F.abs(F.col(fold)) > limit) | (F.col(y) == 0))


def label_table(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate label tables of one factor (training and held-out cells)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wide_labels(labels: DataFrame, cells: Sequence[str], cell: str = "cell_type") -> DataFrame:
    """Long labels to one column per cell type, U where a cell has no row."""
    pick: list[Column] = [
        F.coalesce(F.max(F.when(F.col(cell) == c, F.col("label"))), F.lit("U")).alias(c) for c in cells
    ]
    return labels.groupBy("chrom", "start", "stop").agg(*pick)


def region_values(bins_labels: DataFrame, regions: DataFrame, *, trim: int = 150, value: int = 10) -> DataFrame:
    """Fixed regions marked ``value`` where merged bound bins (trimmed to their
    first 50 bp) overlap them, else 0."""
    from bindscape.operators.intervals import count_overlaps, merge_intervals

    bound = bins_labels.where(F.col("label") == "B").select("chrom", "start", (F.col("stop") - trim).alias("stop"))
    merged = merge_intervals(bound).select("chrom", "start", "stop")
    counted = count_overlaps(regions, merged)
    return counted.select(*regions.columns, F.when(F.col("n_overlap") != 0, value).otherwise(0).alias("value"))
