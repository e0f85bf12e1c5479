"""Sample selection, job tables, set operations and seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bindscape.functions.hashing import hash_below, stable_hash
from bindscape.functions.prefix import hash_index
from bindscape.functions.scalars import cell_name
from bindscape.functions.session import broadcast_if_small, settle
from bindscape.operators.peaks import best_row_per  # noqa: F401  (public here as well)


def match_cell_type(meta: DataFrame, cells: DataFrame, *, min_quality: float | None = 0.05) -> DataFrame:
    """Samples whose line (or line_type_tissue when the line is NONE) is one of
    the wanted cell types, ignoring case.  ``cells``: ``role, cell``."""
    kept = meta if min_quality is None else meta.where(F.col("quality") > min_quality)
    wanted = broadcast_if_small(cells.select("role", F.upper("cell").alias("__cell")))
    return kept.withColumn("__cell", cell_name(F.col("line"), F.col("kind"), F.col("tissue"))).join(
        wanted, "__cell"
    ).drop("__cell")


def loaded_only(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """Samples that have data."""
    return samples.join(catalog.select("sample_id").distinct(), "sample_id", "left_semi")


def top_quality(samples: DataFrame, n: int, *, by: Sequence[str] = ("role",)) -> DataFrame:
    """The ``n`` best samples per role by numeric quality (ties by id)."""
    from pyspark.sql import Window

    # "row_number <= n" is cut to n rows per task and role before the shuffle
    order = Window.partitionBy(*by).orderBy(F.col("quality").desc(), F.col("sample_id"))
    return samples.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def select_samples(meta: DataFrame, cells: DataFrame, catalog: DataFrame, *, min_quality: float = 0.05, top: int = 10) -> DataFrame:
    """Accessibility samples per role: match, quality, loaded, best ``top``."""
    return top_quality(loaded_only(match_cell_type(meta, cells, min_quality=min_quality), catalog), top)


def select_chip(meta: DataFrame, factor: str, cell: str, catalog: DataFrame | None = None) -> DataFrame:
    """Binding samples of one factor in one cell type, those in ``catalog`` when it
    is given; ``weight`` is 2 for a lone sample, which then supports itself twice."""
    name = cell_name(F.col("line"), F.col("kind"), F.col("tissue"))
    kept = meta.where((F.col("factor") == factor) & (name == cell.upper())).select("sample_id")
    if catalog is not None:
        kept = loaded_only(kept, catalog)
    n = kept.agg(F.count(F.lit(1))).scalar()
    return kept.withColumn("weight", F.when(n == 1, 2).otherwise(1))


def match_factor_key(meta: DataFrame, key: str) -> DataFrame:
    """Composite key factor_line_type_tissue equality."""
    return meta.where(F.concat_ws("_", "factor", "line", "kind", "tissue") == key)


def annotate_clusters(samples: DataFrame, cluster_map: DataFrame) -> DataFrame:
    """Left join of the distinct annotations of included clusters."""
    notes = cluster_map.where(F.col("included") == "Y").select("cluster", "annotation").distinct()
    return samples.join(broadcast_if_small(notes), "cluster", "left")


def reliable_pairs(targets: DataFrame, reliable: DataFrame, test_cell: str) -> DataFrame:
    """Train cells known to work for each target factor, with the test cell."""
    return reliable.join(broadcast_if_small(targets.select("factor").distinct()), "factor").select(
        "factor", "train_cell", F.upper(F.lit(test_cell)).alias("test_cell")
    )


def training_jobs(pairs: DataFrame, chrom_sets: Sequence[str] = ("chrom_setA", "chrom_setB")) -> DataFrame:
    """One job per (factor, cell) and chromosome set."""
    return pairs.select("factor", "cell", F.explode(F.array(*[F.lit(s) for s in chrom_sets])).alias("chrom_set"))


def in_chrom_set(df: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Rows on the chromosomes of a named set (``sets``: ``set_name, chrom``)."""
    chroms = broadcast_if_small(sets.where(F.col("set_name") == name).select("chrom").distinct())
    return df.join(chroms, "chrom", "left_semi")


def sample_rows(df: DataFrame, n: int, *, seed: int = 2019, key: Sequence[str], replace: bool = True) -> DataFrame:
    """``n`` rows drawn by hash, with or without replacement.

    With replacement, draw i takes the row at a hashed index; ``draw`` numbers
    the draws.  Rows are indexed in hash order, so the result does not depend
    on partitioning.
    """
    indexed = hash_index(df, (), key, seed)
    if not replace:
        return indexed.where(F.col("idx") < n).drop("idx")
    indexed = settle(indexed)
    total = indexed.count()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), F.pmod(stable_hash(seed, F.lit("draw"), "id"), F.lit(total)).alias("idx")
    )
    return indexed.join(draws, "idx").drop("idx")


def holdout_split(df: DataFrame, *, percent: int = 20, seed: int = 2019, key: Sequence[str] = ("chrom", "start"), name: str = "is_valid") -> DataFrame:
    return df.withColumn(name, hash_below(seed, percent, *key))


def fold_column(df: DataFrame, k: int, *, seed: int = 2019, key: Sequence[str] = ("chrom", "start")) -> DataFrame:
    return df.withColumn("fold", F.pmod(stable_hash(seed, *key), F.lit(k)).cast("int"))


def fraction_subset(df: DataFrame, one_in: int, *, seed: int, key: Sequence[str]) -> DataFrame:
    """About one row in ``one_in``, by hash."""
    return df.where(F.pmod(stable_hash(seed, *key), F.lit(one_in)) == 0)


def shuffle_column(df: DataFrame, column: str, *, key: Sequence[str], seed: int = 1, name: str | None = None) -> DataFrame:
    """Permute one column: rows are indexed in hash order and the row at index
    i takes the value at index i + shift (mod n)."""
    indexed = settle(hash_index(df, (), key, seed))
    n = indexed.count()
    shift = 1 + seed % max(n - 1, 1)
    donors = indexed.select(F.pmod(F.col("idx") - shift, F.lit(n)).alias("idx"), F.col(column).alias("__new"))
    return indexed.join(donors, "idx").withColumn(name or column, F.col("__new")).drop("__new", "idx")
