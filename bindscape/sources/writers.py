"""Writers matching the readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bindscape.operators.labels import wide_labels


def write_bed(df: DataFrame, path: str, columns: Sequence[str] = ("chrom", "start", "stop")) -> None:
    """Headerless TSV, sorted by coordinate."""
    df.select(*columns).orderBy("chrom", "start").write.option("sep", "\t").csv(path)


def write_labels(labels: DataFrame, path: str, cells: Sequence[str]) -> None:
    """Label TSV with a header and one column per cell type."""
    wide = wide_labels(labels, cells)
    wide.orderBy("chrom", "start").write.option("sep", "\t").option("header", True).csv(path)


def round_scores(df: DataFrame, column: str = "margin", decimals: int = 2) -> DataFrame:
    """Scores as they appear in the score files."""
    return df.withColumn(column, F.round(column, decimals))


def write_margins(df: DataFrame, path: str) -> None:
    """One directory per chromosome, margins with two decimals."""
    out = round_scores(df).select("chrom", "start", "stop", "margin")
    out.repartition("chrom", F.floor(F.col("start") / 5_000_000)).sortWithinPartitions("chrom", "start").write.partitionBy(
        "chrom"
    ).option("sep", "\t").csv(path)


def write_tensor(df: DataFrame, path: str, *, block: int = 5_000_000) -> None:
    """Parquet by chromosome and sample, float arrays, blocks of coordinates."""
    out = df.withColumn("features", F.col("features").cast("array<float>"))
    out.repartition("chrom", "sample_id", F.floor(F.col("start") / block)).sortWithinPartitions(
        "chrom", "sample_id", "start"
    ).write.partitionBy("chrom", "sample_id").parquet(path)


def write_ranks(df: DataFrame, path: str) -> None:
    """Aggregated ranks as JSON lines."""
    df.select("item", "rank").orderBy("rank").write.json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Metric, confusion-region and curve tables as TSV with a header."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def write_fasta(seqs: DataFrame, path: str, *, width: int = 60) -> None:
    """``chrom, seq`` as FASTA with lines of ``width`` bases."""
    body = F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})(?!$)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), body)).write.text(path)
