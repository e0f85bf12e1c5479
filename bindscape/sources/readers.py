"""Text, JSON and Parquet readers with fixed schemas (nothing is inferred)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindscape.functions.prefix import value_index
from bindscape.functions.session import settle

# fixed values: 1-based score column of each peak format
SCORE_COLUMN = {"summit": 5, "narrowpeak": 9}
PEAK_WIDTH = {"summit": 5, "narrowpeak": 10}


def _tsv(spark: SparkSession, path: str, names: Sequence[str], *, sep: str = "\t", header: bool = False) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_bed(spark: SparkSession, path: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """Headerless BED: chrom, start, stop and further typed columns."""
    cols = {"chrom": "string", "start": "bigint", "stop": "bigint", **(extra or {})}
    schema = ", ".join(f"`{n}` {t}" for n, t in cols.items())
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_peaks(
    spark: SparkSession, path: str, kind: str = "narrowpeak", *, sample_pattern: str = r"([^/_]+)_[^/]*$", rank_by: str = "score"
) -> DataFrame:
    """Peak or summit files; ``sample_id`` is cut from the file path (default:
    the file name up to the first '_').  ``file_rank`` orders each sample by
    falling score, then position, or with ``rank_by="file"`` by the lines of its
    files."""
    names = [f"c{i}" for i in range(1, PEAK_WIDTH[kind] + 1)]
    score = F.col(f"c{SCORE_COLUMN[kind]}").cast("double")
    df = _tsv(spark, path, names).select(
        F.regexp_extract(F.col("_metadata.file_path"), sample_pattern, 1).alias("sample_id"),
        F.col("c1").alias("chrom"), F.col("c2").cast("bigint").alias("start"), F.col("c3").cast("bigint").alias("stop"),
        score.alias("score"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )
    if rank_by == "file":
        # a block of a file is read in order by one task
        ranked = value_index(settle(df), ["sample_id"], "__file", ["__block", "__line"], name="file_rank")
    else:
        ranked = value_index(df, ["sample_id"], "score", ["chrom", "start", "stop"], name="file_rank", descending=True)
    return ranked.drop("__file", "__block", "__line")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label table: three fixed columns, then one column per cell type (long form)."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    chrom, start, stop, *cells = wide.columns
    return wide.unpivot([chrom, start, stop], cells, "cell_type", "label").select(
        F.col(chrom).alias("chrom"), F.col(start).cast("bigint").alias("start"),
        F.col(stop).cast("bigint").alias("stop"), "cell_type", "label",
    )


def read_positional(spark: SparkSession, path: str, columns: Mapping[str, tuple[int, str]], *, sep: str = "\t", header: bool = True, width: int = 64) -> DataFrame:
    """Metadata by 1-based column position: name -> (position, type)."""
    df = _tsv(spark, path, [f"c{i}" for i in range(1, width + 1)], sep=sep, header=header)
    return df.select(*[F.expr(f"try_cast(c{i} AS {t})").alias(n) for n, (i, t) in columns.items()])


# fixed values: column positions of the two metadata tables
ACCESSIBILITY_COLUMNS = {
    "sample_id": (1, "string"), "line": (7, "string"), "kind": (8, "string"), "tissue": (9, "string"), "quality": (27, "double"),
}
BINDING_COLUMNS = {
    "sample_id": (1, "string"), "factor": (3, "string"), "line": (9, "string"), "kind": (10, "string"),
    "tissue": (11, "string"), "quality": (36, "double"),
}


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "sample_id string, cluster int, tissue string, celltypes string, celllines string, included string, annotation string"
    ).option("header", True).csv(path)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, length bigint").option("sep", "\t").csv(path)


def read_motif_zscores(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a nested z-score per motif; ``scan`` is the file name."""
    df = spark.read.schema("id string, seqpos_results struct<zscore: double>").json(path)
    return df.select(
        F.col("_metadata.file_name").alias("scan"), F.col("id").alias("name"), F.col("seqpos_results.zscore").alias("zscore")
    )


def read_json_list(spark: SparkSession, path: str, name: str = "item") -> DataFrame:
    """A file holding one JSON list of strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias(name))


def read_pwms(spark: SparkSession, path: str) -> DataFrame:
    """One matrix per file: ``motif, pos, a, c, g, t``; lines starting with '#'
    or '>' are comments, the motif is the file name without '.pwm'."""
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.pwm$", "").alias("motif"), "value"
    )
    lines = F.filter(F.split("value", "\r?\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#") & ~s.startswith(">"))
    cells = files.select("motif", F.posexplode(lines).alias("pos", "line")).withColumn("w", F.split(F.trim("line"), r"\s+"))
    return cells.select("motif", "pos", *[F.element_at("w", i + 1).cast("double").alias(b) for i, b in enumerate("acgt")])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, seq``: one record per '>' header."""
    records = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)"), r"\s", "")
    return records.select(F.element_at(F.split(F.trim(head), r"\s+"), 1).alias("chrom"), body.alias("seq"))


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line_no, line``: the lines of FASTA files; ``line_no`` grows along a
    file block and blocks follow each other by their offset, so a sequence needs no row of its own."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def read_tensor(spark: SparkSession, path: str, *, chrom: str | None = None, samples: Sequence | None = None) -> DataFrame:
    """Feature tensor; chromosome and sample choices prune partitions."""
    df = spark.read.parquet(path)
    if chrom is not None:
        df = df.where(F.col("chrom") == chrom)
    if samples is not None:
        df = df.where(F.col("sample_id").isin(*samples))
    return df


def read_margins(spark: SparkSession, path: str) -> DataFrame:
    """Per-chromosome margin tables (partitioned by ``chrom``)."""
    return spark.read.schema("start bigint, stop bigint, margin double, chrom string").option("sep", "\t").csv(path)
