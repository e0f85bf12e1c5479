"""Tables written in the domain's file formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions.session import scratch_path, settle
from bindscape.operators import signal as sg
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql
from bindscape.sources import readers as rd, writers as wr


@query(sql("SELECT chrom, start, stop FROM grid"))
def bed_files(spark, sf):
    path = scratch_path(spark, "bins-bed")
    wr.write_bed(v.bins(spark, sf), path)
    return rd.read_bed(spark, path)


@query(sql("""SELECT CAST(sample_id AS VARCHAR) AS sample_id, chrom, start, stop, score, row_number() OVER (PARTITION BY sample_id
    ORDER BY score DESC, chrom, start, stop) AS file_rank FROM peaks"""))
def narrow_peak_files(spark, sf):
    path = scratch_path(spark, "peaks")
    p = v.peaks(spark, sf).select(
        "sample_id", "chrom", "start", "stop", F.lit(".").alias("c4"), F.lit(0).alias("c5"), F.lit(".").alias("c6"),
        F.lit(0.0).alias("c7"), F.lit(0.0).alias("c8"), F.col("score").alias("c9"), F.lit(-1).alias("c10"),
    )
    p.write.partitionBy("sample_id").option("sep", "\t").csv(path)
    out = rd.read_peaks(spark, path, sample_pattern="sample_id=([^/]+)/")
    return out.select("sample_id", "chrom", "start", "stop", "score", "file_rank")


_LAB = """SELECT g.chrom, g.start, g.stop, 'cell_' || CAST(s.s AS VARCHAR) AS cell_type, CASE WHEN h.chrom IS NULL THEN 'U' ELSE 'B' END AS label
    FROM (SELECT DISTINCT chrom, bin_start AS start, bin_start+200 AS stop FROM summit_hits) g CROSS JOIN (SELECT unnest(range(0, 4)) AS s) s
    LEFT JOIN (SELECT DISTINCT chrom, bin_start, sample_id FROM summit_hits) h ON h.chrom=g.chrom AND h.bin_start=g.start AND h.sample_id=s.s"""


@query(sql(_LAB))
def label_files(spark, sf):
    from bindscape.operators.intervals import bins_hit

    path = scratch_path(spark, "labels")
    hits = bins_hit(v.summits(spark, sf)).select(
        "chrom", F.col("bin_start").alias("start"), (F.col("bin_start") + 200).alias("stop"),
        F.concat(F.lit("cell_"), F.col("sample_id").cast("string")).alias("cell_type"), F.lit("B").alias("label"),
    ).distinct()
    wr.write_labels(hits, path, [f"cell_{k}" for k in range(4)])
    return rd.read_labels(spark, path)


@query(sql("SELECT chrom, start, stop, margin FROM margins"))
def margin_files(spark, sf):
    path = scratch_path(spark, "margins")
    wr.write_margins(v.margins(spark, sf), path)
    return rd.read_margins(spark, path).select("chrom", "start", "stop", "margin")


@query(sql("SELECT sample_id, chrom, start, feature_idx, CAST(value AS DOUBLE) AS value FROM tlong WHERE chrom='chr1' AND sample_id IN (1, 3)"))
def tensor_store_slice(spark, sf):
    path = scratch_path(spark, "tensor")
    wr.write_tensor(v.tensor(spark, sf), path)
    part = rd.read_tensor(spark, path, chrom="chr1", samples=[1, 3])
    long = sg.explode_features(part, ["sample_id", "chrom", "start"])
    return long.select("sample_id", "chrom", "start", F.col("feature_idx").cast("bigint").alias("feature_idx"), F.col("value").cast("double").alias("value"))


@query(sql("SELECT p_brand AS name, CAST(sum(p_size) AS DOUBLE) AS zscore FROM part GROUP BY p_brand"))
def nested_json_lines(spark, sf):
    path = scratch_path(spark, "zscores")
    z = v.table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("zscore"))
    z.select(F.col("p_brand").alias("id"), F.struct("zscore").alias("seqpos_results")).write.json(path)
    return rd.read_motif_zscores(spark, path).select("name", "zscore")


@query(sql("SELECT CAST(expert AS VARCHAR) || '/' || item AS item, rank FROM expert_ranks"))
def rank_json_lines(spark, sf):
    path = scratch_path(spark, "ranks")
    named = F.concat(F.col("expert").cast("string"), F.lit("/"), "item")
    wr.write_ranks(v.expert_ranks(spark, sf).withColumn("item", named), path)
    return spark.read.schema("item string, rank bigint").json(path)


@query(sql("SELECT sample_id, chrom, start, CAST(list_sum(features) AS BIGINT) AS total FROM tensor WHERE sample_id IN (2, 4, 6)"))
def sample_slice(spark, sf):
    t = v.tensor(spark, sf)
    wanted = t.select("sample_id").where(F.col("sample_id").isin(2, 4, 6))
    out = sg.stack_signal(t, wanted)
    return out.select("sample_id", "chrom", "start", F.aggregate("features", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(sql("SELECT chrom, start, feature_idx, median(value) AS value FROM tlong WHERE start IN (SELECT start FROM tensor WHERE sample_id=0 AND features[1]>10) GROUP BY ALL")
       .replace("WHERE start IN (SELECT start FROM tensor WHERE sample_id=0 AND features[1]>10)", "SEMI JOIN (SELECT chrom, start FROM tensor WHERE sample_id=0 AND features[1]>10) USING (chrom, start)"))
def selected_bin_median(spark, sf):
    t = settle(v.tensor(spark, sf))
    bins = t.where((F.col("sample_id") == 0) & (F.get("features", F.lit(0)) > 10)).select("chrom", "start")
    out = sg.median_signal(t, 64, bins)
    return sg.explode_features(out, ["chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


