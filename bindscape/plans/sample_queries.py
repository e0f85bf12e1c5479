"""Sample lists, job tables, set operations and seeded sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions.hashing import HASH_BITS  # noqa: F401
from bindscape.operators import labels as lb, samples as sm
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import md5_hash, sql

CELLS = [("train", "machinery"), ("test", "none_nation_3_r3"), ("test", "Building")]
NAME = "CASE WHEN upper(line)='NONE' THEN upper(line || '_' || kind || '_' || tissue) ELSE upper(line) END"
MATCH = {
    "cells": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{c}')" for r, c in CELLS) + ") t(role, cell)",
    "matched": f"SELECT m.*, c.role FROM sample_meta m JOIN cells c ON {NAME}=upper(c.cell) WHERE quality > 0.05",
    "loaded": "SELECT DISTINCT o_custkey AS sample_id FROM orders",
}


def _cells(spark):
    return spark.createDataFrame(CELLS, "role string, cell string")


def _loaded(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"))


@query(sql("SELECT sample_id, role, quality FROM matched", **MATCH))
def cell_type_match(spark, sf):
    return sm.match_cell_type(v.sample_meta(spark, sf), _cells(spark)).select("sample_id", "role", "quality")


@query(sql("SELECT sample_id, role FROM matched WHERE sample_id IN (SELECT sample_id FROM loaded)", **MATCH))
def loaded_samples(spark, sf):
    return sm.loaded_only(sm.match_cell_type(v.sample_meta(spark, sf), _cells(spark)), _loaded(spark, sf)).select("sample_id", "role")


@query(sql("""SELECT sample_id, role, quality FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY quality DESC, sample_id) AS r
    FROM matched WHERE sample_id IN (SELECT sample_id FROM loaded)) WHERE r<=10""", **MATCH))
def select_accessibility_samples(spark, sf):
    return sm.select_samples(v.sample_meta(spark, sf), _cells(spark), _loaded(spark, sf)).select("sample_id", "role", "quality")


@query(sql("SELECT sample_id, factor, quality FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY quality DESC, sample_id) AS r FROM sample_meta) WHERE r<=30"))
def top_quality_samples(spark, sf):
    return sm.top_quality(v.sample_meta(spark, sf), 30, by=["factor"]).select("sample_id", "factor", "quality")


@query(sql(f"SELECT sample_id, CASE WHEN count(*) OVER ()=1 THEN 2 ELSE 1 END AS weight FROM sample_meta WHERE factor='TF3' AND {NAME}='MACHINERY'"))
def select_binding_samples(spark, sf):
    return sm.select_chip(v.sample_meta(spark, sf), "TF3", "machinery")


@query(sql("SELECT sample_id, factor FROM sample_meta WHERE factor || '_' || line || '_' || kind || '_' || tissue = 'TF2_BUILDING_NATION_1_R1'"
           ).replace("'TF2_BUILDING_NATION_1_R1'", "(SELECT factor || '_' || line || '_' || kind || '_' || tissue FROM sample_meta WHERE sample_id=1)"))
def composite_factor_match(spark, sf):
    meta = v.sample_meta(spark, sf)
    key = meta.where("sample_id = 1").select(F.concat_ws("_", "factor", "line", "kind", "tissue")).first()[0]
    return sm.match_factor_key(meta, key).select("sample_id", "factor")


NOTES = "SELECT DISTINCT cluster, 'note_' || tissue AS annotation FROM sample_meta WHERE included='Y'"


@query(sql("SELECT s.sample_id, s.cluster, n.annotation FROM sample_meta s LEFT JOIN notes n ON s.cluster=n.cluster", notes=NOTES))
def cluster_annotation_join(spark, sf):
    meta = v.sample_meta(spark, sf)
    cmap = meta.select("cluster", "included", F.concat(F.lit("note_"), "tissue").alias("annotation"))
    return sm.annotate_clusters(meta.select("sample_id", "cluster"), cmap)


@query(sql("SELECT DISTINCT cluster, 'note_' || tissue AS annotation FROM sample_meta WHERE included='Y'"))
def included_annotations(spark, sf):
    m = v.sample_meta(spark, sf)
    return m.where("included = 'Y'").select("cluster", F.concat(F.lit("note_"), "tissue").alias("annotation")).distinct()


@query(sql("SELECT DISTINCT m.factor, m.line AS train_cell, 'LIVER' AS test_cell FROM sample_meta m WHERE quality>0.9 AND factor IN (SELECT factor FROM sample_meta WHERE quality>0.99)"))
def reliable_pair_lookup(spark, sf):
    m = v.sample_meta(spark, sf)
    reliable = m.where("quality > 0.9").select("factor", F.col("line").alias("train_cell")).distinct()
    return sm.reliable_pairs(m.where("quality > 0.99"), reliable, "liver")


@query(sql("SELECT factor, cell, chrom_set FROM (SELECT DISTINCT factor, line AS cell FROM sample_meta) CROSS JOIN (SELECT unnest(['chrom_setA','chrom_setB']) AS chrom_set)"))
def training_job_table(spark, sf):
    pairs = v.sample_meta(spark, sf).select("factor", F.col("line").alias("cell")).distinct()
    return sm.training_jobs(pairs)


@query(sql("SELECT DISTINCT event_id, chrom, start FROM peaks WHERE chrom IN ('click', 'view')"))
def chrom_set_selection(spark, sf):
    sets = spark.createDataFrame([("A", "click"), ("A", "view"), ("B", "error")], "set_name string, chrom string")
    return sm.in_chrom_set(v.peaks(spark, sf), sets, "A").select("event_id", "chrom", "start")


@query(sql("SELECT event_id, chrom, start, score FROM peaks WHERE score >= 5"))
def score_threshold(spark, sf):
    return lb.at_least(v.peaks(spark, sf), 5).select("event_id", "chrom", "start", "score")


@query(sql("SELECT event_id, start, stop FROM peaks WHERE chrom='signup'"))
def single_chrom_filter(spark, sf):
    return v.peaks(spark, sf).where(F.col("chrom") == "signup").select("event_id", "start", "stop")


@query(sql("SELECT a.doc_id, a.label FROM label_a a JOIN label_b b USING (doc_id) WHERE a.label=b.label"))
def label_agreement(spark, sf):
    a, b = v.label_pair(spark, sf)
    return lb.agreeing(a, b, ["doc_id"])


@query(sql("SELECT l_orderkey, l_linenumber, y, fold AS log2fc FROM (SELECT l_orderkey, l_linenumber, CAST(label='B' AS INTEGER) AS y, margin*2 AS fold FROM scored_labels) WHERE abs(fold)>2 OR y=0"))
def shared_peak_exclusion(spark, sf):
    df = lb.weighted_target(v.scored_labels(spark, sf)).withColumn("log2fc", F.col("margin") * 2)
    return lb.drop_shared_peaks(df).select("l_orderkey", "l_linenumber", "y", "log2fc")


@query(sql("SELECT doc_id, label, 'train' AS part FROM label_a UNION ALL SELECT doc_id, label, 'test' AS part FROM label_b"))
def label_table_union(spark, sf):
    a, b = v.label_pair(spark, sf)
    return lb.label_table([a.withColumn("part", F.lit("train")), b.withColumn("part", F.lit("test"))])


@query(sql("SELECT doc_id FROM label_a WHERE label='U' EXCEPT SELECT doc_id FROM label_b WHERE label='U'"))
def label_set_difference(spark, sf):
    a, b = v.label_pair(spark, sf)
    return a.where("label = 'U'").select("doc_id").join(b.where("label = 'U'").select("doc_id"), "doc_id", "left_anti")


@query(sql("SELECT sample_id FROM sample_meta WHERE quality>0.5 INTERSECT SELECT sample_id FROM loaded", **MATCH))
def sample_id_intersection(spark, sf):
    return v.sample_meta(spark, sf).where("quality > 0.5").select("sample_id").intersect(_loaded(spark, sf))


@query(sql("SELECT DISTINCT chrom, start, stop FROM summits WHERE file_rank<=5000"))
def pooled_summits_distinct(spark, sf):
    return v.summits(spark, sf, True).where("file_rank <= 5000").select("chrom", "start", "stop").distinct()


@query(sql("SELECT a.chrom, a.start, a.stop, a.margin, b.n_overlap FROM margins a JOIN (SELECT g.chrom, g.start, count(h.event_id) AS n_overlap FROM grid g LEFT JOIN peak_hits h ON g.chrom=h.chrom AND g.start=h.bin_start GROUP BY ALL) b USING (chrom, start)"))
def keyed_column_zip(spark, sf):
    from bindscape.operators.intervals import count_bins

    n = count_bins(v.bins(spark, sf), v.peaks(spark, sf)).select("chrom", "start", "n_overlap")
    return v.margins(spark, sf).join(n, ["chrom", "start"]).select("chrom", "start", "stop", "margin", "n_overlap")


_IDX = {"hashed": f"SELECT event_id, chrom, start, row_number() OVER (ORDER BY {md5_hash(6, 'event_id')}, event_id)-1 AS idx, count(*) OVER () AS n FROM peaks"}


@query(sql("SELECT event_id, chrom, start FROM hashed WHERE idx<700", **_IDX))
def sample_without_replacement(spark, sf):
    out = sm.sample_rows(v.peaks(spark, sf), 700, seed=6, key=["event_id"], replace=False)
    return out.select("event_id", "chrom", "start")


@query(sql("SELECT d.draw, h.event_id, h.chrom, h.start FROM (SELECT i AS draw, " + md5_hash(6, "'draw'", "i") + " AS k FROM (SELECT unnest(range(0, 700)) AS i)) d JOIN hashed h ON h.idx=d.k%h.n", **_IDX))
def sample_with_replacement(spark, sf):
    out = sm.sample_rows(v.peaks(spark, sf), 700, seed=6, key=["event_id"])
    return out.select("draw", "event_id", "chrom", "start")


@query(sql(f"SELECT chrom, start, {md5_hash(2019, 'chrom', 'start')}%100<20 AS is_valid FROM grid"))
def train_valid_split(spark, sf):
    return sm.holdout_split(v.bins(spark, sf)).select("chrom", "start", "is_valid")


@query(sql(f"SELECT l_orderkey, l_linenumber, CAST({md5_hash(2019, 'l_orderkey', 'l_linenumber')}%6 AS INTEGER) AS fold FROM scored_labels"))
def cross_validation_folds(spark, sf):
    return sm.fold_column(v.scored_labels(spark, sf), 6, key=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "fold")


@query(sql(f"SELECT l_orderkey, l_linenumber FROM scored_labels WHERE {md5_hash(7, 'l_orderkey', 'l_linenumber')}%10=0"))
def hashed_row_subset(spark, sf):
    return sm.fraction_subset(v.scored_labels(spark, sf), 10, seed=7, key=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query(sql(f"""SELECT a.event_id, b.score AS shuffled FROM (SELECT event_id, row_number() OVER (ORDER BY h, event_id)-1 AS i FROM k) a
    JOIN (SELECT score, row_number() OVER (ORDER BY h, event_id)-1 AS i, count(*) OVER () AS n FROM k) b ON b.i=(a.i+1+5%(b.n-1))%b.n""",
           k=f"SELECT event_id, score, {md5_hash(5, 'event_id')} AS h FROM peaks"))
def shuffled_column(spark, sf):
    out = sm.shuffle_column(v.peaks(spark, sf).select("event_id", "score"), "score", key=["event_id"], seed=5, name="shuffled")
    return out.select("event_id", "shuffled")
