"""Grid, overlap, support, label and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.operators import intervals as iv, labels as lb
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql

SAMPLES = [0, 1, 2, 3]


@query(sql("SELECT chrom, start, stop FROM grid"))
def tile_bins(spark, sf):
    return v.bins(spark, sf)


@query(sql("""SELECT g.chrom, g.start, g.stop, CAST(coalesce(n,0) AS BIGINT) AS n_overlap,
    CAST(coalesce(n,0)<>0 AS INTEGER) AS hit FROM grid g
    LEFT JOIN (SELECT chrom, bin_start, count(*) AS n FROM peak_hits GROUP BY ALL) h ON g.chrom=h.chrom AND g.start=h.bin_start"""))
def count_bin_overlaps(spark, sf):
    return iv.indicator(iv.count_bins(v.bins(spark, sf), v.peaks(spark, sf)))


@query(sql("""SELECT a.event_id, a.chrom, a.start, a.stop, CAST(count(b.event_id) AS BIGINT) AS n_overlap
    FROM (SELECT * FROM peaks WHERE sample_id=0) a LEFT JOIN (SELECT * FROM peaks WHERE sample_id<>0) b
    ON a.chrom=b.chrom AND b.start<a.stop AND a.start<b.stop GROUP BY ALL"""))
def count_interval_overlaps(spark, sf):
    p = v.peaks(spark, sf)
    left = p.where("sample_id = 0").select("event_id", "chrom", "start", "stop")
    return iv.count_overlaps(left, p.where("sample_id <> 0"))


@query(sql("""SELECT a.event_id, a.chrom, a.start, a.stop FROM peaks a WHERE a.sample_id<2 AND EXISTS
    (SELECT 1 FROM peaks b WHERE b.sample_id>=2 AND a.chrom=b.chrom AND b.start<a.stop AND a.start<b.stop)"""))
def overlap_semi_join(spark, sf):
    p = v.peaks(spark, sf)
    left = p.where("sample_id < 2").select("event_id", "chrom", "start", "stop")
    return iv.overlapping(left, p.where("sample_id >= 2"))


_FLAGS = ", ".join(f"CAST(coalesce(max(CASE WHEN h.sample_id={s} THEN 1 END),0) AS INTEGER) AS s_{s}" for s in SAMPLES)


@query(sql(f"""SELECT g.chrom, g.start, g.stop, {_FLAGS} FROM grid g LEFT JOIN summit_hits h
    ON g.chrom=h.chrom AND g.start=h.bin_start GROUP BY ALL"""))
def replicate_matrix(spark, sf):
    return iv.support_matrix(v.bins(spark, sf), v.summits(spark, sf), samples=SAMPLES)


@query(sql("""SELECT DISTINCT h.chrom, h.bin_start AS start, h.sample_id FROM peak_hits h JOIN grid g
    ON g.chrom=h.chrom AND g.start=h.bin_start"""))
def replicate_pairs(spark, sf):
    return iv.support_matrix(v.bins(spark, sf), v.peaks(spark, sf))


@query(sql("""SELECT g.chrom, g.start, g.stop, CAST(count(DISTINCT h.sample_id) AS BIGINT) AS support FROM grid g
    LEFT JOIN peak_hits h ON g.chrom=h.chrom AND g.start=h.bin_start GROUP BY ALL"""))
def replicate_support(spark, sf):
    return iv.coverage_support(v.bins(spark, sf), v.peaks(spark, sf))


def _labels(where_s, where_p, need="2"):
    return f"""SELECT g.chrom, g.start, g.stop, CAST(coalesce(s.n,0) AS BIGINT) AS summit_support,
    CAST(coalesce(p.n,0) AS BIGINT) AS peak_support,
    CASE WHEN coalesce(s.n,0)>={need} THEN 'B' WHEN coalesce(p.n,0)>={need} THEN 'A' ELSE 'U' END AS label FROM grid g
    LEFT JOIN (SELECT chrom, bin_start, count(DISTINCT sample_id) AS n FROM summit_hits WHERE {where_s} GROUP BY ALL) s
      ON g.chrom=s.chrom AND g.start=s.bin_start
    LEFT JOIN (SELECT chrom, bin_start, count(DISTINCT sample_id) AS n FROM peak_hits WHERE {where_p} GROUP BY ALL) p
      ON g.chrom=p.chrom AND g.start=p.bin_start"""


@query(sql(_labels("score>=5", "score>=5")))
def consensus_labels_quality(spark, sf):
    return lb.consensus_labels(v.bins(spark, sf), v.summits(spark, sf), v.peaks(spark, sf), q=5)


@query(sql(_labels("file_rank<=5000", "file_rank<=5000")))
def consensus_labels_top(spark, sf):
    return lb.consensus_labels(
        v.bins(spark, sf), v.summits(spark, sf, True), v.peaks(spark, sf, True), top_n=5000
    )


@query(sql(_labels("sample_id=2", "sample_id=2", "1")))
def consensus_labels_single(spark, sf):
    s, p = v.summits(spark, sf), v.peaks(spark, sf)
    return lb.consensus_labels(v.bins(spark, sf), s.where("sample_id = 2"), p.where("sample_id = 2"))


@query(sql("SELECT chrom, start, stop, CAST(label='B' AS INTEGER) AS y FROM lab WHERE chrom='click'", lab=_labels("TRUE", "TRUE")))
def binary_label_vector(spark, sf):
    lab = lb.consensus_labels(v.bins(spark, sf), v.summits(spark, sf), v.peaks(spark, sf))
    return lb.binary_labels(lab, "click")


_COUNTS = ", ".join(f"CASE WHEN count(h.event_id) FILTER (h.sample_id={s})=0 THEN 'U' ELSE 'B' END AS c_{s}" for s in SAMPLES)


@query(sql(f"""SELECT g.chrom, g.start, g.stop, {_COUNTS} FROM grid g LEFT JOIN peak_hits h
    ON g.chrom=h.chrom AND g.start=h.bin_start GROUP BY ALL"""))
def cluster_label_table(spark, sf):
    values = {f"c_{s}": (F.col("sample_id") == s).cast("bigint") for s in SAMPLES}
    counts = iv.count_bins(v.bins(spark, sf), v.peaks(spark, sf), values=values)
    return lb.cluster_labels(counts, [f"c_{s}" for s in SAMPLES])


_CCOUNTS = ", ".join(f"CAST(count(h.event_id) FILTER (h.sample_id={s}) AS BIGINT) AS c_{s}" for s in SAMPLES)


@query(sql(f"""SELECT g.chrom, g.start, g.stop, {_CCOUNTS} FROM grid g LEFT JOIN peak_hits h
    ON g.chrom=h.chrom AND g.start=h.bin_start GROUP BY ALL"""))
def cluster_count_chain(spark, sf):
    values = {f"c_{s}": (F.col("sample_id") == s).cast("bigint") for s in SAMPLES}
    return iv.count_bins(v.bins(spark, sf), v.peaks(spark, sf), values=values).drop("n_overlap")


MERGED = """SELECT chrom, min(start) AS start, max(stop) AS stop, CAST(count(*) AS BIGINT) AS n_members,
    sum(cents) AS cents FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, stop, event_id) AS cid FROM (
    SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start, stop, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM peaks)) GROUP BY chrom, cid"""


@query(sql("SELECT chrom, start, stop, n_members FROM merged", merged=MERGED))
def merge_peaks(spark, sf):
    return iv.merge_intervals(v.peaks(spark, sf))


@query(sql("SELECT chrom, start, stop, n_members, round(cents/100.0/n_members, 4) AS score FROM merged", merged=MERGED))
def merge_peaks_mean(spark, sf):
    out = iv.merge_intervals(v.peaks(spark, sf), mean="cents")
    return out.select("chrom", "start", "stop", "n_members", F.round(F.col("cents") / 100, 4).alias("score"))


@query(sql("SELECT chrom, start, stop FROM merged WHERE stop-start <= 300", merged=MERGED))
def merged_width_filter(spark, sf):
    return iv.at_most_wide(iv.merge_intervals(v.peaks(spark, sf)), 300).select("chrom", "start", "stop")


REP = """SELECT m.chrom, m.start, m.stop, CAST(4 AS BIGINT) AS n_rep, CAST(count(DISTINCT p.sample_id) AS BIGINT) AS n_support
    FROM merged m JOIN peaks p ON m.chrom=p.chrom AND p.start<m.stop AND m.start<p.stop GROUP BY ALL"""


@query(sql("SELECT * FROM rep WHERE n_support>=2 OR n_rep=1", merged=MERGED, rep=REP))
def reproducible_regions(spark, sf):
    p = v.peaks(spark, sf)
    regions = iv.merge_intervals(p)
    return iv.keep_reproducible(iv.reproducible(regions, p, samples=SAMPLES))


@query(sql("SELECT * FROM rep WHERE n_support/4.0 > 0.5", merged=MERGED, rep=REP))
def majority_regions(spark, sf):
    p = v.peaks(spark, sf)
    regions = iv.merge_intervals(p)
    return iv.keep_majority(iv.reproducible(regions, p, samples=SAMPLES))


@query(sql("SELECT event_id, chrom, start, stop, sample_id, file_rank FROM peaks WHERE file_rank<=10000"))
def first_rows_of_file(spark, sf):
    return iv.first_in_file(v.peaks(spark, sf, True), 10_000).select(
        "event_id", "chrom", "start", "stop", "sample_id", "file_rank"
    )


SETS = """SELECT q.query_id, q.set_id, s1.n_query, s2.n_set, q.n_overlap, q.n_hit,
    n_overlap * log2((n_overlap+1) / ((n_query*set_bp + n_set*query_bp)/genome + 1)) AS combo_score FROM
    (SELECT query_id, set_id, CAST(sum(n) AS BIGINT) AS n_overlap, CAST(count(*) FILTER (n>0) AS BIGINT) AS n_hit FROM
      (SELECT qs.query_id, d.set_id, d.event_id, count(a.event_id) AS n FROM db d CROSS JOIN (SELECT DISTINCT query_id FROM q) qs
       LEFT JOIN q a ON a.query_id=qs.query_id AND a.chrom=d.chrom AND a.start<d.stop AND d.start<a.stop GROUP BY ALL) GROUP BY ALL) q
    JOIN (SELECT query_id, CAST(count(*) AS BIGINT) AS n_query, CAST(sum(stop-start) AS BIGINT) AS query_bp FROM q GROUP BY ALL) s1 ON q.query_id=s1.query_id
    JOIN (SELECT set_id, CAST(count(*) AS BIGINT) AS n_set, CAST(sum(stop-start) AS BIGINT) AS set_bp FROM db GROUP BY ALL) s2 ON q.set_id=s2.set_id
    CROSS JOIN (SELECT sum(length) AS genome FROM chrom_sizes)"""
_Q = "SELECT sample_id AS query_id, event_id, chrom, start, stop FROM peaks WHERE file_rank<=10000"
_DB = "SELECT CAST(user_id%7 AS INTEGER) AS set_id, event_id, chrom, p AS start, p+1+cents//50 AS stop FROM ev"


def _ranked_sets(spark, sf):
    q = v.peaks(spark, sf, True).where("file_rank <= 10000").withColumnRenamed("sample_id", "query_id")
    db = v.ev(spark, sf).select(
        (F.col("user_id") % 7).cast("int").alias("set_id"),
        "chrom",
        F.col("p").alias("start"),
        (F.col("p") + 1 + F.floor(F.col("cents") / 50)).alias("stop"),
    )
    genome = v.chrom_sizes(spark, sf).agg(F.sum("length")).scalar()
    return iv.rank_interval_sets(q, db, query_ids=SAMPLES, genome=genome)


@query(sql("SELECT query_id, set_id, n_query, n_set, n_overlap, n_hit, round(combo_score,4)+0.0 AS combo_score FROM sets",
           sets=SETS, q=_Q, db=_DB))
def interval_set_similarity(spark, sf):
    return _ranked_sets(spark, sf).withColumn("combo_score", F.round("combo_score", 4) + 0.0)


@query(sql("""SELECT query_id, set_id, round(combo_score,4)+0.0 AS combo_score FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY combo_score DESC, set_id) AS r FROM sets) WHERE r=1""", sets=SETS, q=_Q, db=_DB))
def best_interval_set(spark, sf):
    return iv.best_interval_set(_ranked_sets(spark, sf)).withColumn("combo_score", F.round("combo_score", 4) + 0.0)


@query(sql("""SELECT r.chrom, r.start, r.stop, CASE WHEN EXISTS (SELECT 1 FROM trimmed t WHERE t.chrom=r.chrom
      AND t.start<r.stop AND r.start<t.stop) THEN 10 ELSE 0 END AS value
    FROM (SELECT chrom, start, stop FROM merged) r""",
           merged=MERGED, lab=_labels("TRUE", "TRUE"), trimmed="SELECT chrom, start, stop-150 AS stop FROM lab WHERE label='B'"))
def region_value_export(spark, sf):
    p = v.peaks(spark, sf)
    lab = lb.consensus_labels(v.bins(spark, sf), v.summits(spark, sf), p)
    regions = iv.merge_intervals(p).select("chrom", "start", "stop")
    return lb.region_values(lab, regions)
