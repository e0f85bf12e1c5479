"""Cut pile-ups, profiles, replicate summaries and neighbour features."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.operators import signal as sg
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql

CUTS = {
    "kept": "SELECT *, CASE WHEN flag & 16 = 0 THEN 'forward' ELSE 'reverse' END AS strand FROM alignments WHERE flag & 1804 = 0 AND mapq >= 30",
    "cuts": "SELECT DISTINCT chrom, pos, strand FROM kept",
}
D = 64


def _cuts(spark, sf):
    return sg.pile_up(sg.with_strand(sg.keep_alignments(v.alignments(spark, sf))))


@query(sql("SELECT event_id, chrom, pos, strand FROM kept", **CUTS))
def filtered_alignments(spark, sf):
    return sg.with_strand(sg.keep_alignments(v.alignments(spark, sf))).select("event_id", "chrom", "pos", "strand")


@query(sql("SELECT chrom, pos, strand, CAST(1 AS BIGINT) AS value FROM cuts", **CUTS))
def cut_pile_up(spark, sf):
    return _cuts(spark, sf)


def _profile_sql(edges):
    marks = sg.EDGES[edges]
    cols = []
    for strand in ("forward", "reverse"):
        for a, b in zip(marks[:-1], marks[1:]):
            cols.append(f"count(*) FILTER (strand='{strand}' AND o>={a} AND o<{b})/{float(b - a)}")
    return sql(f"""SELECT chrom, start, round(list_sum(list_transform(f, lambda x, i: x*i)), 6) AS checksum,
        round(list_sum(f), 6) AS total, f[13] AS f12, f[{len(marks)}] AS flast FROM (
        SELECT b.chrom, b.start, [{', '.join(cols)}] AS f FROM bins b LEFT JOIN
        (SELECT chrom, strand, (pb-q+10)*50 AS start, pos-((pb-q+10)*50-600) AS o
         FROM (SELECT *, unnest(range(-26, 38)) AS q FROM (SELECT *, (pos//50) AS pb FROM cuts))) c
        ON b.chrom=c.chrom AND b.start=c.start AND o>=0 AND o<1400 GROUP BY b.chrom, b.start)""", **CUTS)


def _profile(spark, sf, edges):
    out = sg.cut_profile(_cuts(spark, sf), v.chrom_sizes(spark, sf), edges=edges)
    n = len(sg.EDGES[edges])
    checksum = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "chrom", "start",
        F.round(checksum, 6).alias("checksum"),
        F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.get("features", F.lit(12)).alias("f12"),
        F.get("features", F.lit(n - 1)).alias("flast"),
    )


@query(_profile_sql("variable"))
def cut_profile_variable(spark, sf):
    return _profile(spark, sf, "variable")


@query(_profile_sql("50"))
def cut_profile_50bp(spark, sf):
    return _profile(spark, sf, "50")


@query(_profile_sql("100"))
def cut_profile_100bp(spark, sf):
    return _profile(spark, sf, "100")


@query(sql("SELECT role, chrom, start, feature_idx, round(avg(value), 6) AS value FROM tlong JOIN roles USING (sample_id) GROUP BY ALL"))
def replicate_mean(spark, sf):
    out = sg.mean_signal(v.tensor(spark, sf), v.roles(spark, sf), D)
    return sg.explode_features(out, ["role", "chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint")).withColumn("value", F.round("value", 6))


@query(sql("""SELECT role, chrom, start, feature_idx, round(avg(value), 6) AS value FROM tlong JOIN (SELECT sample_id,
    CASE WHEN n<=4 THEN 'train' ELSE 'test' END AS role FROM (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS n FROM roles)
    WHERE n<=10) USING (sample_id) GROUP BY ALL"""))
def fixed_slice_mean(spark, sf):
    t = v.tensor(spark, sf)
    out = sg.mean_signal(t, sg.slice_roles(t, 4, 6), D)
    return sg.explode_features(out, ["role", "chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint")).withColumn("value", F.round("value", 6))


@query(sql("SELECT CAST(sample_id%3 AS INTEGER) AS cluster, chrom, start, feature_idx, CAST(sum(value) AS BIGINT) AS value FROM tlong GROUP BY ALL"))
def cluster_sum(spark, sf):
    t = v.tensor(spark, sf)
    cmap = t.select("sample_id").distinct().withColumn("cluster", (F.col("sample_id") % 3).cast("int"))
    return sg.explode_features(sg.sum_signal(t, cmap, D), ["cluster", "chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


@query(sql("SELECT chrom, start, feature_idx, median(value) AS value FROM tlong GROUP BY ALL"))
def sample_median(spark, sf):
    out = sg.median_signal(v.tensor(spark, sf), D)
    return sg.explode_features(out, ["chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


@query(sql("SELECT sample_id, chrom, start, round(list_sum(list_transform(features, lambda x: x*1.0/m)), 6) AS total FROM tensor CROSS JOIN (SELECT max(value) AS m FROM tlong WHERE chrom='chr1')"))
def chrom_max_scale(spark, sf):
    out = sg.scale_by_chrom_max(v.tensor(spark, sf), "chr1")
    return out.select("sample_id", "chrom", "start", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(sql("SELECT t.sample_id, t.chrom, t.start, t.feature_idx, round(CASE WHEN m=0 THEN 0 ELSE t.value*1.0/m END, 6) AS value FROM tlong t JOIN (SELECT feature_idx, max(value) AS m FROM tlong GROUP BY ALL) USING (feature_idx)"))
def column_max_scale(spark, sf):
    out = sg.scale_by_column_max(v.tensor(spark, sf), D)
    return sg.explode_features(out, ["sample_id", "chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint")).withColumn("value", F.round("value", 6))


@query(sql("SELECT a.sample_id, a.chrom, a.start, a.feature_idx, CAST(a.value+b.value AS BIGINT) AS value FROM tlong a JOIN tlong b ON a.sample_id=b.sample_id AND a.chrom=b.chrom AND a.start=b.start AND b.feature_idx=a.feature_idx+32"))
def strand_fold(spark, sf):
    out = sg.fold_strands(v.tensor(spark, sf))
    return sg.explode_features(out, ["sample_id", "chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


@query(sql("SELECT sample_id, chrom, start, CAST(sum(value) AS DOUBLE) AS central FROM tlong WHERE feature_idx BETWEEN 8 AND 15 OR feature_idx BETWEEN 32 AND 39 GROUP BY ALL"))
def central_window_sum(spark, sf):
    return sg.central_sum(v.tensor(spark, sf)).select("sample_id", "chrom", "start", "central")


@query(sql("SELECT sample_id, chrom, start, feature_idx-40 AS feature_idx, value FROM tlong WHERE feature_idx>=40 AND feature_idx<60"))
def feature_block_slice(spark, sf):
    out = sg.feature_block(v.tensor(spark, sf), 2, size=20)
    return sg.explode_features(out, ["sample_id", "chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))


@query(sql("""SELECT t.sample_id, t.chrom, t.start, list_concat(t.features, u.features) AS f FROM tensor t JOIN tensor u ON u.sample_id=0 AND t.chrom=u.chrom AND t.start=u.start""")
       .replace("SELECT t.sample_id, t.chrom, t.start, list_concat(t.features, u.features) AS f", "SELECT t.sample_id, t.chrom, t.start, len(list_concat(t.features, u.features)) AS n, CAST(list_sum(list_concat(t.features, u.features)) AS BIGINT) AS total, list_concat(t.features, u.features)[65] AS first_right"))
def feature_hstack(spark, sf):
    t = v.tensor(spark, sf)
    out = sg.join_features(t, t.where("sample_id = 0"))
    return out.select(
        "sample_id", "chrom", "start", F.size("features").cast("bigint").alias("n"),
        F.aggregate("features", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.get("features", F.lit(64)).alias("first_right"),
    )


# fixed values: distances in bins
OFFSETS = (-7, -5, -3, -1, 0, 1, 3, 5, 7)
CODE_OFFSETS = (-12, -8, -4, 0, 4, 8, 12)


def _offset_sql(offsets, n):
    lst = ", ".join(map(str, offsets))
    return sql(f"""SELECT t.sample_id, t.chrom, t.start, o.pos-1 AS slot, f AS feature_idx, u.features[f+1] AS value FROM tensor t
      JOIN (SELECT sample_id, chrom, max(start) AS last FROM tensor GROUP BY ALL) m USING (sample_id, chrom)
      CROSS JOIN (SELECT unnest([{lst}]) AS off, unnest(range(1, {len(offsets) + 1})) AS pos) o
      JOIN tensor u ON u.sample_id=t.sample_id AND u.chrom=t.chrom AND u.start=least(greatest(t.start+50*o.off, 0), m.last)
      CROSS JOIN (SELECT unnest(range(0, {n})) AS f)""")


def _offsets(spark, sf, offsets, n):
    t = v.tensor(spark, sf).withColumn("features", F.slice("features", 1, n))
    out = sg.offset_features(t, offsets, keys=["sample_id", "chrom"], block=16)
    long = sg.explode_features(out, ["sample_id", "chrom", "start"])
    return long.select(
        "sample_id", "chrom", "start", F.floor(F.col("feature_idx") / n).cast("bigint").alias("slot"),
        (F.col("feature_idx") % n).cast("bigint").alias("feature_idx"), "value",
    )


@query(_offset_sql(OFFSETS, D))
def neighbour_offsets(spark, sf):
    return _offsets(spark, sf, OFFSETS, D)


@query(_offset_sql(CODE_OFFSETS, D))
def code_offsets(spark, sf):
    return _offsets(spark, sf, CODE_OFFSETS, D)


@query(sql("""SELECT t.sample_id, t.chrom, t.start, t.features[1] AS here, coalesce(u.features[1], 0)*1.0 AS before, coalesce(w.features[2], 0)*1.0 AS after
    FROM tensor t LEFT JOIN tensor u ON u.sample_id=t.sample_id AND u.chrom=t.chrom AND u.start=t.start-150
    LEFT JOIN tensor w ON w.sample_id=t.sample_id AND w.chrom=t.chrom AND w.start=t.start+100"""))
def row_shift(spark, sf):
    t = v.tensor(spark, sf).select("sample_id", "chrom", "start", F.get("features", F.lit(0)).alias("here"),
                                   F.get("features", F.lit(0)).cast("double").alias("a"), F.get("features", F.lit(1)).cast("double").alias("b"))
    out = sg.shifted(t, {"before": ("a", -3), "after": ("b", 2)}, keys=["sample_id", "chrom"], block=16)
    return out.select("sample_id", "chrom", "start", "here", "before", "after")


# short and long fragment features side by side, with suffixed names
@query(sql("""SELECT sample_id, chrom, start, 'f' || CAST(feature_idx%32 AS VARCHAR) || CASE WHEN feature_idx<32 THEN '_short' ELSE '_long' END AS feature_name, value FROM tlong"""))
def short_long_features(spark, sf):
    t = v.tensor(spark, sf)
    short = t.withColumn("features", F.slice("features", 1, 32))
    long = t.withColumn("features", F.slice("features", 33, 32))
    keys = ["sample_id", "chrom", "start"]
    both = sg.explode_features(sg.join_features(short, long, keys=keys), keys)
    name = F.concat(F.lit("f"), (F.col("feature_idx") % 32).cast("string"))
    named = both.withColumn("feature_name", F.when(F.col("feature_idx") < 32, F.concat(name, F.lit("_short"))).otherwise(F.concat(name, F.lit("_long"))))
    return named.select(*keys, "feature_name", "value")


# extra 0/1 covariate: is the bin hit by a summit
@query(sql("""SELECT t.sample_id, t.chrom, t.start, CAST(t.features[64]>10 AS DOUBLE) AS flag, len(t.features)+1 AS n FROM tensor t"""))
def binary_covariate(spark, sf):
    t = v.tensor(spark, sf)
    keys = ["sample_id", "chrom", "start"]
    extra = t.select(*keys, (F.get("features", F.lit(63)) - 10).alias("signal"))
    base = t.withColumn("features", F.transform("features", lambda x: x.cast("double")))
    out = sg.append_binary(base, extra, "signal", keys=keys)
    return out.select(*keys, F.get("features", F.lit(64)).alias("flag"), F.size("features").cast("bigint").alias("n"))
