"""Quantile transforms, segments, correlation and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions.prefix import exact_quantiles
from bindscape.functions.session import settle
from bindscape.operators import normalize as nm, signal as sg, stats as st
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql

D = 64
NP = 16  # reference profiles: features 48..63


def _long(spark, sf):
    return sg.explode_features(v.tensor(spark, sf), ["sample_id", "chrom", "start"]).withColumn(
        "feature_idx", F.col("feature_idx").cast("bigint")
    )


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


def _qsql(by, source, nq):
    b = ", ".join(by)
    eq = " AND ".join(f"o.{c}=t.{c}" for c in by)
    return {
        "ordered": f"SELECT {b}, value, row_number() OVER (PARTITION BY {b} ORDER BY value)-1 AS i, count(*) OVER (PARTITION BY {b}) AS n FROM {source}",
        "targets": f"SELECT {b}, least({nq}, n) AS n_q, n, unnest(range(0, least({nq}, n))) AS q_idx FROM (SELECT DISTINCT {b}, n FROM ordered)",
        "fitted": f"""SELECT {', '.join('t.' + c for c in by)}, t.q_idx, t.n_q, max(o.value) FILTER (o.i=floor(h)) + (max(o.value) FILTER (o.i=ceil(h)) - max(o.value) FILTER (o.i=floor(h)))*(max(h)-floor(max(h))) AS quantile
          FROM (SELECT *, CASE WHEN n=1 THEN 0 ELSE q_idx*(n-1)*1.0/(n_q-1) END AS h FROM targets) t JOIN ordered o ON {eq} AND o.i IN (floor(h), ceil(h)) GROUP BY ALL""".replace("max(h)-floor(max(h))", "any_value(h)-floor(any_value(h))"),
        "mapped": f"""SELECT s.*, CASE WHEN s.value<=f.lowv THEN 0.0 WHEN s.value>=f.highv THEN 1.0
            WHEN f.eq_lo IS NOT NULL THEN (f.eq_lo+f.eq_hi)/2.0/(f.n_q-1)
            ELSE (f.li + (s.value-f.lv)/(f.rv-f.lv))/(f.n_q-1) END AS q FROM {source} s JOIN
            (SELECT {', '.join('d.' + c for c in by)}, d.value, any_value(q.n_q) AS n_q, min(q.quantile) AS lowv, max(q.quantile) AS highv,
             min(q.q_idx) FILTER (q.quantile=d.value) AS eq_lo, max(q.q_idx) FILTER (q.quantile=d.value) AS eq_hi,
             max(q.q_idx) FILTER (q.quantile<=d.value) AS li, max(q.quantile) FILTER (q.quantile<=d.value) AS lv,
             min(q.quantile) FILTER (q.quantile>d.value) AS rv
             FROM (SELECT DISTINCT {b}, value FROM {source}) d JOIN fitted q ON {' AND '.join(f'd.{c}=q.{c}' for c in by)} GROUP BY ALL) f
            ON {' AND '.join(f's.{c}=f.{c}' for c in by)} AND s.value=f.value""",
    }


@query(sql("SELECT feature_idx, q_idx, round(quantile, 6) AS quantile FROM fitted", **_qsql(["feature_idx"], "tlong", 100)))
def fit_quantile_table(spark, sf):
    out = nm.fit_quantiles(_long(spark, sf), n_quantiles=100)
    return out.select("feature_idx", "q_idx", F.round("quantile", 6).alias("quantile"))


@query(sql("SELECT sample_id, chrom, start, feature_idx, round(q, 6) AS value FROM mapped", **_qsql(["feature_idx"], "tlong", 100)))
def quantile_transform(spark, sf):
    out = nm.fit_apply(_long(spark, sf), by=["feature_idx"], n_quantiles=100)
    return _r6(out, "value")


@query(sql("SELECT sample_id, chrom, start, feature_idx, round(q, 6) AS value FROM mapped", **_qsql(["feature_idx"], "tlong", 100)))
def quantile_transform_ordered(spark, sf):
    """Same transform from a fitted table."""
    long = _long(spark, sf)
    fitted = settle(nm.fit_quantiles(long, n_quantiles=100))
    out = nm.apply_quantiles(long, fitted, spread=["sample_id", "chrom", "start"])
    return _r6(out, "value")


@query(sql("""SELECT sample_id, chrom, start, feature_idx, round(q, 6) AS value FROM mapped
    UNION ALL SELECT sample_id, chrom, start, feature_idx, 0.0 FROM tlong WHERE value=0""",
           nz="SELECT * FROM tlong WHERE value<>0", **_qsql(["feature_idx"], "nz", 100)))
def quantile_transform_nonzero(spark, sf):
    out = nm.fit_apply(_long(spark, sf), by=["feature_idx"], n_quantiles=100, skip_zero=True)
    return _r6(out, "value")


_RL = "SELECT role, chrom, start, feature_idx, avg(value) AS value FROM tlong JOIN roles USING (sample_id) GROUP BY ALL"


@query(sql("SELECT role, chrom, start, feature_idx, round(q, 5) AS value FROM mapped",
           rl=_RL, **_qsql(["role", "feature_idx"], "rl", 1000)))
def quantile_transform_by_role(spark, sf):
    mean = sg.mean_signal(v.tensor(spark, sf), v.roles(spark, sf), D)
    long = sg.explode_features(mean, ["role", "chrom", "start"]).withColumn("feature_idx", F.col("feature_idx").cast("bigint"))
    out = nm.fit_apply(settle(long), by=["role", "feature_idx"])
    return out.withColumn("value", F.round("value", 5) + 0.0)


_RANKED = """SELECT sample_id, chrom, start, features[1] AS value, row_number() OVER (PARTITION BY sample_id ORDER BY features[1], chrom, start) AS r FROM tensor"""


@query(sql("SELECT a.sample_id, a.chrom, a.start, a.value, b.ref_value AS qt FROM a JOIN b ON a.sample_id=b.sample_id AND a.r=b.r",
           a=_RANKED, b=_RANKED.replace("features[1]", "features[49]").replace("AS value", "AS ref_value")))
def rank_map_to_reference(spark, sf):
    t = v.tensor(spark, sf)
    s = t.select("sample_id", "chrom", "start", F.get("features", F.lit(0)).alias("value"))
    r = t.select("sample_id", "chrom", "start", F.get("features", F.lit(48)).alias("ref_value"))
    return nm.qt_to_reference(s, r, by=["sample_id"])


SEG = {
    "ids": "SELECT chrom, start, CASE WHEN (start//350)%5=4 THEN '.' ELSE 'cp' || CAST(start//350 AS VARCHAR) || ',x' END AS cp_id FROM (SELECT DISTINCT chrom, start FROM grid)",
    "toks": "SELECT *, trim(split_part(CASE WHEN cp_id='.' THEN '0' ELSE cp_id END, ',', 1)) AS tok FROM ids",
    "segs": """SELECT chrom, start, CAST(sum(new) OVER (PARTITION BY chrom ORDER BY start) AS BIGINT) AS segment FROM (SELECT *,
      CAST(tok <> coalesce(lag(tok) OVER (PARTITION BY chrom ORDER BY start), '0') AS INTEGER) AS new FROM toks)""",
}


@query(sql("SELECT chrom, start, cp_id, segment FROM segs JOIN ids USING (chrom, start)", **SEG))
def segment_runs(spark, sf):
    ids = v.bins(spark, sf).select(
        "chrom", "start",
        F.when(F.floor(F.col("start") / 350) % 5 == 4, ".").otherwise(
            F.concat(F.lit("cp"), F.floor(F.col("start") / 350).cast("string"), F.lit(",x"))).alias("cp_id"),
    )
    return nm.run_segments(ids)


@query(sql("""SELECT CAST(a.feature_idx AS INTEGER) AS a, CAST(b.feature_idx AS INTEGER) AS b, round(corr(a.value, b.value), 3)+0.0 AS r FROM tlong a
    JOIN tlong b ON a.sample_id=b.sample_id AND a.chrom=b.chrom AND a.start=b.start GROUP BY ALL"""))
def column_correlation_matrix(spark, sf):
    return nm.column_correlations(v.tensor(spark, sf), D)


PANEL = {
    "rs": "SELECT sample_id, k, round(corr(features[1], features[49+k]), 3) AS r FROM tensor CROSS JOIN (SELECT unnest(range(0, 16)) AS k) GROUP BY ALL",
}


def _panel(spark, sf):
    return v.tensor(spark, sf).select(
        "sample_id", "chrom", "start", F.get("features", F.lit(0)).alias("x"),
        F.slice("features", 49, NP).alias("panel"),
        F.concat(F.col("sample_id").cast("string"), F.lit("_"), F.floor(F.col("start") / 350).cast("string")).alias("segment"),
    )


@query(sql("SELECT sample_id, CAST(k AS INTEGER) AS ref_id, r FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY r DESC, k) AS n FROM rs) WHERE n=1", **PANEL))
def best_reference_profile(spark, sf):
    return nm.best_reference(_panel(spark, sf), ["sample_id"], "x", "panel", NP)


SEGR = {
    "tseg": "SELECT *, CAST(sample_id AS VARCHAR) || '_' || CAST(start//350 AS VARCHAR) AS segment FROM tensor",
    "sr": """SELECT segment, k, CASE WHEN isnan(r) OR r IS NULL THEN NULL ELSE round(r,3) END AS r FROM (SELECT segment, k, CASE WHEN var_pop(features[1])=0 OR var_pop(features[49+k])=0 THEN NULL ELSE corr(features[1], features[49+k]) END AS r
      FROM tseg CROSS JOIN (SELECT unnest(range(0, 16)) AS k) GROUP BY ALL)""",
}


@query(sql("SELECT segment, CAST(k AS INTEGER) AS ref_id, coalesce(r, -2.0) AS r FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY coalesce(r,-2) DESC, k) AS n FROM sr) WHERE n=1", **SEGR))
def nearest_reference_per_segment(spark, sf):
    return nm.nearest_reference_per_segment(_panel(spark, sf), x="x", panel="panel", n_panel=NP)


BLEND = {
    **SEGR,
    "pos": "SELECT segment, k, greatest(coalesce(r,0),0) AS r FROM sr",
    "cut": "SELECT segment, quantile_cont(r, 0.75) AS c FROM pos GROUP BY segment",
    "strong": "SELECT segment, count(*) AS n FROM pos JOIN cut USING (segment) WHERE r>c AND r>0.6 GROUP BY segment",
    "used": "SELECT p.segment, p.k, p.r FROM pos p JOIN cut USING (segment) LEFT JOIN strong s ON s.segment=p.segment WHERE p.r>c AND (s.n IS NULL OR p.r>0.6)",
    "own": "SELECT segment, avg(1-r) AS o, count(*) AS n FROM used GROUP BY segment",
    "mix": "SELECT t.sample_id, t.chrom, t.start, sum(t.features[49+u.k]*u.r)/any_value(o.n) AS m FROM tseg t JOIN used u USING (segment) JOIN own o USING (segment) GROUP BY ALL",
}


@query(sql("""SELECT t.sample_id, t.chrom, t.start, round(round(CASE WHEN t.features[1]=0 THEN 0 ELSE t.features[1]*coalesce(o.o,1)+coalesce(m.m,0)+1e-9 END, 2), 1) AS blend
    FROM tseg t LEFT JOIN own o USING (segment) LEFT JOIN mix m ON m.sample_id=t.sample_id AND m.chrom=t.chrom AND m.start=t.start""", **BLEND))
def segment_knn_blend(spark, sf):
    df = _panel(spark, sf).withColumn("x", F.col("x").cast("double")).withColumn("raw", F.col("x"))
    out = nm.knn_blend(df, raw="raw", normed="x", panel="panel", n_panel=NP, q=0.75)
    return out.select("sample_id", "chrom", "start", F.round("blend", 1).alias("blend"))


@query()
def sqtknn_profile(spark, sf):
    t = v.tensor(spark, sf)
    panel = F.transform(F.slice("features", 49, NP), lambda x: x.cast("double"))
    df = t.select(
        "sample_id", "chrom", "start", F.transform("features", lambda x: x.cast("double")).alias("features"),
        F.concat("chrom", F.lit("_"), F.floor(F.col("start") / 350).cast("string")).alias("segment"),
        panel.alias("full"), F.slice(panel, 1, 8).alias("reduced"),
    )
    both = {"forward": ("full", "reduced"), "reverse": ("full", "reduced")}
    out = nm.sqtknn(df, both, NP, n_reduced=8, keys=["sample_id", "chrom"])
    return sg.explode_features(out, ["sample_id", "chrom", "start"])


CHIM = {
    "lv": "SELECT sample_id, chrom, start, chrom || '_' || CAST(start//350 AS VARCHAR) AS segment, features, (features[13]+features[14]+features[37]+features[38])/4.0 AS lv, CASE WHEN features[1]>10 THEN 'B' ELSE 'U' END AS label FROM tensor",
    "cr": """SELECT a.segment, a.sample_id, coalesce(round(CASE WHEN var_pop(a.lv)=0 OR var_pop(b.lv)=0 THEN NULL ELSE corr(a.lv, b.lv) END, 3), -2.0) AS r FROM lv a JOIN lv b
       ON b.sample_id=9 AND a.sample_id<9 AND a.chrom=b.chrom AND a.start=b.start AND a.segment=b.segment GROUP BY ALL""",
    "pick": "SELECT segment, sample_id, r FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY r DESC, sample_id) AS n FROM cr) WHERE n=1",
}


@query(sql("SELECT l.chrom, l.start, l.segment, l.sample_id, p.r, l.label, CAST(list_sum(l.features) AS DOUBLE) AS total FROM lv l JOIN pick p ON l.segment=p.segment AND l.sample_id=p.sample_id", **CHIM))
def best_sample_per_segment(spark, sf):
    t = settle(v.tensor(spark, sf))
    labels = t.select("sample_id", "chrom", "start", F.when(F.get("features", F.lit(0)) > 10, "B").otherwise("U").alias("label"))
    segments = t.select("chrom", "start", F.concat("chrom", F.lit("_"), F.floor(F.col("start") / 350).cast("string")).alias("segment")).distinct()
    out = nm.chimera(t, labels, segments, 9, list(range(9)))
    return out.select("chrom", "start", "segment", "sample_id", "r", "label",
                      F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(sql("SELECT sample_id, chrom, start, feature_idx, round(CASE WHEN s=0 THEN 0 ELSE (value-m)/s END, 5)+0.0 AS value FROM tlong JOIN (SELECT feature_idx, avg(value) AS m, stddev_pop(value) AS s FROM tlong GROUP BY ALL) USING (feature_idx)"))
def standardized_features(spark, sf):
    t = v.tensor(spark, sf).withColumn("features", F.transform("features", lambda x: x.cast("double")))
    out = sg.explode_features(nm.standardize(t, D), ["sample_id", "chrom", "start"])
    return out.withColumn("feature_idx", F.col("feature_idx").cast("bigint")).withColumn("value", F.round("value", 5) + 0.0)


@query(sql(" UNION ALL ".join(f"SELECT feature_idx, CAST({i} AS BIGINT) AS q_idx, round(quantile_cont(value, {p}), 6) AS quantile FROM tlong GROUP BY feature_idx"
                               for i, p in enumerate((0.05, 0.5, 0.95)))))
def column_quantiles(spark, sf):
    out = exact_quantiles(_long(spark, sf), ["feature_idx"], "value", [0.05, 0.5, 0.95])
    return out.select("feature_idx", "q_idx", F.round("quantile", 6).alias("quantile"))


@query(sql("SELECT round(avg(score), 4) AS mean, round(var_pop(score), 2) AS var FROM scored_labels WHERE score > (SELECT median(score) FROM scored_labels)"))
def upper_half_moments(spark, sf):
    df = v.scored_labels(spark, sf)
    cut = exact_quantiles(df, (), "score", [0.5]).first()["quantile"]
    return st.upper_half_moments(df, "score", cut).select(F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"))


def _tail_sql(z):
    from bindscape.functions.scalars import normal_upper_tail  # noqa: F401  (same coefficients, as text)

    coef = ["-1.26551223", "1.00002368", "0.37409196", "0.09678418", "(-0.18628806)", "0.27886807",
            "(-1.13520398)", "1.48851587", "(-0.82215223)", "0.17087277"]
    t = f"(1.0/(1.0+0.5*(abs({z})/sqrt(2.0))))"
    poly = coef[-1]
    for c in reversed(coef[:-1]):
        poly = f"({c}+{t}*{poly})"
    half = f"0.5*{t}*exp(-({z})*({z})/2.0+{poly})"
    return f"CASE WHEN ({z})>=0 THEN {half} ELSE 1.0-{half} END"


FLAGS = {
    "zs": "SELECT t.*, round((value-m)/s, 9) AS z FROM tlong t JOIN (SELECT feature_idx, avg(value) AS m, stddev_pop(value) AS s FROM tlong GROUP BY ALL) USING (feature_idx)",
    "pz": f"SELECT *, {_tail_sql('z')} AS p FROM zs",
    "adj": """SELECT feature_idx, p, min(raw) OVER (PARTITION BY feature_idx ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS a FROM (
      SELECT feature_idx, p, p*sum(n) OVER (PARTITION BY feature_idx)/sum(n) OVER (PARTITION BY feature_idx ORDER BY p) AS raw FROM
      (SELECT feature_idx, p, count(*) AS n FROM pz GROUP BY ALL))""",
    "flags": "SELECT pz.sample_id, pz.chrom, pz.start, pz.feature_idx, CAST(a<=0.1 AS INTEGER) AS significant FROM pz JOIN adj USING (feature_idx, p)",
}


@query(sql("SELECT * FROM flags", **FLAGS))
def fdr_flag_per_column(spark, sf):
    out = st.fdr_flags(_long(spark, sf), spread=["sample_id", "chrom", "start"])
    return out.select("sample_id", "chrom", "start", "feature_idx", "significant")


@query(sql("SELECT sample_id, chrom, start, sum(significant)>=count(*)*0.05 AS common_peak, sum(significant)=0 AS common_background FROM flags GROUP BY ALL", **FLAGS))
def common_peak_background(spark, sf):
    out = st.fdr_flags(_long(spark, sf), spread=["sample_id", "chrom", "start"])
    return st.common_rows(out, ["sample_id", "chrom", "start"], q=0.05)


@query(sql(f"""SELECT model_id, n1, n0, round(-log10(greatest({_tail_sql('zz')}, 1e-300)), 4)+0.0 AS neglog10p FROM (
    SELECT model_id, CAST(n1 AS BIGINT) AS n1, CAST(tot-n1 AS BIGINT) AS n0, (ranks-n1*(n1+1)/2.0-n1*(tot-n1)/2.0-0.5)/sqrt(n1*(tot-n1)/12.0*((tot+1)-ties/(tot*(tot-1.0)))) AS zz FROM (
    SELECT model_id, sum(n1*(upto-n+(n+1)/2.0)) AS ranks, sum(n1)*1.0 AS n1, sum(n)*1.0 AS tot, sum(n*1.0*n*n-n) AS ties FROM (
    SELECT model_id, n, n1, sum(n) OVER (PARTITION BY model_id ORDER BY score) AS upto FROM (
    SELECT model_id, score, count(*) AS n, count(*) FILTER (label='B') AS n1 FROM scored_labels GROUP BY ALL)) GROUP BY model_id))"""))
def rank_sum_by_motif(spark, sf):
    df = v.scored_labels(spark, sf).withColumn("bound", (F.col("label") == "B").cast("int"))
    out = st.rank_sum_test(df, value="score", group="bound", by=["model_id"])
    return out.withColumn("neglog10p", F.round("neglog10p", 4) + 0.0)


@query(sql("""SELECT round(sqrt(sum((ra-rb)*(ra-rb))), 4) AS fro_norm FROM (SELECT a.feature_idx, b.feature_idx,
    (corr(a.value,b.value) FILTER (a.sample_id<5))*(count(*) FILTER (a.sample_id<5))/((count(*) FILTER (a.sample_id<5))-1) AS ra,
    (corr(a.value,b.value) FILTER (a.sample_id>=5))*(count(*) FILTER (a.sample_id>=5))/((count(*) FILTER (a.sample_id>=5))-1) AS rb
    FROM tlong a JOIN tlong b ON a.sample_id=b.sample_id AND a.chrom=b.chrom AND a.start=b.start GROUP BY ALL)"""))
def domain_shift_distance(spark, sf):
    t = v.tensor(spark, sf).withColumn("side", F.when(F.col("sample_id") < 5, "source").otherwise("target"))
    return st.domain_shift(t, D).select(F.round("fro_norm", 4).alias("fro_norm"))


@query()
def spline_ma_normalization(spark, sf):
    df = v.tensor(spark, sf).select(
        "sample_id", "chrom", "start",
        F.get("features", F.lit(0)).cast("double").alias("ref_signal"),
        F.get("features", F.lit(1)).cast("double").alias("signal"),
        ((F.get("features", F.lit(0)) > 0) & (F.get("features", F.lit(1)) > 0)).alias("common"),
    )
    out = nm.spline_normalize(df, ref="ref_signal", target="signal", common="common")
    return out.select("sample_id", "chrom", "start", F.round("normed", 4).alias("normed"))
