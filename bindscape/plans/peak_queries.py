"""P-values, false-discovery control and peak calling."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions.scalars import neg_log10, sigmoid
from bindscape.operators import peaks as pk
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql


def _pois(by):
    """Poisson step in SQL, global or per chromosome."""
    sel = "chrom, " if by else ""
    on = "m.chrom=s.chrom" if by else "TRUE"
    part = "PARTITION BY chrom " if by else ""
    where = f"(SELECT {sel}margin AS mode FROM (SELECT {sel}margin, row_number() OVER ({part}ORDER BY count(*) DESC, margin) AS r FROM margins GROUP BY {sel}margin) WHERE r=1)"
    pre = {
        "modes": f"SELECT * FROM {where}",
        "excess": f"SELECT m.*, greatest(round(m.margin-s.mode, 2), 0) AS x FROM margins m JOIN modes s ON {on}",
        "mu": f"SELECT {sel}greatest(avg(x), 1.0) AS mu FROM excess{' GROUP BY chrom' if by else ''}",
        "tails": f"""SELECT k.*, CASE WHEN t < 1e-16 THEN 1e-16 ELSE t END AS p FROM (SELECT d.*, list_sum(list_transform(range(d.k+1,
            d.k+1+CAST(ceil(greatest(d.k, d.mu)) AS BIGINT)+200), lambda i: exp(-d.mu + i*ln(d.mu) - lgamma(i+1)))) AS t
            FROM (SELECT DISTINCT {'e.chrom, ' if by else ''}CAST(floor(x) AS BIGINT) AS k, mu FROM excess e JOIN mu ON {'e.chrom=mu.chrom' if by else 'TRUE'}) d) k""",
        "pois": f"""SELECT e.chrom, e.start, e.stop, -log10(t.p) AS nlp FROM excess e JOIN tails t
            ON CAST(floor(e.x) AS BIGINT)=t.k {'AND e.chrom=t.chrom' if by else ''}""",
    }
    return pre


GLOBAL = _pois(False)
BH = {
    "ps": "SELECT *, pow(10.0, -nlp) AS pv FROM pois",
    "bh": """SELECT nlp, round(least(min(raw) OVER (ORDER BY pv DESC ROWS UNBOUNDED PRECEDING), 1.0), 5) AS fdr FROM (
        SELECT nlp, pv, pv * sum(n) OVER () / sum(n) OVER (ORDER BY pv) AS raw FROM (SELECT nlp, pv, count(*) AS n FROM ps GROUP BY ALL))""",
    "sig": "SELECT p.chrom, p.start, p.stop, p.nlp, b.fdr, round(p.nlp, 5)/16 AS score FROM pois p JOIN bh b ON p.nlp=b.nlp WHERE b.fdr<=0.01",
}


@query(sql("SELECT mode FROM modes", **GLOBAL))
def background_mode(spark, sf):
    return pk.most_frequent(v.margins(spark, sf), "margin")


@query(sql("SELECT chrom, mode FROM modes", **_pois(True)))
def background_mode_by_chrom(spark, sf):
    return pk.most_frequent(v.margins(spark, sf), "margin", ["chrom"])


@query(sql("SELECT chrom, start, stop, round(nlp, 5)+0.0 AS neglog10p FROM pois", **GLOBAL))
def poisson_p_values(spark, sf):
    out = pk.poisson_neglog10p(v.margins(spark, sf))
    return out.select("chrom", "start", "stop", (F.round("neglog10p", 5) + 0.0).alias("neglog10p"))


@query(sql("SELECT chrom, start, stop, round(nlp, 5)+0.0 AS neglog10p FROM pois", **_pois(True)))
def poisson_p_values_by_chrom(spark, sf):
    out = pk.poisson_neglog10p(v.margins(spark, sf), by=["chrom"])
    return out.select("chrom", "start", "stop", (F.round("neglog10p", 5) + 0.0).alias("neglog10p"))


@query(sql("SELECT p.chrom, p.start, b.fdr FROM pois p JOIN bh b ON p.nlp=b.nlp", **GLOBAL, **BH))
def bh_adjusted_p(spark, sf):
    out = pk.poisson_neglog10p(v.margins(spark, sf)).withColumn("p", F.pow(F.lit(10.0), -F.col("neglog10p")))
    return pk.bh_adjust(out, "p").select("chrom", "start", "fdr")


@query(sql("SELECT chrom, start, stop, round(fdr,5) AS fdr, round(score,6) AS score FROM sig", **GLOBAL, **BH))
def significant_bins(spark, sf):
    out = pk.significant(pk.poisson_neglog10p(v.margins(spark, sf)))
    return out.select("chrom", "start", "stop", "fdr", F.round("score", 6).alias("score"))


@query(sql("SELECT chrom, start, stop, margin FROM margins ORDER BY margin DESC, chrom, start LIMIT 100000"))
def top_bins(spark, sf):
    return pk.top_n(v.margins(spark, sf), 100_000, score="margin")


FLAGSHIP = dict(
    **GLOBAL, **BH,
    top="SELECT * FROM sig ORDER BY score DESC, chrom, start LIMIT 100000",
    joined="""SELECT chrom, min(start) AS start, max(stop) AS stop, avg(score) AS score FROM (
        SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS cid FROM (
        SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM top)) GROUP BY chrom, cid""",
)


@query(sql("""SELECT chrom, start, stop, round(score, 6) AS score FROM (SELECT * FROM joined
    ORDER BY score DESC, chrom, start LIMIT 10000) ORDER BY chrom, start""", **FLAGSHIP))
def call_peaks(spark, sf):
    out = pk.call_peaks(v.margins(spark, sf))
    return out.select("chrom", "start", "stop", F.round("score", 6).alias("score"))


@query(sql("""SELECT chrom, start, stop, round(1/(1+exp(-margin)), 6) AS prob,
    round(-log10(greatest(1-1/(1+exp(-margin)), 1e-16)), 6)+0.0 AS nlp, least(greatest(margin, 0.5), 20.0) AS clipped,
    round(log2(margin+1), 6) AS log_ratio FROM margins"""))
def margin_transforms(spark, sf):
    m = F.col("margin")
    return v.margins(spark, sf).select(
        "chrom", "start", "stop",
        F.round(sigmoid(m), 6).alias("prob"),
        (F.round(neg_log10(1.0 - sigmoid(m)), 6) + 0.0).alias("nlp"),
        F.least(F.greatest(m, F.lit(0.5)), F.lit(20.0)).alias("clipped"),
        F.round(F.log2(m + 1), 6).alias("log_ratio"),
    )


@query()
def gamma_p_values(spark, sf):
    out = pk.gamma_neglog10p(v.margins(spark, sf))
    return out.select("chrom", "start", "stop", (F.round("neglog10p", 4) + 0.0).alias("neglog10p"))
