"""Rank aggregation over supplier-nation experts and brand items."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions.session import settle
from bindscape.operators import rankagg as ra
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql

SIZED = {
    "sized": "SELECT *, (SELECT count(DISTINCT item) FROM expert_ranks) AS n, (SELECT count(DISTINCT expert) FROM expert_ranks) AS ne FROM expert_ranks",
    "psized": "SELECT *, (SELECT count(DISTINCT item) FROM expert_partial) AS n, (SELECT count(DISTINCT expert) FROM expert_partial) AS ne FROM expert_partial",
    "supp": """SELECT e.expert, i.item, coalesce(p.rank, e.sup) AS rank FROM
      (SELECT expert, max(rank)+1 AS sup FROM expert_partial GROUP BY expert) e
      CROSS JOIN (SELECT DISTINCT item FROM expert_partial) i LEFT JOIN expert_partial p ON p.expert=e.expert AND p.item=i.item""",
    "agg_borda": "SELECT item, row_number() OVER (ORDER BY sum(n-rank) DESC, item) AS rank FROM sized GROUP BY item",
}


def _final(score: str, source: str, order: str = "DESC", cast: str = "") -> str:
    s = f"CAST({score} AS {cast})" if cast else score
    return sql(f"""SELECT item, score, row_number() OVER (ORDER BY score {order}, item) AS rank FROM
        (SELECT item, {s} AS score FROM {source} GROUP BY item)""", **SIZED)


def _full(spark, sf):
    return settle(v.expert_ranks(spark, sf))


def _partial(spark, sf):
    return settle(v.expert_partial(spark, sf))


@query(sql("SELECT expert, item, score, rank FROM expert_scores JOIN expert_ranks USING (expert, item)"))
def scores_to_ranks(spark, sf):
    return ra.to_ranks(v.expert_scores(spark, sf))


@query(sql("SELECT DISTINCT item FROM expert_partial"))
def rank_item_universe(spark, sf):
    return ra.item_universe(_partial(spark, sf))


@query(sql("SELECT item, rank, round(count(*)*1.0/max(ne), 6) AS share FROM sized GROUP BY item, rank", **SIZED))
def rank_marginals(spark, sf):
    return ra.first_order_marginals(_full(spark, sf)).withColumn("share", F.round("share", 6))


@query(sql("SELECT expert, item, rank FROM supp", **SIZED))
def rank_supplement(spark, sf):
    return ra.supplement(_partial(spark, sf))


@query(_final("round(avg(rank), 10)", "supp", ""))
def partial_borda_mean(spark, sf):
    return ra.aggregate_ranks(_partial(spark, sf), method="borda", scores=False, partial=True)


@query(_final("median(rank)", "supp", "", "DOUBLE"))
def partial_borda_median(spark, sf):
    return ra.partial_borda(_partial(spark, sf), stat="median")


@query(_final("round(exp(avg(ln(rank))), 10)", "supp", ""))
def partial_borda_geo(spark, sf):
    out = ra.partial_borda(_partial(spark, sf), stat="geo")
    return out


@query(sql("""SELECT item, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM (SELECT item,
    CAST(sum(m+1-rank) AS BIGINT) AS score FROM expert_partial JOIN (SELECT expert, count(*) AS m FROM expert_partial GROUP BY expert) USING (expert) GROUP BY item)"""))
def modified_borda(spark, sf):
    return ra.aggregate_ranks(_partial(spark, sf), method="modborda", scores=False, partial=True)


@query(sql("""SELECT item, round(score,6) AS score, rank FROM (SELECT item, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM
    (SELECT item, sum(n-rank)*1.0/max(ne) AS score FROM psized GROUP BY item))""", **SIZED))
def l1_aggregation(spark, sf):
    return ra.l1_ranks(_partial(spark, sf)).withColumn("score", F.round("score", 6))


@query(_final("sum(n-rank)", "sized", "DESC", "BIGINT"))
def borda(spark, sf):
    return ra.aggregate_ranks(v.expert_scores(spark, sf), method="borda")


@query(_final("list_sort(list(rank))[CAST(ceil(max(ne)/2.0) AS INTEGER)]", "sized", "", "BIGINT"))
def median_rank(spark, sf):
    return ra.median_rank(_full(spark, sf))


@query(_final("min(rank)", "sized", ""))
def highest_rank(spark, sf):
    return ra.highest_rank(_full(spark, sf))


@query(_final("max(rank)", "sized", ""))
def lowest_rank(spark, sf):
    return ra.lowest_rank(_full(spark, sf))


@query(_final("count(*) FILTER (rank <= n/2.0)", "sized", "DESC", "BIGINT"))
def stability_selection(spark, sf):
    return ra.stability(_full(spark, sf))


@query(_final("round(sum(exp(-rank/(n/2.0))), 10)", "sized"))
def exponential_weighting(spark, sf):
    return ra.exponential(_full(spark, sf))


@query(_final("sum(n-rank)*count(*) FILTER (rank <= n/2.0)", "sized", "DESC", "BIGINT"))
def stability_borda(spark, sf):
    return ra.stability_borda(_full(spark, sf))


@query(_final("round(sum(n-rank)*sum(exp(-rank/(n/2.0))), 8)", "sized"))
def exponential_borda(spark, sf):
    return ra.exponential_borda(_full(spark, sf))


@query(sql("""SELECT item, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM (SELECT item, round(1-min(beta), 10) AS score FROM (
    SELECT item, list_sum(list_transform(range(k, ne+1), lambda l: exp(lgamma(ne+1)-lgamma(l+1)-lgamma(ne-l+1)) * pow(x, l) * pow(1-x, ne-l))) AS beta FROM (
    SELECT item, rank*1.0/n AS x, ne, row_number() OVER (PARTITION BY item ORDER BY rank) AS k FROM sized)) GROUP BY item)""", **SIZED))
def robust_rank_aggregation(spark, sf):
    return ra.aggregate_ranks(v.expert_scores(spark, sf), method="robust")


@query(sql("""SELECT item, position, round(sum(abs(rank-position))*2.0/(max(n)*max(n)-max(n)%2), 6) AS cost
    FROM (SELECT s.*, unnest(range(1, n+1)) AS position FROM sized s) GROUP BY item, position""", **SIZED))
def footrule_cost_matrix(spark, sf):
    return ra.footrule_costs(_full(spark, sf)).withColumn("cost", F.round("cost", 6))


@query(sql("""SELECT e.expert, round(2.0*sum(abs(e.rank-b.rank))/(count(*)*count(*)), 6) AS footrule
    FROM expert_ranks e JOIN agg_borda b USING (item) GROUP BY e.expert""", **SIZED))
def spearman_footrule(spark, sf):
    full = _full(spark, sf)
    return ra.footrule_distance(full, ra.borda(full)).withColumn("footrule", F.round("footrule", 6))


@query(sql("""SELECT a.expert, round(2.0*count(*) FILTER (a.rank>c.rank)/(25*24), 6) AS kendall FROM
    (SELECT e.*, b.rank AS t FROM expert_ranks e JOIN agg_borda b USING (item)) a JOIN
    (SELECT e.*, b.rank AS t FROM expert_ranks e JOIN agg_borda b USING (item)) c
    ON a.expert=c.expert AND a.t<c.t GROUP BY a.expert""", **SIZED))
def kendall_tau(spark, sf):
    full = _full(spark, sf)
    return ra.kendall_distance(full, ra.borda(full)).withColumn("kendall", F.round("kendall", 6))


@query(sql("""WITH RECURSIVE turns(t, item, taken) AS (
    SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[])
    UNION ALL
    SELECT t+1, pick, list_append(taken, pick) FROM (SELECT t, taken, (SELECT arg_min(r.item, r.rank) FROM er r
        WHERE r.e = t % (SELECT count(DISTINCT e) FROM er) AND NOT list_contains(taken, r.item)) AS pick FROM turns
        WHERE t < (SELECT count(DISTINCT item) FROM er)))
    SELECT item, t AS rank FROM turns WHERE t>0""".replace("WITH RECURSIVE ", "@@"),
    er="SELECT item, rank, dense_rank() OVER (ORDER BY expert) - 1 AS e FROM expert_ranks").replace("WITH ", "WITH RECURSIVE ", 1).replace("\n@@", ",\n"))
def round_robin(spark, sf):
    return ra.round_robin(_full(spark, sf))


@query()
def kemeny_local_pass(spark, sf):
    full = _full(spark, sf)
    return ra.kemeny_pass(ra.borda(full), full)
