import numpy as np
from pyspark.sql import functions as F

from bindscape.functions import prefix as px


def _values(spark, n=400, groups=2, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(g), int(i), float(rng.integers(0, 60)) / 4) for g in range(groups) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g int, id int, v double")


def test_cumulative_counts(spark, both_paths):
    rows, df = _values(spark)
    out = px.cumulative_by_value(df.withColumn("n", F.lit(1)), ["g"], "v", {"seen": "n"}, descending=True)
    got = {(r.g, r.v): r.seen for r in out.collect()}
    for (g, v), seen in got.items():
        assert seen == sum(1 for r in rows if r[0] == g and r[2] >= v)


def test_quantiles_match_numpy(spark, both_paths):
    rows, df = _values(spark)
    fixed = px.exact_quantiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()
    grid = px.exact_quantiles(df, ["g"], "v", n_quantiles=37).collect()
    for g in (0, 1):
        x = np.array([r[2] for r in rows if r[0] == g])
        want = np.quantile(x, [0.0, 0.05, 0.5, 0.95, 1.0])
        got = [r.quantile for r in sorted(fixed, key=lambda r: r.q_idx) if r.g == g]
        assert np.allclose(got, want)
        got = [r.quantile for r in sorted(grid, key=lambda r: r.q_idx) if r.g == g]
        assert np.allclose(got, np.quantile(x, np.linspace(0, 1, 37)))


def test_more_quantiles_than_rows(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (2.0,)], "v double")
    out = px.exact_quantiles(df, (), "v", n_quantiles=1000).orderBy("q_idx").collect()
    assert [r.quantile for r in out] == [1.0, 2.0, 4.0] and out[0].n_q == 3
    one = px.exact_quantiles(df.limit(1), (), "v", n_quantiles=10).collect()
    assert len(one) == 1


def test_row_ranks(spark, both_paths):
    rows, df = _values(spark)
    out = px.value_index(df, ["g"], "v", ["id"], descending=True).collect()
    for g in (0, 1):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        got = sorted((r for r in out if r.g == g), key=lambda r: r["rank"])
        assert [r.id for r in got] == [r[1] for r in want]
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_hash_index_is_dense_and_stable(spark, both_paths):
    _, df = _values(spark, n=150, groups=1)
    a = {r.id: r.idx for r in px.hash_index(df, (), ["id"], 5).collect()}
    b = {r.id: r.idx for r in px.hash_index(df.repartition(7), (), ["id"], 5).collect()}
    assert a == b and sorted(a.values()) == list(range(150))


def test_join_values_keeps_every_row(spark, both_paths):
    rows, df = _values(spark)
    df = df.withColumn("v", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("v")))  # one hot value
    table = df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("twice", F.col("v") * 2)
    out = px.join_values(df, table, ["v"], ["twice"], weight="n", spread=["g", "id"])
    got = out.collect()
    assert len(got) == len(rows) and all(r.twice == 2 * r.v for r in got)


def test_null_groups_keep_their_results(spark, both_paths):
    df = spark.createDataFrame([(None, i, float(i % 5)) for i in range(300)] + [(1, i, float(i)) for i in range(50)], "g int, id int, v double")
    seen = px.cumulative_by_value(df.withColumn("n", F.lit(1)), ["g"], "v", {"seen": "n"}).where("g IS NULL").orderBy("v").collect()
    assert [r.seen for r in seen] == [60, 120, 180, 240, 300]
    ranks = px.value_index(df, ["g"], "v", ["id"]).where("g IS NULL").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 301))
    q = px.exact_quantiles(df, ["g"], "v", [0.5]).where("g IS NULL").collect()
    assert [r.quantile for r in q] == [2.0]


def test_tied_rows_are_split(spark, split_everything):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1800, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    out = px.value_index(df, (), "v", ["id"])
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 2001))
    wide = df.repartitionByRange(40, "v", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert wide < 400
