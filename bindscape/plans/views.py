"""The driver tables read as genomic inputs, in Spark and in DuckDB SQL.

``VIEWS`` holds the SQL text of each view; ``sql(body)`` prefixes a query with
the CTEs it uses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindscape.functions.prefix import value_index
from bindscape.operators.intervals import count_bins, tile

WIDTH, STEP = 200, 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- events as peaks, summits, alignments ---------------------------------

def ev(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("chrom"),
        F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'"), F.col("ts")).alias("p"),
        "value",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def chrom_sizes(spark, sf):
    return ev(spark, sf).groupBy("chrom").agg(
        ((F.floor(F.max("p") / 1000) + 1) * 1000).cast("bigint").alias("length")
    )


def bins(spark, sf):
    return tile(chrom_sizes(spark, sf), width=WIDTH, step=STEP)


def peaks(spark, sf, ranked=False):
    df = ev(spark, sf).select(
        "event_id",
        "chrom",
        F.col("p").alias("start"),
        (F.col("p") + 1 + F.floor(F.col("cents") / 50)).alias("stop"),
        (F.col("user_id") % 4).cast("int").alias("sample_id"),
        F.col("value").alias("score"),
        "cents",
    )
    if ranked:
        df = value_index(df, ["sample_id"], "score", ["start", "event_id"], name="file_rank", descending=True)
    return df


def summits(spark, sf, ranked=False):
    return peaks(spark, sf, ranked).withColumn("stop", F.col("start") + 1)


def alignments(spark, sf):
    return ev(spark, sf).select(
        "event_id",
        "chrom",
        F.col("p").alias("pos"),
        ((F.col("user_id") % 2) * 16 + F.when(F.col("k") % 10 == 0, 1024).otherwise(0)).cast("int").alias("flag"),
        F.col("k").alias("mapq"),
        (F.col("user_id") % 4).cast("int").alias("sample_id"),
    )


def margins(spark, sf):
    hit = count_bins(bins(spark, sf), peaks(spark, sf), values={"cents": F.col("cents")})
    return hit.select(
        "chrom", "start", "stop", (F.floor((F.col("cents") + 5) / 10) / 100.0).alias("margin")
    )


# ---- embeddings as a sample x bin x feature tensor ------------------------

def tensor(spark, sf):
    """sample = label; bin = position in the label's vec_id order; four chroms."""
    e = table(spark, sf, "embeddings").withColumn("label", F.coalesce("label", F.lit(-1)))
    e = e.withColumn("vec", F.col("vec_id").cast("bigint"))
    ranked = value_index(e, ["label"], "vec", [], name="rn")
    return ranked.select(
        F.col("label").cast("int").alias("sample_id"),
        F.concat(F.lit("chr"), (1 + (F.col("rn") - 1) % 2).cast("string")).alias("chrom"),
        (F.floor((F.col("rn") - 1) / 2) * STEP).cast("bigint").alias("start"),
        F.transform(
            "embedding", lambda v: F.greatest(F.round(v.cast("double") * 100), F.lit(0.0)).cast("bigint")
        ).alias("features"),
    )


def roles(spark, sf):
    return tensor(spark, sf).select("sample_id").distinct().select(
        "sample_id", F.when(F.col("sample_id") < 5, "train").otherwise("test").alias("role")
    )


# ---- lineitem as scores with B/A/U flags ----------------------------------

def scored_labels(spark, sf):
    li = table(spark, sf, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", "B").when(F.col("l_returnflag") == "A", "A").otherwise("U")
    return li.select(
        "l_orderkey",
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
        flag.alias("label"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_quantity") / 10 - 2.5).alias("margin"),
        (F.col("l_suppkey") % 3).cast("int").alias("model_id"),
    )


# ---- lineitem x part x supplier as expert rankings ------------------------

def expert_scores(spark, sf):
    li, s, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    return (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(p, li.l_partkey == p.p_partkey)
        .groupBy(F.col("s_nationkey").cast("int").alias("expert"), F.col("p_brand").alias("item"))
        .agg(F.sum("l_quantity").alias("score"))
    )


def expert_ranks(spark, sf):
    from bindscape.operators.rankagg import to_ranks

    return to_ranks(expert_scores(spark, sf)).select("expert", "item", "rank")


def expert_partial(spark, sf):
    return expert_ranks(spark, sf).where(F.col("rank") <= 5 + F.col("expert") % 7)


# ---- documents as sequences -----------------------------------------------

def sequences(spark, sf):
    # every character that is no base letter is an unknown base
    seq = F.upper(F.regexp_replace("text", "[^ACGTacgt]", "N"))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), seq.alias("seq")
    )


# ---- customers as sample metadata -----------------------------------------

def sample_meta(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("sample_id"),
        F.when(F.col("c_custkey") % 3 == 0, "NONE").otherwise(F.col("c_mktsegment")).alias("line"),
        F.col("n_name").alias("kind"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("tissue"),
        (F.col("c_acctbal") / 10000).alias("quality"),
        F.concat(F.lit("TF"), (F.col("c_custkey") % 7).cast("string")).alias("factor"),
        (F.col("c_custkey") % 10).cast("int").alias("cluster"),
        F.when(F.col("c_acctbal") > 0, "Y").otherwise("N").alias("included"),
    )


def label_pair(spark, sf):
    l = table(spark, sf, "labels")
    a = l.select("doc_id", F.when(F.col("quality") == 1, "B").otherwise("U").alias("label"))
    b = l.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "A").when(F.col("quality") == 1, "B").otherwise("U").alias("label"),
    )
    return a, b


VIEWS = {
    "ev": """SELECT event_id, user_id, event_type AS chrom,
        CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS p, value,
        CAST(round(value*100) AS BIGINT) AS cents,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "chrom_sizes": "SELECT chrom, (max(p)//1000 + 1)*1000 AS length FROM ev GROUP BY chrom",
    "bins": """SELECT chrom, unnest(range(0, length-200, 50)) AS start FROM chrom_sizes""",
    "grid": "SELECT chrom, start, start+200 AS stop FROM bins",
    "peaks": """SELECT event_id, chrom, p AS start, p+1+cents//50 AS stop, CAST(user_id%4 AS INTEGER) AS sample_id,
        value AS score, cents,
        row_number() OVER (PARTITION BY user_id%4 ORDER BY value DESC, p, event_id) AS file_rank FROM ev""",
    "summits": "SELECT event_id, chrom, start, start+1 AS stop, sample_id, score, cents, file_rank FROM peaks",
    "alignments": """SELECT event_id, chrom, p AS pos,
        CAST((user_id%2)*16 + CASE WHEN k%10=0 THEN 1024 ELSE 0 END AS INTEGER) AS flag,
        k AS mapq, CAST(user_id%4 AS INTEGER) AS sample_id FROM ev""",
    "peak_hits": """SELECT event_id, chrom, sample_id, score, cents, file_rank,
        unnest(range(greatest(0, CAST(floor((start-200)/50.0) AS BIGINT)+1), CAST(ceil(stop/50.0) AS BIGINT)))*50 AS bin_start FROM peaks""",
    "summit_hits": """SELECT event_id, chrom, sample_id, score, cents, file_rank,
        unnest(range(greatest(0, CAST(floor((start-200)/50.0) AS BIGINT)+1), CAST(ceil(stop/50.0) AS BIGINT)))*50 AS bin_start FROM summits""",
    "margins": """SELECT g.chrom, g.start, g.stop, floor((coalesce(h.c,0)+5)/10.0)/100.0 AS margin FROM grid g
        LEFT JOIN (SELECT chrom, bin_start, sum(cents) AS c FROM peak_hits GROUP BY ALL) h
        ON g.chrom=h.chrom AND g.start=h.bin_start""",
    "tensor": """SELECT sample_id, 'chr' || CAST(1+(rn-1)%2 AS VARCHAR) AS chrom, ((rn-1)//2)*50 AS start, features FROM (
        SELECT CAST(coalesce(label, -1) AS INTEGER) AS sample_id, row_number() OVER (PARTITION BY coalesce(label, -1) ORDER BY vec_id) AS rn,
        list_transform(embedding, lambda v: CAST(greatest(round(CAST(v AS DOUBLE)*100), 0) AS BIGINT)) AS features
        FROM embeddings)""",
    "tlong": """SELECT sample_id, chrom, start, unnest(range(0, 64)) AS feature_idx, unnest(features) AS value FROM tensor""",
    "roles": """SELECT DISTINCT sample_id, CASE WHEN sample_id < 5 THEN 'train' ELSE 'test' END AS role FROM tensor""",
    "scored_labels": """SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
        CASE l_returnflag WHEN 'R' THEN 'B' WHEN 'A' THEN 'A' ELSE 'U' END AS label,
        l_extendedprice AS score, l_quantity/10-2.5 AS margin, CAST(l_suppkey%3 AS INTEGER) AS model_id FROM lineitem""",
    "expert_scores": """SELECT CAST(s_nationkey AS INTEGER) AS expert, p_brand AS item, sum(l_quantity) AS score
        FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey GROUP BY ALL""",
    "expert_ranks": """SELECT expert, item, row_number() OVER (PARTITION BY expert ORDER BY score DESC, item) AS rank FROM expert_scores""",
    "expert_partial": "SELECT * FROM expert_ranks WHERE rank <= 5 + expert%7",
    "sequences": "SELECT 'd' || CAST(doc_id AS VARCHAR) AS chrom, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) AS seq FROM documents",
    "sample_meta": """SELECT c_custkey AS sample_id, CASE WHEN c_custkey%3=0 THEN 'NONE' ELSE c_mktsegment END AS line,
        n_name AS kind, 'R' || CAST(n_regionkey AS VARCHAR) AS tissue, c_acctbal/10000 AS quality,
        'TF' || CAST(c_custkey%7 AS VARCHAR) AS factor, CAST(c_custkey%10 AS INTEGER) AS cluster,
        CASE WHEN c_acctbal>0 THEN 'Y' ELSE 'N' END AS included
        FROM customer JOIN nation ON c_nationkey=n_nationkey""",
    "label_a": "SELECT doc_id, CASE WHEN quality=1 THEN 'B' ELSE 'U' END AS label FROM labels",
    "label_b": "SELECT doc_id, CASE WHEN toxic=1 THEN 'A' WHEN quality=1 THEN 'B' ELSE 'U' END AS label FROM labels",
}


def sql(body: str, **extra: str) -> str:
    """Prefix ``body`` with the view CTEs it (transitively) mentions."""
    known = {**VIEWS, **extra}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                before = len(needed)
                needed.append(name)
                visit(known[name])
                # keep dependencies ahead of the view that uses them
                deps = needed[before + 1 :]
                del needed[before:]
                needed.extend([*deps, name])

    # ``extra`` may hide a view of the same name; a view never depends on itself
    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({known[n]})" for n in needed)
    return f"WITH {ctes}\n{body}"


def md5_hash(seed: int, *cols: str) -> str:
    """DuckDB text of :func:`stable_hash`."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) AS BIGINT)"


