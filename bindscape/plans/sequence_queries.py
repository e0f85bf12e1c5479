"""Motif scanning queries over document-derived sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.functions.session import scratch_path
from bindscape.operators import sequence as sq
from bindscape.plans import views as v
from bindscape.plans.registry import query
from bindscape.plans.views import sql
from bindscape.sources.readers import read_fasta_lines
from bindscape.sources.writers import write_fasta

# fixed values: weights of four example matrices (a, c, g, t per position), in quarters
MOTIFS = {
    "m4": [(5, -3, -2, 0), (-4, 6, -1, -1), (-2, -2, 7, -3), (0, -1, -5, 6)],
    "m6": [(2, 1, -3, 0), (-1, 4, -2, 1), (3, -2, 2, -3), (0, 0, 5, -5), (-3, 1, 1, 2), (4, -4, 3, -1)],
    "m7": [(1, 2, 3, -6), (-2, 5, -1, -2), (6, -3, 0, -1), (-4, -2, 4, 3), (2, 2, -3, 0), (0, -1, 6, -5), (-1, 3, -2, 1)],
    "m9": [(3, -1, 0, -2), (-2, 2, 1, 0), (1, -3, 4, -2), (-1, 5, -4, 1), (0, 0, -2, 3), (4, -2, -1, 0), (-3, 1, 2, 1), (2, -2, 3, -3), (-1, 0, -2, 4)],
}
LMAX = 9


def pwms(spark, sf):
    """The example matrices."""
    rows = [(m, i, *[x / 4 for x in w]) for m, mat in MOTIFS.items() for i, w in enumerate(mat)]
    return spark.createDataFrame(rows, "motif string, pos int, a double, c double, g double, t double")


_VALUES = ", ".join(
    f"('{m}', {i + (LMAX - len(mat)) // 2}, '{b}', {w[k] / 4})"
    for m, mat in MOTIFS.items() for i, w in enumerate(mat) for k, b in enumerate("ACGT")
)
SCAN = {
    "pwm": f"SELECT * FROM (VALUES {_VALUES}) t(motif, j, base, w)",
    "base": f"SELECT chrom, seq, length(seq) AS len FROM sequences WHERE length(seq) >= {LMAX}",
    "letters": "SELECT chrom, len, unnest(range(0, len)) AS i, unnest(string_split(replace(seq, 'N', 'A'), '')) AS b FROM base",
    # bases before the start read as code 0: A forward, T on the other strand
    "padded": "SELECT * FROM letters UNION ALL SELECT chrom, len, -x, '?' FROM base CROSS JOIN (SELECT unnest([1,2,3,4]) AS x)",
    "fwd": f"""SELECT p.chrom, w.motif, p.i-w.j+{LMAX // 2} AS pos, sum(w.w) AS score FROM padded p JOIN pwm w
        ON w.base=CASE p.b WHEN '?' THEN 'A' ELSE p.b END WHERE p.i-w.j+{LMAX // 2} BETWEEN 0 AND p.len-{LMAX} GROUP BY ALL""",
    "rev": f"""SELECT p.chrom, w.motif, p.i-({LMAX - 1}-w.j)+{LMAX // 2} AS pos, sum(w.w) AS score FROM padded p JOIN pwm w
        ON w.base=CASE p.b WHEN '?' THEN 'A' WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' ELSE 'A' END
        WHERE p.i-({LMAX - 1}-w.j)+{LMAX // 2} BETWEEN 0 AND p.len-{LMAX} GROUP BY ALL""",
    "win": """SELECT chrom, motif, pos, score, unnest(range(greatest(0, (pos-200)//50+1), pos//50+1))*50 AS start FROM {src}""",
    "tb": f"""SELECT chrom, length(seq) AS len, unnest(range(0, length(seq)-199, 50)) AS start FROM sequences WHERE length(seq)>=200""",
    "fw": "SELECT chrom, motif, start, list_sort(list(score), 'DESC')[1:3] AS s FROM (SELECT chrom, motif, score, unnest(range(greatest(0, CAST(floor((pos-200)/50.0) AS BIGINT)+1), pos//50+1))*50 AS start FROM fwd) GROUP BY ALL",
    "rw": "SELECT chrom, motif, start, list_sort(list(score), 'DESC')[1:3] AS s FROM (SELECT chrom, motif, score, unnest(range(greatest(0, CAST(floor((pos-200)/50.0) AS BIGINT)+1), pos//50+1))*50 AS start FROM rev) GROUP BY ALL",
    "tops": f"""SELECT m.motif, t.chrom, t.start, CASE WHEN t.start+200 <= t.len-{LMAX}+1 THEN list_sort(list_concat(f.s, r.s), 'DESC')[1:4] ELSE [0.0, 0.0, 0.0, 0.0] END AS top
        FROM tb t CROSS JOIN (SELECT DISTINCT motif FROM pwm) m
        LEFT JOIN fw f ON f.chrom=t.chrom AND f.start=t.start AND f.motif=m.motif LEFT JOIN rw r ON r.chrom=t.chrom AND r.start=t.start AND r.motif=m.motif""",
}
SCAN.pop("win")


@query(sql("SELECT chrom, translate(seq, 'ACGTN', '01230') AS code, translate(seq, 'ACGTN', '32103') AS complement FROM sequences"))
def sequence_codes(spark, sf):
    code = sq.encode(F.col("seq"))
    return v.sequences(spark, sf).select("chrom", code.alias("code"), sq.complement_code(code).alias("complement"))


@query(sql("""SELECT chrom, CAST(chunk_start AS INTEGER) AS chunk_start, substr(seq, CAST(greatest(chunk_start-10, 0)+1 AS BIGINT), CAST(least(chunk_start, 10)+520 AS BIGINT)) AS piece
    FROM (SELECT chrom, seq, unnest(range(0, greatest(length(seq), 1), 500)) AS chunk_start FROM sequences)"""))
def sequence_chunks(spark, sf):
    path = scratch_path(spark, "fasta")
    write_fasta(v.sequences(spark, sf), path)
    out = sq.chunk_sequences(read_fasta_lines(spark, path), size=500, before=10, after=20)
    return out.select("chrom", "chunk_start", F.col("seq").alias("piece"))


@query(sql("SELECT chrom, motif, count(*) AS n, CAST(sum(score) AS DOUBLE) AS total, CAST(max(score) AS DOUBLE) AS best, CAST(sum(score*(pos%97)) AS DOUBLE) AS checksum FROM fwd GROUP BY ALL", **SCAN))
def pwm_scan_forward(spark, sf):
    return _scan_summary(spark, sf, "+")


@query(sql("SELECT chrom, motif, count(*) AS n, CAST(sum(score) AS DOUBLE) AS total, CAST(max(score) AS DOUBLE) AS best, CAST(sum(score*(pos%97)) AS DOUBLE) AS checksum FROM rev GROUP BY ALL", **SCAN))
def pwm_scan_reverse(spark, sf):
    return _scan_summary(spark, sf, "-")


def _scan_summary(spark, sf, strand):
    out = sq.pwm_scan(v.sequences(spark, sf), pwms(spark, sf), strand=strand)
    return out.groupBy("chrom", "motif").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"),
        F.sum(F.col("score") * (F.col("pos") % 97)).alias("checksum"),
    )


@query(sql("SELECT motif, chrom, start, " + ", ".join(f"CAST(top[{i}] AS DOUBLE) AS t{i}" for i in range(1, 5)) + " FROM tops", **SCAN))
def motif_top_scores(spark, sf):
    out = sq.motif_top_scores(v.sequences(spark, sf), pwms(spark, sf))
    return out.select("motif", "chrom", "start", *[F.get("top", F.lit(i)).cast("double").alias(f"t{i + 1}") for i in range(4)])


_OFF = "-7, -5, -3, -1, 0, 1, 3, 5, 7"


@query(sql(f"""SELECT t.chrom, t.start, CAST(o.slot*2+m.mi AS BIGINT) AS cell, {', '.join(f'CAST(u.top[{i}] AS DOUBLE) AS t{i}' for i in range(1, 5))}
    FROM tb t JOIN (SELECT chrom, max(start) AS last FROM tb GROUP BY chrom) l USING (chrom)
    CROSS JOIN (SELECT unnest([{_OFF}]) AS off, unnest(range(0, 9)) AS slot) o CROSS JOIN (SELECT unnest(['m6','m9']) AS motif, unnest([0,1]) AS mi) m
    JOIN tops u ON u.chrom=t.chrom AND u.motif=m.motif AND u.start=least(greatest(t.start+50*o.off, 0), l.last)""", **SCAN))
def motif_feature_matrix(spark, sf):
    motifs = spark.createDataFrame([("m6",), ("m9",)], "motif string")
    top = sq.motif_top_scores(v.sequences(spark, sf), pwms(spark, sf), motifs=motifs)
    out = sq.motif_features(top, motifs, block=16)
    cells = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda c: F.struct(c.cast("bigint").alias("cell"), F.slice("features", c * 4 + 1, 4).alias("v")))
    return out.select("chrom", "start", F.explode(cells).alias("c")).select(
        "chrom", "start", "c.cell", *[F.get("c.v", F.lit(i)).cast("double").alias(f"t{i + 1}") for i in range(4)]
    )


# scan report rows: part brands as motifs, one scan per supplier nation
REPORT = {
    "report": """SELECT CAST(s_nationkey%5 AS INTEGER) AS scan, row_number() OVER (PARTITION BY s_nationkey%5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
      l_linenumber=1 AS is_top, CASE WHEN p_size%4=0 THEN 'denovo' || CAST(p_size AS VARCHAR) ELSE p_brand END AS name
      FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey""",
    "named": "SELECT *, sum(CAST(is_top AS INTEGER)) OVER (PARTITION BY scan ORDER BY row_no) AS cno FROM report",
    "reps": "SELECT scan, cno AS cluster_no, arg_min(name, row_no) AS name FROM named WHERE cno>0 AND NOT starts_with(name, 'denovo') GROUP BY ALL",
    "zs": "SELECT CAST(s_nationkey%5 AS INTEGER) AS scan, p_brand AS name, -1.0*sum(CAST(l_quantity AS BIGINT)) AS z FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN part ON l_partkey=p_partkey GROUP BY ALL",
}


def _report(spark, sf):
    from bindscape.functions.prefix import value_index

    li, s, p = (v.table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey).select(
        (F.col("s_nationkey") % 5).cast("int").alias("scan"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_linenumber") == 1).alias("is_top"),
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("denovo"), F.col("p_size").cast("string"))).otherwise(F.col("p_brand")).alias("name"),
    )
    return value_index(rows, ["scan"], "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], name="row_no")


@query(sql("SELECT scan, CAST(cluster_no AS BIGINT) AS cluster_no, name FROM reps", **REPORT))
def cluster_representatives(spark, sf):
    return sq.cluster_representatives(_report(spark, sf))


@query(sql("SELECT scan, row_no, name FROM report WHERE NOT starts_with(name, 'denovo')", **REPORT))
def denovo_dropped(spark, sf):
    return sq.drop_denovo(_report(spark, sf)).select("scan", "row_no", "name")


@query(sql("""SELECT item, score, rank FROM (SELECT item, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM (SELECT item, round(1-min(beta), 10) AS score FROM (
    SELECT item, list_sum(list_transform(range(k, 6), lambda l: exp(lgamma(6)-lgamma(l+1)-lgamma(5-l+1)) * pow(x, l) * pow(1-x, 5-l))) AS beta FROM (
    SELECT item, rank*1.0/n AS x, row_number() OVER (PARTITION BY item ORDER BY rank) AS k FROM (
    SELECT u.item, e.scan, row_number() OVER (PARTITION BY e.scan ORDER BY coalesce(-z.z, 0) DESC, u.item) AS rank, (SELECT count(DISTINCT name) FROM reps) AS n
    FROM (SELECT DISTINCT name AS item FROM reps) u CROSS JOIN (SELECT DISTINCT scan FROM report) e LEFT JOIN zs z ON z.scan=e.scan AND z.name=u.item))) GROUP BY item)) WHERE rank<=5""", **REPORT))
def choose_cofactors(spark, sf):
    li, s, p = (v.table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    z = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey).groupBy(
        (F.col("s_nationkey") % 5).cast("int").alias("scan"), F.col("p_brand").alias("name")
    ).agg((-F.sum(F.col("l_quantity").cast("bigint")).cast("double")).alias("zscore"))
    return sq.choose_cofactors(_report(spark, sf), z, n=5)
