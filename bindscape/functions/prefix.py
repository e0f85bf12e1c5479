"""Running aggregates that never need a large ordering in one task.

A Spark window ordered over a large partition runs in a single task.  The
helpers here first collapse to distinct keys, write that table to the shared
folder (so what produced it runs once), and look at the size of its largest
group.  Small groups take one ordinary window.  Larger ones are split into
buckets: the window runs inside each bucket and the carry of all earlier
buckets, one row per bucket, is added.  A bucket is a pure function of the row
(genome coordinate, high bits of a hash, or quantile splitters of a
hash-selected subset), so every branch of a plan and every retry of a task
sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from bindscape.functions.hashing import HASH_BITS, stable_hash
from bindscape.functions.session import broadcast_if_small, settle

BUCKET = "__bucket"
POSITION_BUCKET = 1 << 16
ONE_TASK_ROWS = 1_000_000  # a group up to this size is sorted by one task
BROADCAST_ROWS = 100_000
SPLIT_PIECES = 128  # value buckets of a large group
SPLIT_ONE_IN = 1024  # one key in this many steers the splitters
SPLIT_MIN_PICKED = 1024
SPLIT_LEAST = 8  # range partitions of a large table, at least


def _ordered(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a null key matching a null key; keys come from ``left``."""
    if not keys:
        return left.join(right, how=how)
    renamed = right.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"__on_{k}" for k in keys])


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest ``by`` group."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def bucketed_prefix(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    bucket: Column | None,
    *,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums / maxima along ``order`` within ``by``.

    ``bucket`` is monotone in ``order``; ``None`` runs one window per group.
    ``sums``/``maxes`` map new column name to the column they accumulate.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    by = list(by)
    if bucket is not None:
        df = df.withColumn(BUCKET, bucket)
    keys = by + ([BUCKET] if bucket is not None else [])
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*_ordered(order, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df
    for out, src in sums.items():
        local = local.withColumn(out, F.sum(src).over(inside))
    for out, src in maxes.items():
        local = local.withColumn(out, F.max(src).over(inside))
    if bucket is None:
        return local
    totals = df.groupBy(*keys).agg(
        *[F.sum(src).alias(f"__t_{out}") for out, src in sums.items()],
        *[F.max(src).alias(f"__t_{out}") for out, src in maxes.items()],
    )
    before = Window.partitionBy(*by).orderBy(*_ordered([BUCKET], descending)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__c_{o}") for o in sums],
        *[F.max(f"__t_{o}").over(before).alias(f"__c_{o}") for o in maxes],
    )
    joined = join_null_safe(local, carry, keys, "left")
    for out in sums:
        joined = joined.withColumn(out, F.col(out) + F.col(f"__c_{out}"))
    for out in maxes:
        # greatest() skips nulls, which is the "nothing seen yet" case
        joined = joined.withColumn(out, F.greatest(F.col(out), F.col(f"__c_{out}")))
    return joined.drop(BUCKET, *[f"__c_{o}" for o in [*sums, *maxes]])


def position_bucket(df: DataFrame, by: Sequence[str], position: str) -> Column | None:
    """Coordinate bucket of a settled table, or ``None`` if its groups are small.

    A bucket holds at most ``POSITION_BUCKET`` distinct positions.
    """
    if largest_group(df, by) <= ONE_TASK_ROWS:
        return None
    return F.floor(F.col(position) / F.lit(POSITION_BUCKET)).cast("bigint")


def with_value_bucket(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add a bucket monotone in ``value``, balanced for large groups.

    Splitters are exact percentiles over the rows whose key hash falls in one
    of ``SPLIT_ONE_IN`` classes.  They only steer how the work is divided: any
    splitters give the same results.  Groups with fewer than
    ``SPLIT_MIN_PICKED`` picked rows (about a million rows) stay in one bucket.
    """
    by = list(by)
    picked = df.where(F.pmod(F.xxhash64(*by, value), F.lit(SPLIT_ONE_IN)) == 0)
    marks = [i / SPLIT_PIECES for i in range(1, SPLIT_PIECES)]
    agg = F.when(F.count(F.lit(1)) >= SPLIT_MIN_PICKED, F.percentile(value, F.array(*map(F.lit, marks))))
    bucket = F.coalesce(
        F.size(F.filter("__splits", lambda s: s < F.col(value))), F.lit(0)
    ).cast("bigint")
    if by:
        splits = picked.groupBy(*by).agg(agg.alias("__splits"))
        out = join_null_safe(df, broadcast_if_small(splits), by, "left")
    else:
        out = df.withColumn("__splits", picked.agg(agg.alias("__splits")).scalar())
    return out.withColumn(
        BUCKET, F.when(F.col("__splits").isNull(), F.lit(0).cast("bigint")).otherwise(bucket)
    ).drop("__splits")


def cumulative_by_value(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Mapping[str, str],
    *,
    descending: bool = False,
) -> DataFrame:
    """Running sums over *distinct* values: collapse, settle, prefix.

    ``sums`` maps output name to an existing numeric column.  The result has
    one row per ``(by, value)`` with the column's total there (``<src>``) and
    its inclusive running total (``<out>``).
    """
    by = list(by)
    flat = settle(
        df.groupBy(*by, value).agg(*[F.sum(src).alias(src) for src in dict.fromkeys(sums.values())])
    )
    return running_by_value(flat, by, value, sums=sums, descending=descending)


def running_by_value(
    flat: DataFrame,
    by: Sequence[str],
    value: str,
    *,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Prefix over a settled table that already has one row per ``(by, value)``."""
    bucket = None
    if largest_group(flat, by) > ONE_TASK_ROWS:
        flat = with_value_bucket(flat, by, value)
        bucket = F.col(BUCKET)
    return bucketed_prefix(flat, by, [value], bucket, sums=sums, maxes=maxes, descending=descending)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: Sequence[float] | None = None,
    *,
    n_quantiles: int | None = None,
    name: str = "quantile",
) -> DataFrame:
    """Linear-interpolated quantiles without collecting a group's values.

    Either fixed ``probabilities`` or an evenly spaced grid of
    ``min(n_quantiles, n)`` points.  One row per ``(by, q_idx)`` with columns
    ``q_idx, n_q, <name>``.  Each distinct value knows the index range it
    occupies in sorted order, so it emits exactly the quantile ranks inside.
    """
    by = list(by)
    flat = settle(
        df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    )
    cum = running_by_value(flat, by, value, sums={"__hi": "__n"})
    cum = cum.withColumn("__lo", F.col("__hi") - F.col("__n"))
    if by:
        cum = join_null_safe(cum, broadcast_if_small(flat.groupBy(*by).agg(F.sum("__n").alias("__total"))), by)
    else:
        cum = cum.withColumn("__total", flat.agg(F.sum("__n")).scalar())
    if probabilities is not None:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        n_q = F.lit(len(probabilities))
        ranks = F.transform(
            probs, lambda p, i: F.struct(i.alias("q_idx"), (p * (F.col("__total") - 1)).alias("h"))
        )
        wanted = F.explode(
            F.filter(
                ranks,
                lambda r: (F.floor(r.h) >= F.col("__lo")) & (F.floor(r.h) < F.col("__hi"))
                | (F.ceil(r.h) >= F.col("__lo")) & (F.ceil(r.h) < F.col("__hi")),
            )
        )
        hits = cum.select(*by, value, "__lo", "__hi", n_q.alias("n_q"), wanted.alias("r")).select(
            *by, value, "__lo", "__hi", "n_q", F.col("r.q_idx").alias("q_idx"), F.col("r.h").alias("h")
        )
    else:
        # q_idx * (total-1) / (n_q-1) lies in [lo-1, hi): only those indices are emitted
        cum = cum.withColumn("n_q", F.least(F.lit(n_quantiles).cast("bigint"), F.col("__total")))
        per = (F.col("n_q") - 1) / (F.col("__total") - 1)
        first = F.greatest(F.lit(0), F.ceil((F.col("__lo") - 1) * per) - 1)
        last = F.least(F.col("n_q") - 1, F.floor(F.col("__hi") * per) + 1)
        idx = F.when(F.col("__total") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
            F.sequence(first.cast("bigint"), F.greatest(first, last).cast("bigint"))
        )
        hits = cum.select(*by, value, "__lo", "__hi", "n_q", "__total", F.explode(idx).alias("q_idx"))
        hits = hits.withColumn(
            "h",
            F.when(F.col("__total") == 1, F.lit(0.0)).otherwise(
                F.col("q_idx") * (F.col("__total") - 1) / (F.col("n_q") - 1)
            ),
        )
    lower = (F.floor("h") >= F.col("__lo")) & (F.floor("h") < F.col("__hi"))
    upper = (F.ceil("h") >= F.col("__lo")) & (F.ceil("h") < F.col("__hi"))
    frac = F.col("h") - F.floor("h")
    return (
        hits.where(lower | upper)
        .groupBy(*by, "q_idx")
        .agg(
            F.max("n_q").cast("bigint").alias("n_q"),
            F.max(F.when(lower, F.col(value))).alias("__v0"),
            F.max(F.when(upper, F.col(value))).alias("__v1"),
            F.max(frac).alias("__f"),
        )
        .select(
            *by,
            F.col("q_idx").cast("bigint").alias("q_idx"),
            "n_q",
            (F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__f")).alias(name),
        )
    )


def hash_index(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    seed: int,
    *,
    name: str = "idx",
    bucket_bits: int = 10,
) -> DataFrame:
    """Dense 0-based index of rows in hash order, unique if ``key`` is unique.

    The hash is uniform, so its high bits are balanced buckets by themselves.
    """
    bucket = None
    if largest_group(df, by) > ONE_TASK_ROWS:
        bucket = F.shiftright("__h", HASH_BITS - bucket_bits)
        df = settle(df)
    hashed = df.withColumn("__h", stable_hash(seed, *by, *key)).withColumn("__one", F.lit(1).cast("bigint"))
    out = bucketed_prefix(hashed, by, ["__h", *key], bucket, sums={name: "__one"})
    return out.withColumn(name, F.col(name) - 1).drop("__h", "__one")


def value_index(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: Sequence[str],
    *,
    name: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """1-based rank of rows by ``value`` (ties by ``tie``), skew-safe."""
    order = [*_ordered([value], descending), *_ordered(tie, False)]
    if largest_group(df, by) <= ONE_TASK_ROWS:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    # range partitions on the whole order split groups and ties alike
    base = settle(df)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-base.count() // max(ONE_TASK_ROWS, 50)), SPLIT_LEAST)
    keys = [F.col(c).asc() for c in by]
    ranged = base.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = settle(ranged.withColumn("__place", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__place", 33))
    runs = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__t"), F.min("__place").alias("__low"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = runs.select(*by, "__part", "__low", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__c"))
    return (
        join_null_safe(placed, broadcast_if_small(carry), [*by, "__part"])
        .withColumn(name, (F.col("__place") - F.col("__low") + F.col("__c") + 1).cast("bigint"))
        .drop("__place", "__part", "__low", "__c")
    )


def join_values(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    *,
    weight: str,
    spread: Sequence[str],
    share: float = 1e-3,
) -> DataFrame:
    """Left join a per-value table back to its rows when some values are hot.

    ``weight`` is the row count of each table entry.  A table counted small is
    broadcast whole.  Otherwise entries holding at least
    ``share`` of all rows number at most ``1/share``, so they are broadcast;
    rows they serve are spread by the hash of ``spread`` instead of meeting in
    one shuffle partition.  All other entries go through an ordinary join.
    """
    keys = list(keys)
    table = settle(table.select(*keys, weight, *columns))
    if table.count() <= BROADCAST_ROWS:
        return join_null_safe(rows, F.broadcast(table.drop(weight)), keys, "left")
    total = table.agg(F.sum(weight)).first()[0]
    marked = table.withColumn("__hot", F.col(weight) >= F.lit(total * share))
    hot = marked.where("__hot").select(
        *keys, *[F.col(c).alias(f"__h_{c}") for c in columns], F.lit(True).alias("__is_hot")
    )
    cold = marked.where("NOT __hot").select(*keys, *columns, F.lit(0).cast("bigint").alias("__salt"))
    probe = join_null_safe(rows, F.broadcast(hot), keys, "left").withColumn("__is_hot", F.coalesce("__is_hot", F.lit(False)))
    probe = probe.withColumn(
        "__salt",
        F.when(F.col("__is_hot"), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("bigint")),
    )
    cold = cold.withColumnsRenamed({c: f"__c_{c}" for c in columns})
    out = join_null_safe(probe, cold, [*keys, "__salt"], "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__is_hot"), F.col(f"__h_{c}")).otherwise(F.col(f"__c_{c}")))
    return out.drop("__salt", "__is_hot", *[f"__h_{c}" for c in columns], *[f"__c_{c}" for c in columns])
