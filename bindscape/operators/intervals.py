"""Bin grids, interval overlap, interval merge and interval-set similarity.

Overlap counts form no interval pairs.  They come from two running counts
over positions: the intervals that meet [s, e) are those that start before e
minus those that end at or before s.  Merging walks the coverage depth.  Only the
search of interval sets lists overlapping pairs, in one sweep over tiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from bindscape.functions.prefix import bucketed_prefix, position_bucket
from bindscape.functions.session import broadcast_if_small, settle, spread

KEY = ("chrom", "start", "stop")
BLOCK_BINS = 20_000
SWEEP_TILE = 1 << 16  # positions of a tile of the sweep
SWEEP_ROWS = 1 << 18  # intervals of a side that a cell of a tile holds, about


def tile(sizes: DataFrame, *, width: int = 200, step: int = 50) -> DataFrame:
    """Sliding bins ``[start, start+width)`` with ``start + width < length``.

    Chromosomes are first cut into blocks so that one long chromosome is
    generated by many tasks.
    """
    span = BLOCK_BINS * step
    blocks = sizes.where(F.col("length") > width).select(
        "chrom",
        "length",
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), (F.col("length") - width - 1).cast("bigint"), F.lit(span).cast("bigint"))
        ).alias("block"),
    )
    blocks = spread(blocks, "chrom", "block")
    last = F.least(F.col("block") + (span - step), F.col("length") - width - 1).cast("bigint")
    return blocks.select(
        "chrom", F.explode(F.sequence("block", last, F.lit(step).cast("bigint"))).alias("start")
    ).select("chrom", "start", (F.col("start") + width).alias("stop"))


def bins_hit(intervals: DataFrame, *, width: int = 200, step: int = 50) -> DataFrame:
    """Each interval once per grid bin it shares at least 1 bp with."""
    low = F.greatest(F.lit(0), F.floor((F.col("start") - width) / step) + 1).cast("bigint")
    high = (F.ceil(F.col("stop") / step) - 1).cast("bigint")
    return (
        intervals.withColumn("__lo", low)
        .withColumn("__hi", high)
        .where("start < stop AND __lo <= __hi")
        .withColumn("__bin", F.explode(F.sequence("__lo", "__hi")))
        .withColumn("bin_start", F.col("__bin") * step)
        .drop("__lo", "__hi", "__bin")
    )


def count_bins(
    bins: DataFrame,
    intervals: DataFrame,
    *,
    width: int = 200,
    step: int = 50,
    values: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per grid bin: intervals that overlap it, zeros kept.

    Bins and hits are stacked and summed in one shuffle with map-side combine,
    so a bin that draws a third of all intervals costs one row per map task.
    ``values`` are further per-interval amounts to sum.
    """
    values = dict(values or {})
    names = ["n_overlap", *values]
    hit = bins_hit(intervals, width=width, step=step).select(
        "chrom",
        F.col("bin_start").alias("start"),
        F.lit(0).alias("__grid"),
        F.lit(1).cast("bigint").alias("n_overlap"),
        *[expr.alias(n) for n, expr in values.items()],
    )
    grid = bins.select(
        "chrom",
        "start",
        F.lit(1).alias("__grid"),
        F.lit(0).cast("bigint").alias("n_overlap"),
        *[F.lit(0).cast(hit.schema[n].dataType).alias(n) for n in values],
    )
    return (
        grid.unionByName(hit)
        .groupBy("chrom", "start")
        .agg(F.max("__grid").alias("__grid"), *[F.sum(n).alias(n) for n in names])
        .where("__grid = 1")
        .select("chrom", "start", (F.col("start") + width).alias("stop"), *names)
    )


def count_overlaps(
    left: DataFrame, right: DataFrame, *, by: Sequence[str] = ("chrom",), name: str = "n_overlap"
) -> DataFrame:
    """``left`` plus the number of ``right`` intervals sharing at least 1 bp."""
    by = list(by)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    marks = right.where("start < stop").select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("start").alias("pos"), one.alias("opened"), zero.alias("closed")),
                F.struct(F.col("stop").alias("pos"), zero.alias("opened"), one.alias("closed")),
            )
        ).alias("m"),
    ).select(*by, "m.*")
    asked = left.select(*by, F.explode(F.array("start", "stop")).alias("pos")).select(
        *by, "pos", zero.alias("opened"), zero.alias("closed")
    )
    steps = settle(
        marks.unionByName(asked)
        .groupBy(*by, "pos")
        .agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    )
    bucket = position_bucket(steps, by, "pos")
    run = bucketed_prefix(steps, by, ["pos"], bucket, sums={"__o": "opened", "__c": "closed"})
    opened_before = run.select(
        *by, F.col("pos").alias("stop"), (F.col("__o") - F.col("opened")).alias("__opened")
    )
    closed_until = run.select(*by, F.col("pos").alias("start"), F.col("__c").alias("__closed"))
    n = F.when(F.col("start") < F.col("stop"), F.col("__opened") - F.col("__closed")).otherwise(zero)
    return (
        left.join(opened_before, [*by, "stop"])
        .join(closed_until, [*by, "start"])
        .select(*left.columns, n.cast("bigint").alias(name))
    )


def overlapping(left: DataFrame, right: DataFrame, *, by: Sequence[str] = ("chrom",)) -> DataFrame:
    """Left rows that meet any right interval, each once."""
    return count_overlaps(left, right, by=by, name="__n").where("__n > 0").drop("__n")


def indicator(df: DataFrame, count: str = "n_overlap", name: str = "hit") -> DataFrame:
    return df.withColumn(name, (F.col(count) != 0).cast("int"))


def merge_intervals(
    df: DataFrame,
    *,
    by: Sequence[str] = ("chrom",),
    gap: int = 0,
    mean: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Union of overlapping or book-ended intervals (``gap`` bp apart allowed).

    A merged interval opens where no earlier interval is still open, and its
    members are the intervals that start before the next opening.  Returns
    ``by, start, stop, n_members`` and the member mean of ``mean``.
    """
    by = list(by)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    carried = [F.col(mean).cast("double").alias("__v")] if mean else []
    opened = df.select(*by, F.col("start").alias("pos"), one.alias("d"), one.alias("n"),
                       F.col("stop").alias("far"), *carried)
    closed = df.select(*by, (F.col("stop") + gap).alias("pos"), (-one).alias("d"), zero.alias("n"),
                       F.lit(None).cast("bigint").alias("far"),
                       *([F.lit(0.0).alias("__v")] if mean else []))
    steps = settle(
        opened.unionByName(closed)
        .groupBy(*by, "pos")
        .agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.max("far").alias("far"),
             *([F.sum("__v").alias("__v")] if mean else []))
    )
    bucket = position_bucket(steps, by, "pos")
    depth = bucketed_prefix(steps, by, ["pos"], bucket, sums={"__depth": "d"})
    opening = F.when((F.col("n") > 0) & (F.col("__depth") - F.col("d") == 0), F.col("pos"))
    marked = bucketed_prefix(depth.withColumn("__open", opening), by, ["pos"], bucket, maxes={"__first": "__open"})
    out = marked.where("n > 0").groupBy(*by, F.col("__first").alias("start")).agg(
        F.max("far").alias("stop"),
        F.sum("n").alias("n_members"),
        *([(F.sum("__v") / F.sum("n")).alias(name or mean)] if mean else []),
    )
    return out


def coverage_support(
    bins: DataFrame, intervals: DataFrame, *, sample: str = "sample_id", width: int = 200, step: int = 50
) -> DataFrame:
    """Per grid bin: number of distinct samples with an overlapping interval."""
    hit = bins_hit(intervals, width=width, step=step).select(
        "chrom", F.col("bin_start").alias("start"), sample
    ).distinct()
    stacked = bins.select("chrom", "start", F.lit(1).alias("__grid"), F.lit(0).cast("bigint").alias("support")).unionByName(
        hit.select("chrom", "start", F.lit(0).alias("__grid"), F.lit(1).cast("bigint").alias("support"))
    )
    return (
        stacked.groupBy("chrom", "start")
        .agg(F.max("__grid").alias("__grid"), F.sum("support").alias("support"))
        .where("__grid = 1")
        .select("chrom", "start", (F.col("start") + width).alias("stop"), "support")
    )


def support_matrix(
    bins: DataFrame,
    intervals: DataFrame,
    *,
    sample: str = "sample_id",
    samples: Sequence | None = None,
    width: int = 200,
    step: int = 50,
) -> DataFrame:
    """Replicate indicators: long ``(chrom,start,sample)`` rows, or one 0/1
    column per entry of ``samples``, zeros kept."""
    hit = bins_hit(intervals, width=width, step=step).select(
        "chrom", F.col("bin_start").alias("start"), sample
    ).distinct()
    if samples is None:
        return hit.join(bins, ["chrom", "start"], "left_semi")
    flags = [
        F.coalesce(F.max(F.when(F.col(sample) == s, 1)), F.lit(0)).cast("int").alias(f"s_{s}") for s in samples
    ]
    kind = hit.schema[sample].dataType
    stacked = bins.select("chrom", "start", F.lit(None).cast(kind).alias(sample), F.lit(1).alias("__grid")).unionByName(
        hit.withColumn("__grid", F.lit(0))
    )
    return (
        stacked.groupBy("chrom", "start")
        .agg(F.max("__grid").alias("__grid"), *flags)
        .where("__grid = 1")
        .select("chrom", "start", (F.col("start") + width).alias("stop"), *[f"s_{s}" for s in samples])
    )


def reproducible(
    regions: DataFrame, intervals: DataFrame, *, samples: Sequence, sample: str = "sample_id"
) -> DataFrame:
    """Regions with replicate support columns summarised as ``n_rep, n_support``."""
    keyed = regions.select(*KEY).withColumn(sample, F.explode(F.array(*[F.lit(s) for s in samples])))
    counted = count_overlaps(keyed, intervals.select("chrom", "start", "stop", sample), by=("chrom", sample))
    return counted.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rep"),
        F.sum((F.col("n_overlap") > 0).cast("bigint")).alias("n_support"),
    )


def keep_reproducible(df: DataFrame) -> DataFrame:
    """At least two supporting replicates, or a single replicate overall."""
    return df.where("n_support >= 2 OR n_rep = 1")


def keep_majority(df: DataFrame, share: float = 0.5) -> DataFrame:
    """More than ``share`` of the replicates support the row."""
    return df.where(F.col("n_support") / F.col("n_rep") > share)


def at_most_wide(df: DataFrame, width: int = 1000) -> DataFrame:
    return df.where(F.col("stop") - F.col("start") <= width)


def first_in_file(df: DataFrame, n: int, *, sample: str = "sample_id", rank: str = "file_rank") -> DataFrame:
    """The first ``n`` rows of every sample's file order."""
    return df.where(F.col(rank) <= n)


def _meeting(d_start, d_stop, q_start, q_stop, tile_from, tile_to):
    """Index pairs (d, q) of overlapping intervals whose later start lies in the tile.

    A query that starts inside an interval is found by its start.  One that is still open where an
    interval starts has begun at most its own length before: queries go by length class, so a
    class's candidates are those that began within twice the least length of the class.
    """
    order = np.argsort(q_start, kind="stable")
    first, stop = q_start[order], q_stop[order]
    pairs = []

    def add(d, low, high, keys, open_at_start):
        many = np.maximum(high - low, 0)
        i = np.repeat(d, many)
        ends = np.cumsum(many)
        j = keys[np.repeat(low, many) + np.arange(len(i)) - np.repeat(ends - many, many)]
        if open_at_start:
            still = stop[j] > d_start[i]
            i, j = i[still], j[still]
        pairs.append((i, order[j]))

    every = np.arange(len(d_start))
    low = np.searchsorted(first, np.maximum(d_start, tile_from - 1), side="right")
    add(every, low, np.searchsorted(first, np.minimum(d_stop, tile_to)), np.arange(len(first)), False)
    here = every[(d_start >= tile_from) & (d_start < tile_to)]
    size_class = np.log2(np.maximum(stop - first, 1)).astype(np.int64)
    for c in np.unique(size_class):
        own = np.flatnonzero(size_class == c)
        low = np.searchsorted(first[own], d_start[here] - (2 << c), side="right")
        add(here, low, np.searchsorted(first[own], d_start[here], side="right"), own, True)
    return tuple(np.concatenate(x) for x in zip(*pairs))


def overlaps_between(
    database: DataFrame, query: DataFrame, *, set_id: str = "set_id", query_id: str = "query_id",
    tile: int = SWEEP_TILE, cell_rows: int = SWEEP_ROWS,
) -> DataFrame:
    """(set_id, query_id, n_overlap, n_hit) of the pairs of sets that meet: overlapping interval
    pairs, and database intervals with any.

    One sweep over both tables: every interval goes to the tiles it covers, each tile finds its
    overlapping pairs once (in the tile of the later start) and sums them by interval and query
    set.  The work is linear in the intervals, the tiles they cover and their overlaps.  A
    tile with more than ``cell_rows`` intervals of a side is dealt to a grid of cells.
    """
    def tiled(df, key, side):
        last = F.greatest(F.col("stop") - 1, F.col("start"))
        rows = df.where("start < stop").select(
            "chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col(key).cast("string").alias("key"),
            F.monotonically_increasing_id().alias("row"))
        return settle(rows.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor(last / tile))))
                      .withColumn("side", F.lit(side)))

    db, asked = tiled(database, set_id, 0), tiled(query, query_id, 1)
    count = lambda t, name: t.groupBy("chrom", "tile").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias(name))
    # few tiles hold more than a cell: at most as many as there are cells full of rows
    crowded = count(db, "d").join(count(asked, "q"), ["chrom", "tile"]).where("d > 1 OR q > 1")
    crowded = broadcast_if_small(crowded)

    def dealt(t, own, other):
        t = t.join(crowded, ["chrom", "tile"], "left")
        mine = F.pmod(F.xxhash64("row"), F.coalesce(own, F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return t.withColumn("mine", mine).withColumn("theirs", theirs)

    cells = dealt(db, F.col("d"), F.col("q")).withColumnsRenamed({"mine": "dc", "theirs": "qc"}).unionByName(
        dealt(asked, F.col("q"), F.col("d")).withColumnsRenamed({"mine": "qc", "theirs": "dc"}))
    set_kind, query_kind = database.schema[set_id].dataType.simpleString(), query.schema[query_id].dataType.simpleString()
    cells = cells.select("chrom", "tile", "dc", "qc", "side", "start", "stop", "row", "key")

    def found(key, row, asked, n):
        return pd.DataFrame({
            "key": pd.Series(key, dtype=object), "row": pd.Series(row, dtype="int64"),
            "asked": pd.Series(asked, dtype=object), "n": pd.Series(n, dtype="int64")})

    def sweep(key, frame):
        d, q = frame[frame["side"] == 0], frame[frame["side"] == 1]
        if not len(d) or not len(q):
            return found([], [], [], [])
        at = int(key[1]) * tile
        i, j = _meeting(*(x[c].to_numpy(np.int64) for x in (d, q) for c in ("start", "stop")), at, at + tile)
        code, names = pd.factorize(q["key"], use_na_sentinel=False)
        pair, n = np.unique(i * len(names) + code[j], return_counts=True)
        i, code = pair // len(names), pair % len(names)
        return found(d["key"].to_numpy(object)[i], d["row"].to_numpy()[i], names.to_numpy(object)[code], n)

    met = cells.groupBy("chrom", "tile", "dc", "qc").applyInPandas(sweep, "key string, row long, asked string, n long")
    per_row = met.groupBy("key", "asked", "row").agg(F.sum("n").alias("n"))
    return per_row.groupBy(F.col("key").cast(set_kind).alias(set_id), F.col("asked").cast(query_kind).alias(query_id)).agg(
        F.sum("n").alias("n_overlap"), F.count("*").alias("n_hit"))


def rank_interval_sets(
    query: DataFrame,
    database: DataFrame,
    *,
    set_id: str = "set_id",
    query_id: str = "query_id",
    query_ids: Sequence,
    genome: int | Column,
) -> DataFrame:
    """Overlap enrichment of every query against every labelled interval set.

    Both tables are swept once for all queries together (``overlaps_between``).  The score is
    ``log2(odds) * overlaps``: odds compare overlaps with those expected from
    the covered bases; larger is better, ties go to the smaller set id.
    """
    def sizes(df, key, n, bp):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.sum(F.col("stop") - F.col("start")).alias(bp))

    # one row for each set and query asked: the result's own size
    per_set = sizes(database, set_id, "n_set", "set_bp").withColumn(query_id, F.explode(F.array(*[F.lit(q) for q in query_ids])))
    pairs = per_set.join(sizes(query, query_id, "n_query", "query_bp"), query_id)
    met = overlaps_between(database, query.where(F.col(query_id).isin(*query_ids)), set_id=set_id, query_id=query_id)
    pairs = pairs.join(met, [set_id, query_id], "left").fillna(0, ["n_overlap", "n_hit"])
    length = genome if isinstance(genome, Column) else F.lit(genome)
    expected = (
        F.col("n_query") * F.col("set_bp") + F.col("n_set") * F.col("query_bp")
    ) / length
    return pairs.select(
        query_id, set_id, "n_query", "n_set", "n_overlap", "n_hit",
        (F.col("n_overlap") * F.log2((F.col("n_overlap") + 1) / (expected + 1))).alias("combo_score"),
    )


def best_interval_set(ranked: DataFrame, *, set_id: str = "set_id", query_id: str = "query_id") -> DataFrame:
    """The highest-scoring set of each query."""
    best = F.max_by(F.struct(set_id, "combo_score"), F.struct("combo_score", (-F.col(set_id)).alias("tie")))
    return ranked.groupBy(query_id).agg(best.alias("b")).select(query_id, "b.*")
