"""Exact top-k inner products by an impact-ordered index, score at a time.

The index of a shard of candidates holds postings (component, candidate) in
segments of equal quantised impact, the greatest first; the impact is the
magnitude of the component, rounded down to a multiple of the segment step.  A
block of queries adds up segment after segment.  After each, what a candidate may
still gain or lose is bounded by the query's weights and the segment's limit.  A
query stops only when this bound proves that all but its possible members are out;
those are scored again exactly.

Queries and shards meet in blocks: every query sees every candidate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from bindscape.functions.session import settle

SHARD_ROWS = 4096
QUERY_ROWS = 1024
SEGMENTS = 6  # segments of a shard; each halves the impact that is left
RESCORE_SHARE = 0.02  # a query goes on while more of a shard than this may be a member
EXACT = 2.0 ** 53
NO_ID = np.iinfo(np.int64).max  # stands for a null id, and sorts behind all others


def _matrix(column, k: int):
    """(ids, row keys, integer vectors) of packed rows ``k``."""
    rows = column[k].values
    ids = pc.fill_null(rows.field("id"), NO_ID).to_numpy(zero_copy_only=False)
    vectors = rows.field("v")
    sizes = np.diff(vectors.offsets.to_numpy())
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * 256)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(ids), width))
    out[np.repeat(np.arange(len(ids)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return ids, rows.field("row").to_numpy(zero_copy_only=False), out


def impact_segments(x: np.ndarray, segments: int = SEGMENTS):
    """(postings with quantised impacts, limit of what is left) by descending impact."""
    top = float(np.abs(x).max()) if x.size else 0.0
    left = np.abs(x)
    sign = np.sign(x)
    limit = top
    for k in range(segments):
        step = max(1.0, np.floor(top / 2 ** (k + 1)))
        # whole steps of what earlier segments left
        taken = np.floor(left / step) * step
        left = left - taken
        limit = min(limit, step - 1)
        yield sign * taken, limit
        if limit <= 0:
            return


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    size = np.abs(q).sum(axis=-1).max(initial=0) * np.abs(x).max(initial=0)
    if size < EXACT:
        return (q @ x.T).astype(np.int64)
    wide = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return (np.array([int(v) for v in q], dtype=object) @ wide.T).astype(np.int64)


def shard_top_k(queries, candidates, k: int):
    """(query place, candidate place, score) of each query's k best in a shard.

    ``queries`` and ``candidates`` are (ids, row keys, vectors); a candidate with the
    query's own row key is left out.  Ties go to the smaller id, null ids last.
    """
    _, q_rows, q = queries
    ids, rows, x = candidates
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    own = {r: i for i, r in enumerate(rows)}
    mine = np.array([own.get(r, -1) for r in q_rows], np.int64)
    weight = np.abs(q).sum(axis=1)
    exact = weight.max(initial=0) * np.abs(x).max(initial=0) < EXACT
    out = []

    def close(which, scores, slack):
        """Rescore the possible members of queries ``which``."""
        for i, row in zip(which, scores):
            keep = np.arange(len(x))
            if k < len(x):
                least = np.partition(row, len(row) - k)[len(row) - k] - slack[i]
                keep = np.flatnonzero(row + slack[i] >= least)
            keep = keep[keep != mine[i]]
            value = _exact_scores(q[i], x[keep]) if not exact else np.rint(q[i] @ x[keep].T).astype(np.int64)
            best = np.lexsort((rows[keep], ids[keep], -value))[:k]
            out.append((np.full(len(best), i), keep[best], value[best]))

    if not exact:
        close(np.arange(len(q)), np.zeros((len(q), len(x))), np.full(len(q), np.inf))
    else:
        total = np.zeros((len(q), len(x)))
        hidden = np.flatnonzero(mine >= 0)
        open_ = np.arange(len(q))
        for postings, limit in impact_segments(x):
            total[open_] += q[open_] @ postings.T
            total[hidden, mine[hidden]] = -np.inf
            slack = weight * limit
            if limit > 0 and k < len(x):
                scores = total[open_]
                least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] - slack[open_]
                possible = (scores + slack[open_][:, None] >= least[:, None]).sum(axis=1)
                ready = possible <= max(k, RESCORE_SHARE * len(x))
            else:
                ready = np.ones(len(open_), bool)
            close(open_[ready], total[open_[ready]], slack)
            open_ = open_[~ready]
            if not len(open_):
                break
        if len(open_):
            close(open_, total[open_], slack)
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _search(k: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                queries, shard = _matrix(batch.column(0), r), _matrix(batch.column(1), r)
                i, j, score = shard_top_k(queries, shard, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[1][i]), pa.array(queries[0][i]), pa.array(shard[1][j]),
                     pa.array(shard[0][j], mask=shard[0][j] == NO_ID), pa.array(score)], ["query_row", "query_id", "row", "id", "score"])
    return run


def _packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    parts = max(1, -(-rows.count() // size))
    part = F.pmod(F.xxhash64("row"), F.lit(parts))
    packed = rows.groupBy(part.alias("part")).agg(F.collect_list(F.struct("id", "row", "v")).alias(name))
    return settle(packed), parts


def exact_top_k(
    vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows.

    Components x count as floor(256 x), the score is the integer inner product.
    Queries are the rows whose id is divisible by ``every``.  Ties go to the
    smaller id (null ids last).  Null vectors and vectors that hold null or
    non-finite components take no part; a shorter vector counts as padded with
    zeros.  A repeated id is a candidate of its twin and a query of its own.
    Other columns are not read; an empty table gives no rows.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", bad))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    shards, _ = _packed(rows, SHARD_ROWS, "shard")
    blocks, n_blocks = _packed(rows.where(F.col("id") % every == 0), QUERY_ROWS, "queries")
    # every block of queries against every shard
    pairs = shards.select("shard", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("part"))
    pairs = pairs.repartition(max(1, n_blocks * shards.count()), F.monotonically_increasing_id()).join(blocks, "part")
    found = pairs.select("queries", "shard").mapInArrow(
        _search(k), "query_row long, query_id long, row long, id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
