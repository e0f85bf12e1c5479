"""Nearest neighbours by multi-index hashing of learned binary codes.

*Codes.*  Vectors are scaled by the greatest norm of the table and get one more component
that brings each to length one, so the angle to a query follows the inner product alone.  Rotations
are learned on a bounded sample (iterative quantisation: signs, then the orthogonal matrix
nearest to them, in turns); the signs of the rotated components are the code.

*Index.*  Every vector is in one shard.  A shard keeps its codes, and for each 16-bit
substring of the codes the order of the codes by that substring; it is built once and written.

*Search.*  If two codes differ in at most ``r`` bits, and the thresholds ``t_j`` of the
substrings have ``sum(t_j + 1) = r + 1``, then some substring differs in at most ``t_j`` bits.
All values within ``t_j`` bits of the query's substring are looked up, and the codes found there are
compared whole: exactly the codes within ``r``.  Once the values to look up outnumber the
shard's codes, comparing every code gives the same set with less work.  The radius
grows until ``k`` codes are inside; their inner products give the ``k``-th best score so far, and from
that the radius of vectors with this score (a bit differs with probability angle / pi), with a
margin.  If the radius is smaller than that, one more retrieval brings it there.  Better
vectors lie nearer, so the share missed is small.  Every code inside is ranked by its vector in double precision.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bindscape.functions.session import settle
from bindscape.llm.words import ragged

BITS = 256
SUBSTRING = 16  # bits
SAMPLE = 4096  # vectors that the rotations are learned on
TURNS = 25  # of learning a rotation
SHARD_ROWS = 1 << 14  # vectors of a shard, about
QUERY_ROWS = 1 << 12  # queries of a block, about
DEVIATIONS = 1.0  # standard deviations by which the radius exceeds the expected distance
FIRST_RADII = (15, 47)  # tried before the radius that takes in the k nearest codes

_SUBSTRINGS = BITS // SUBSTRING
#: all 16-bit masks by number of set bits, and how many have at most 0, 1, ... of them
_MASKS = np.array([sum(1 << b for b in c) for w in range(SUBSTRING + 1) for c in combinations(range(SUBSTRING), w)], np.uint16)
_MASKS_UP_TO = np.cumsum(np.bincount(np.bitwise_count(_MASKS), minlength=SUBSTRING + 1))


def learn_rotations(sample: np.ndarray, seed: int = 17) -> np.ndarray:
    """(dimensions, BITS) projections: columns of rotations learned one after the other."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    # the directions in which the sample reaches farthest, if there are more than bits
    axes = np.linalg.svd(sample.T @ sample)[0][:, : min(d, BITS)]
    x, made = sample @ axes, []
    while sum(m.shape[1] for m in made) < BITS:
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(TURNS):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ turn >= 0, 1.0, -1.0))
            turn = u @ v
        made.append(axes @ turn)
    return np.concatenate(made, axis=1)[:, :BITS]


def lifted(x: np.ndarray, norm: float | None = None) -> np.ndarray:
    """Rows of length one: vectors with the component that they lack of ``norm``; queries (None) scaled."""
    size = np.linalg.norm(x, axis=1)
    if norm is None:
        return np.c_[x / size[:, None], np.zeros(len(x))]
    return np.c_[x, np.sqrt(np.maximum(norm * norm - size * size, 0))] / norm


def encode(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(rows, BITS / 64) codes."""
    return np.packbits(x @ rotations >= 0, axis=1).view(np.uint64)


class ShardIndex:
    """Codes of a shard and the buckets of their substrings."""

    def __init__(self, codes: np.ndarray, order: np.ndarray | None = None):
        self.columns = np.ascontiguousarray(codes.T)
        keys = np.ascontiguousarray(codes).view(np.uint16).reshape(len(codes), _SUBSTRINGS)
        self.order = np.ascontiguousarray(np.argsort(keys, axis=0, kind="stable").T) if order is None else order
        self.starts = np.zeros((_SUBSTRINGS, (1 << SUBSTRING) + 1), np.int64)
        for j in range(_SUBSTRINGS):
            np.cumsum(np.bincount(keys[:, j], minlength=1 << SUBSTRING), out=self.starts[j, 1:])

    def __len__(self) -> int:
        return self.columns.shape[1]

    def distances(self, code: np.ndarray, rows=slice(None)) -> np.ndarray:
        total = np.bitwise_count(self.columns[0, rows] ^ code[0]).astype(np.int16)
        for column, word in zip(self.columns[1:], code[1:]):
            total += np.bitwise_count(column[rows] ^ word)
        return total


class Probe:
    """One query's retrievals from a shard; ``compared`` counts the codes compared whole."""

    def __init__(self, index: ShardIndex, code: np.ndarray):
        self.index, self.code, self.compared, self.all = index, code, 0, None

    def distances(self) -> np.ndarray:
        if self.all is None:
            self.all = self.index.distances(self.code)
            self.compared += len(self.index)
        return self.all

    def within(self, radius: int) -> np.ndarray:
        """Rows of all codes within ``radius`` bits."""
        share, more = divmod(radius + 1, _SUBSTRINGS)
        within = [share - (j >= more) for j in range(_SUBSTRINGS)]
        looked = [int(_MASKS_UP_TO[min(t, SUBSTRING)]) if t >= 0 else 0 for t in within]
        if self.all is not None or sum(looked) >= len(self.index):
            return np.flatnonzero(self.distances() <= radius)
        met = np.zeros(len(self.index), bool)
        for j, n in enumerate(looked):
            values = (self.code.view(np.uint16)[j] ^ _MASKS[:n]).astype(np.int64)
            low = self.index.starts[j, values]
            size = self.index.starts[j, values + 1] - low
            met[self.index.order[j, np.repeat(low, size) + ragged(size)]] = True
        rows = np.flatnonzero(met)
        self.compared += len(rows)
        return rows[self.index.distances(self.code, rows) <= radius]


def radius_for(cosine: float) -> int:
    """Bits within which vectors of this cosine lie, but for a sixth of them if their bits were
    independent; those of a rotation scatter less."""
    share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return int(np.ceil(BITS * share + DEVIATIONS * np.sqrt(BITS * share * (1 - share))))


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    # summed row by row in one order, so equal vectors have equal scores
    return (vectors.astype(np.float64) * query).sum(axis=1)


def shard_neighbours(index, vectors, ids, rows, query, code, own_row, norm, k) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of a query's ``k`` nearest found in a shard, and the codes compared."""
    probe = Probe(index, code)

    def best(radius):
        found = probe.within(radius)
        found = found[rows[found] != own_row]
        score = _scores(vectors[found], query)
        top = np.lexsort((rows[found], ids[found], -score))[:k]
        return found[top], score[top]

    for radius in FIRST_RADII:
        at, score = best(radius)
        if len(at) == k:
            break
    else:
        # the distance of the k-th nearest code, the query's own row left out
        last = min(k, len(index) - 1)
        radius = int(np.partition(probe.distances(), last)[last])
        at, score = best(radius)
    need = radius_for(score[-1] / (norm * np.linalg.norm(query))) if len(at) == k else BITS
    if need > radius:
        at, score = best(need)
    return at, score, probe.compared


NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last


def _matrix(lists, d: int) -> np.ndarray:
    out = np.zeros((len(lists), d))
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def _packed(rows: DataFrame, part: str, d: int, rotations: np.ndarray, norm: float | None) -> DataFrame:
    """One row a part: ids, rows, vectors, codes, and for shards (``norm``) the orders by substring."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(frame["v"].tolist(), d)
        codes = encode(lifted(x, norm), rotations)
        order = ShardIndex(codes).order.astype(np.int32).tobytes() if norm is not None else b""
        return pd.DataFrame({
            part: [int(frame["part"].iloc[0])], "ids": [frame["id"].fillna(NO_ID).astype(np.int64).to_numpy().tobytes()],
            "rows": [frame["row"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "codes": [codes.tobytes()], "ord": [order]})

    kinds = f"{part} long, ids binary, rows binary, x binary, codes binary, ord binary"
    # ids go as decimals: a null must not turn them into floats
    rows = rows.select("part", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "row", "v")
    return settle(rows.groupBy("part").applyInPandas(pack, kinds))


def _search(d: int, norm: float, k: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind=np.int64: np.frombuffer(batch.column(batch.schema.get_field_index(name))[r].as_buffer(), kind)  # noqa: B023, E731
                codes = get("codes", np.uint64).reshape(-1, BITS // 64)
                index = ShardIndex(codes, get("ord", np.int32).reshape(_SUBSTRINGS, -1))
                ids, rows, x = get("ids"), get("rows"), get("x", np.float64).reshape(-1, d)
                queries, q_codes = get("q_x", np.float64).reshape(-1, d), get("q_codes", np.uint64).reshape(-1, BITS // 64)
                out = []
                for q, (q_id, q_row) in enumerate(zip(get("q_ids"), get("q_rows"))):
                    at, score, compared = shard_neighbours(index, x, ids, rows, queries[q], q_codes[q], q_row, norm, k)
                    n = len(at)
                    out.append((np.full(n, q_row), np.full(n, q_id), rows[at], ids[at], score, np.full(n, compared)))
                q_row, q_id, row, vec_id, score, compared = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_row), pa.array(q_id), pa.array(row), pa.array(vec_id, mask=vec_id == NO_ID), pa.array(score),
                     pa.array(compared)], ["query_row", "query_id", "row", "vec_id", "score", "compared"])
    return run


def nearest(
    vectors: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for each query.

    Nearest is the largest inner product, in double precision; ties go to the smaller id
    (null ids last).  Queries are the rows whose id is divisible by ``every``.  Null and zero
    vectors and those that hold null or non-finite components take no part; a shorter
    vector counts as padded with zeros.  A repeated id is a candidate of its twin and a query of its
    own.  A shard with at most ``k`` other rows gives all of them.  Other columns are not
    read; an empty table gives no rows.

    Every row is indexed; only the rotations come from a sample, of ``SAMPLE`` vectors by
    hash.  Queries times shards is the work; both come in blocks, nothing is broadcast.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, d, norm, n_queries = rows.agg(
        F.count("*"), F.max(F.size("v")), F.max(length), F.count(F.when(F.col("id") % every == 0, 1))).first()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = [r.v for r in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()]
    rotations = learn_rotations(lifted(_matrix(sample, d), norm))
    n_shards, n_blocks = -(-n // SHARD_ROWS), -(-n_queries // QUERY_ROWS)

    def parts(count):
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("long")

    shards = _packed(rows.withColumn("part", parts(n_shards)), "shard", d, rotations, norm)
    blocks = _packed(rows.where(F.col("id") % every == 0).withColumn("part", parts(n_blocks)), "block", d, rotations, None)
    blocks = blocks.select("block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "x", "codes")])
    # every block of queries meets every shard, each pair in a group of its own
    pairs = shards.withColumn("block", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)"))).join(
        blocks.withColumn("shard", F.explode(F.expr(f"sequence(0L, {n_shards - 1}L)"))), ["shard", "block"])
    found = pairs.mapInArrow(_search(d, norm, k), "query_row long, query_id long, row long, vec_id long, score double, compared long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
