"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a word of random hyperplane bits; the vectors are
put in the lexicographic order of these words, and each is compared with the
next ``window`` of the order.  Verified pairs of all passes are united.

A pass also meets every pair whose words begin with the same ``prefix_bits``: the
vectors of such a cell stand together, so a cell of at most ``window`` + 1 lies in
the windows, and the members of a larger one are compared with each other in
blocks, unless the windows have joined them all.  So how densely vectors lie does
not matter: the number of passes follows from the prefix, and a pair at the
threshold, which shares each random bit with a known probability, is missed by all
passes with the stated one.  Where the large cells would take more comparisons
than all pairs, all pairs are compared, once, and none is missed.

Passes only have to connect a group: afterwards the members of each group are
compared with each other in blocks, and only counted, so the links of a vector
are complete however large its group is.  No pair is written for them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindscape.functions.session import settle
from bindscape.llm.graph import components

WINDOW = 48
KEY_BITS = 48
BLOCK_ROWS = 2048
MISS = 1e-5
SEED = 20240611


def prefix_bits(n: int, window: int = WINDOW) -> int:
    """First bits whose cells hold at most ``window`` of ``n`` vectors on average."""
    return min(KEY_BITS, max(1, math.ceil(math.log2(max(n, 2) / window))))


def number_of_passes(n: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes in none of which a pair at the threshold shares the prefix with probability ``miss``."""
    meet = (1 - math.acos(threshold) / math.pi) ** prefix_bits(n, window)
    return max(4, math.ceil(math.log(miss) / math.log1p(-meet)))


def _keys(passes: int):
    """(pass, dim, key, uid) of every vector."""
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            uid = batch.column(0).to_numpy()
            sizes = np.diff(vectors.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), passes * KEY_BITS))
                rows = np.flatnonzero(sizes == d)
                x = values[starts[rows][:, None] + np.arange(d)]
                bits = (x @ planes[d] >= 0).reshape(len(rows), passes, KEY_BITS)
                key = bits @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), p, np.int32)), pa.array(np.full(len(rows), d, np.int32)),
                         pa.array(key[:, p]), pa.array(uid[rows])], ["pass", "dim", "key", "uid"])
    return run


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each component of a graph of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _window_links(threshold: float, window: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        out = []
        for _, part in frame.groupby(["pass", "dim"], sort=False):
            x, uid = _unit(part["embedding"].to_numpy()), part["uid"].to_numpy()
            left, right = [], []
            for step in range(1, min(window, len(x) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold)
                left.append(near)
                right.append(near + step)
            if left:
                root = _roots(len(x), np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(root != np.arange(len(x)))
                out.append(pd.DataFrame({"a": uid[moved], "b": uid[root[moved]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}).astype("int64")
    return run


def _cell_links(threshold: float):
    """Links inside each cell, between its parts ``lo`` and ``hi``, as one tree a component."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, cell in frame.groupby(["pass", "dim", "prefix"], sort=False):
            x, uid, part = _unit(cell["embedding"].to_numpy()), cell["uid"].to_numpy(), cell["part"].to_numpy()
            one, two = (np.flatnonzero(part == cell[c].iloc[0]) for c in ("lo", "hi"))
            i, j = np.nonzero(x[one] @ x[two].T >= threshold)
            root = _roots(len(x), one[i], two[j])
            moved = np.flatnonzero(root != np.arange(len(x)))
            out.append(pd.DataFrame({"a": uid[moved], "b": uid[root[moved]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}).astype("int64")
    return run


def _in_blocks(rows: DataFrame, group: list[str], n: int, seed: int) -> DataFrame:
    """``rows`` (uid, size of its group, ...) with ``bundle``, ``whole``, ``part``, ``lo`` and ``hi``: all pairs
    of parts of each group; ``n`` is the number of rows, small groups share a bundle."""
    bundles = max(1, -(-n // BLOCK_ROWS))
    rows = rows.withColumn("parts", F.ceil(F.col("size") / BLOCK_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(seed)), "parts"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    own = F.xxhash64(*group)
    return rows.withColumns({
        "bundle": F.when(F.col("parts") == 1, F.pmod(own, F.lit(bundles))).otherwise(own), "whole": F.col("parts") == 1,
        "lo": F.least("part", "other"), "hi": F.greatest("part", "other")})


def _links_of_full_cells(order: DataFrame, groups: DataFrame, distinct: DataFrame, n: int, threshold: float, window: int) -> DataFrame | None:
    """Links of the cells that no window holds and that ``groups`` has not joined."""
    cell = ["pass", "dim", "prefix"]
    full = settle(order.groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > window + 1))
    inside = order.join(full, cell).join(groups, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    mixed = inside.groupBy(*cell, "size").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select(*cell, "size")
    mixed = settle(mixed)
    total, compared = mixed.agg(F.sum("size"), F.sum(F.col("size").cast("double") * F.col("size"))).first()
    if not total:
        return None
    if compared > float(n) * n:
        lengths = distinct.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("size"))
        rows = distinct.select("uid", F.size("embedding").alias("dim"), F.lit(0).alias("pass"), F.lit(0).cast("long").alias("prefix"))
        rows, total = rows.join(F.broadcast(lengths), "dim"), n
    else:
        rows = order.select(*cell, "uid").join(mixed, cell)
    rows = _in_blocks(rows, cell, total, 2).select("bundle", "whole", *cell, "uid", "part", "lo", "hi")
    rows = rows.join(distinct.select("uid", "embedding"), "uid")
    return rows.groupBy("bundle", "whole", "lo", "hi").applyInPandas(_cell_links(threshold), "a long, b long")


def _count_links(threshold: float):
    """Links inside each group, between its parts ``lo`` and ``hi``."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        uids, counts = [], []
        for _, group in frame.groupby(["root", "dim"], sort=False):
            one = group[group["part"] == group["lo"]]
            x, m = _unit(one["embedding"].to_numpy()), one["copies"].to_numpy()
            if group["lo"].iloc[0] == group["hi"].iloc[0]:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                uids.append(one["uid"].to_numpy())
                counts.append(near @ m)
                continue
            two = group[group["part"] == group["hi"]]
            if not len(one) or not len(two):
                continue
            near = x @ _unit(two["embedding"].to_numpy()).T >= threshold
            uids += [one["uid"].to_numpy(), two["uid"].to_numpy()]
            counts += [near @ two["copies"].to_numpy(), m @ near]
        if not uids:
            return pd.DataFrame({"uid": [], "n": []}).astype("int64")
        return pd.DataFrame({"uid": np.concatenate(uids), "n": np.concatenate(counts).astype(np.int64)})
    return run


def near_duplicate_vectors(
    vectors: DataFrame, *, threshold: float = 0.95, window: int = WINDOW, passes: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Two vectors of equal length link when their cosine, in double precision, is
    at least ``threshold``.  Null, empty and zero vectors, and those that hold
    null or non-finite components, link with nothing.  Equal vectors link with
    each other and are compared once.  ``component_id`` is the least id
    reachable, null ids left out; ``kept`` is true where it is the row's own id.
    Repeated ids keep a row each.  Other columns are not read; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("uid", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("embedding")))
    ids = settle(v.select("vec_id", "uid"))
    distinct = v.where(F.col("uid").isNotNull()).groupBy("embedding").agg(F.count("*").alias("copies"))
    distinct = settle(distinct.select(F.xxhash64("embedding").alias("uid"), "copies", "embedding"))
    n = distinct.count()
    passes = passes or number_of_passes(n, threshold, window)

    keys = distinct.select("uid", "embedding").mapInArrow(_keys(passes), "pass int, dim int, key long, uid long")
    parts = max(spark.sparkContext.defaultParallelism, -(-n * passes // 1_000_000))
    order = keys.repartitionByRange(parts, "pass", "dim", "key", "uid").sortWithinPartitions("pass", "dim", "key", "uid")
    prefix = F.shiftright("key", KEY_BITS - prefix_bits(n, window)).alias("prefix")
    order = settle(order.select("pass", "dim", prefix, "uid", F.monotonically_increasing_id().alias("place")))
    cell = F.shiftright("place", 33)
    sizes = {r["cell"]: r["n"] for r in order.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for c in sorted(sizes):
        offsets.append((c, total))
        total += sizes[c]
    offsets = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "cell long, before long"))
    ranked = order.withColumn("cell", cell).join(offsets, "cell").withColumn(
        "rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    own = F.floor(F.col("rank") / BLOCK_ROWS)
    # the first rows of a block also close the windows of the block before
    both = F.when((F.col("rank") % BLOCK_ROWS < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    ranked = ranked.select("pass", "dim", "uid", "rank", F.explode(both).alias("block"))
    blocks = ranked.join(distinct.select("uid", "embedding"), "uid")
    links = blocks.groupBy("block").applyInPandas(_window_links(threshold, window), "a long, b long")
    groups = components(links).select(F.col("node").alias("uid"), "root")
    more = _links_of_full_cells(order, groups, distinct, n, threshold, window)
    if more is not None:
        links = groups.select(F.col("uid").alias("a"), F.col("root").alias("b")).unionByName(more)
        groups = components(links).select(F.col("node").alias("uid"), "root")

    members = settle(groups.join(distinct, "uid"))
    size = members.groupBy("root").agg(F.count("*").alias("size"))
    members = members.join(size, "root").withColumn("parts", F.ceil(F.col("size") / BLOCK_ROWS))
    bundles = max(1, -(-members.count() // BLOCK_ROWS))
    members = members.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), "parts"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    members = members.select(
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root")).alias("bundle"),
        (F.col("parts") == 1).alias("whole"), "root", "uid", "copies", "part", F.size("embedding").alias("dim"),
        F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "embedding")
    counts = members.groupBy("bundle", "whole", "lo", "hi").applyInPandas(_count_links(threshold), "uid long, n long")
    counts = counts.groupBy("uid").agg(F.sum("n").alias("others"))

    by_vector = distinct.select("uid", "copies").join(groups, "uid", "left").join(counts, "uid", "left")
    by_vector = settle(by_vector.select(
        "uid", F.coalesce("root", "uid").alias("grp"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n")))
    rows = ids.join(by_vector, "uid", "left")
    least = rows.where("grp IS NOT NULL").groupBy("grp").agg(F.min("vec_id").alias("low"))
    rows = rows.join(least, "grp", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
