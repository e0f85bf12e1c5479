"""Regression trees grown best leaf first, for several models in the same passes.

Features are binned once and packed into blocks of rows, which go to Python as they are.
A pass counts gradient, hessian and rows by (model, node, feature, bin): each task adds up
its own blocks, the sums of the tasks are added by a shuffle of packed arrays.  The sums of
a pass are a table of the shared folder, so that no plan holds the passes before it.  Of two children only the smaller is counted; the other is its
parent minus it.  A pass opens the best nodes of all models at once, ahead of their
turn; which splits a tree takes is then decided best first among the known gains, so
the tree is the one that opening leaf by leaf gives, and passes grow with its depth, not its leaves.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindscape.functions.session import remove, scratch_path, write_table

FEATURE_BLOCK = 64  # features that one packed array holds
BLOCK_ROWS = 16_384  # rows that one block holds at most
BLOCK_BYTES = 32 << 20  # of the features a task holds to pack them
MIN_HESSIAN = 1e-12
MIN_GAIN = 1e-12


@dataclass
class Tree:
    """Node arrays; ``feature`` is -1 at leaves, ``left``/``right`` are indices."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row; a value up to the threshold goes left."""
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)


# ---- bins ------------------------------------------------------------------

def bin_edges(df: DataFrame, features: str, max_bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature, at quantiles of the rows."""
    # packing takes arrays of one length only, so any row tells it
    one = df.where(F.col(features).isNotNull()).select(F.size(features)).first()
    n = one[0] if one else 0
    if not n:
        return []
    shares = [k / max_bins for k in range(max_bins + 1)]
    cuts = df.agg(*[F.percentile_approx(F.get(features, F.lit(j)).cast("double"), shares, 10_000).alias(f"c{j}") for j in range(n)]).first()
    # a value above the last edge has no bin to its right, so the greatest value is no edge
    return [np.unique(np.array(c if c is not None else [], float))[:-1] for c in cuts]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; NaN is in the last bin, to the right of every split."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long arrays; a missing value is NaN."""
    if not len(column):
        return np.zeros((0, 1))
    width = len(column[0])
    if column.null_count or not np.all(np.diff(column.offsets.to_numpy()) == width):
        raise ValueError("feature arrays must have one length")
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of arrays."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.ascontiguousarray(rows, float).ravel()))


def packed(df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of the rows ``key, set_name, features, y, w, margin``, each of one key and set, and of
    rows that all have weight (``fits``) or all have none.  ``bins`` holds the bin numbers row
    by row, ``y``, ``w`` and ``margin`` are arrays."""
    numbers = ["y", "w", "margin"]
    limit = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(len(edges), 1))))

    def blocks(table: pa.Table):
        table = table.combine_chunks()
        codes = np.unique(table["key"].to_numpy(), return_inverse=True)[1]
        names = table["set_name"].combine_chunks().dictionary_encode()
        fits = np.nan_to_num(table["w"].to_numpy()) > 0
        codes = (codes * len(names.dictionary) + names.indices.to_numpy()) * 2 + fits
        order = np.argsort(codes, kind="stable")
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(codes[order])) + 1])
        ends = np.append(firsts[1:], len(order))
        x = matrix(table["features"].combine_chunks())
        if edges and x.shape[1] != len(edges):
            raise ValueError("feature arrays must have one length")
        bins = binned(x, edges)[order]
        sorted_ = table.select(["key", "set_name", *numbers]).take(pa.array(order)).combine_chunks()
        offsets = pa.array(np.append(firsts, len(order)).astype(np.int32))
        heads = sorted_.take(pa.array(firsts))
        columns = [heads["key"].combine_chunks(), heads["set_name"].combine_chunks(), pa.array(fits[order][firsts]),
                   pa.array([bins[f:e].tobytes() for f, e in zip(firsts, ends)], pa.binary())]
        columns += [pa.ListArray.from_arrays(offsets, sorted_[c].combine_chunks()) for c in numbers]
        return pa.RecordBatch.from_arrays(columns, names=["key", "set_name", "fits", "bins", *numbers])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                piece = batch.slice(at, limit)
                if n + piece.num_rows > limit:
                    yield blocks(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield blocks(pa.Table.from_batches(held))

    kept = df.where("key IS NOT NULL AND set_name IS NOT NULL")
    kept = kept.select("key", "set_name", F.col("features").cast("array<double>").alias("features"), *numbers)
    return kept.mapInArrow(run, "key int, set_name string, fits boolean, bins binary, y array<double>, w array<double>, margin array<double>")


def row_bytes(n_features: int) -> int:
    """Bytes of a row that ``packed`` reads, about."""
    return 8 * (n_features + 8)


def unpacked(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, n)


def _blocks(batch: pa.RecordBatch, n_features: int):
    """(key, bins, g, h) of the blocks of a batch, or of its single rows by key."""
    keys = batch["key"].to_numpy()
    g, h = batch["g"], batch["h"]
    if pa.types.is_list(g.type):
        for i, key in enumerate(keys):
            yield (int(key), np.frombuffer(batch["bins"][i].as_buffer(), np.uint8).reshape(-1, n_features),
                   *(c[i].values.to_numpy(zero_copy_only=False) for c in (g, h)))
        return
    bins = unpacked(batch["bins"].to_pylist(), n_features)
    g, h = (c.to_numpy(zero_copy_only=False) for c in (g, h))
    for key in np.unique(keys):
        own = np.flatnonzero(keys == key)
        yield int(key), bins[own], g[own], h[own]


# ---- one tree on the driver --------------------------------------------------

@dataclass
class _Node:
    parent: int
    depth: int
    value: float
    split: tuple | None = None  # (gain, feature, bin, left sums, right sums); None: not counted
    children: tuple[int, int] | None = None


@dataclass
class Growing:
    """A tree whose splits are known as far as its nodes were counted."""

    leaves: int
    depth: int | None
    nodes: list[_Node] = field(default_factory=lambda: [_Node(-1, 0, 0.0)])

    def _splits(self, i: int) -> bool:
        split = self.nodes[i].split
        return split is not None and split[0] > MIN_GAIN

    def _best_first(self) -> tuple[list[int], bool]:
        """Nodes split in turn, and whether a gain that decides is not known yet."""
        open_, taken = [0], []
        while len(open_) < self.leaves:
            able = [i for i in open_ if self._splits(i)]
            if not able:
                return taken, False
            best = max(able, key=lambda i: (self.nodes[i].split[0], -i))
            taken.append(best)
            if len(open_) + 1 == self.leaves:
                return taken, False
            if self.nodes[best].children is None:
                return taken, True
            open_.remove(best)
            open_ += self.nodes[best].children
        return taken, False

    def opened(self) -> list[tuple[int, int, int]]:
        """Opens the best nodes known; (parent, smaller child, other) of those to count."""
        if not self._best_first()[1]:
            return []
        ready = [i for i, n in enumerate(self.nodes) if n.children is None and self._splits(i)]
        ready = sorted(ready, key=lambda i: (-self.nodes[i].split[0], i))[: self.leaves - 1]
        return [c for i in ready if (c := self._open(i))]

    def _open(self, i: int) -> tuple[int, int, int] | None:
        node, at = self.nodes[i], len(self.nodes)
        node.children = (at, at + 1)
        left, right = node.split[3:]
        for g, h, _ in (left, right):
            last = self.depth is not None and node.depth + 1 >= self.depth
            self.nodes.append(_Node(i, node.depth + 1, -g / h, (0.0,) if last else None))
        if self.nodes[at].split is not None:
            return None
        return (i, at, at + 1) if left[2] <= right[2] else (i, at + 1, at)

    def walk(self) -> tuple[np.ndarray, ...]:
        """(feature, last bin that goes left, left, right, value) of all nodes."""
        rows = [
            (*n.split[1:3], *n.children, n.value) if n.children else (-1, 0, -1, -1, n.value) for n in self.nodes
        ]
        f, b, left, right, value = zip(*rows)
        return np.array(f), np.array(b), np.array(left), np.array(right), np.array(value)

    def finished(self) -> tuple[np.ndarray, ...]:
        """The same of the tree that best first gives, nodes numbered from the root on."""
        taken = set(self._best_first()[0])
        for i in taken:
            if self.nodes[i].children is None:
                self._open(i)
        order, at = [0], 0
        while at < len(order):
            if order[at] in taken:
                order += self.nodes[order[at]].children
            at += 1
        number = {i: k for k, i in enumerate(order)}
        rows = []
        for i in order:
            n = self.nodes[i]
            rows.append((*n.split[1:3], *(number[c] for c in n.children), n.value) if i in taken else (-1, 0, -1, -1, n.value))
        return tuple(np.array(c) for c in zip(*rows))


def leaf_of(walk: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    feature, cut, left, right, _ = walk
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[at]
        if not (f >= 0).any():
            return at
        at = np.where(f >= 0, np.where(bins[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]), at)


def with_thresholds(walk: tuple[np.ndarray, ...], edges: list[np.ndarray]) -> Tree:
    feature, cut, left, right, value = walk
    threshold = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut)], float)
    return Tree(feature.astype(np.int32), threshold, left.astype(np.int32), right.astype(np.int32), value.astype(float))


# ---- passes over the rows ----------------------------------------------------

def best_split(hist: np.ndarray, min_rows: int) -> tuple:
    """(gain, feature, bin, left g, h, n, g, h, n) of a (3, features, bins) block."""
    g, h, n = hist
    gl, hl, nl = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    total = hist[:, 0].sum(axis=1)
    gr, hr, nr = total[0] - gl, total[1] - hl, total[2] - nl
    able = (nl >= max(min_rows, 1)) & (nr >= max(min_rows, 1)) & (hl > MIN_HESSIAN) & (hr > MIN_HESSIAN)
    if not able.any():
        return (0.0, -1, 0, 0.0, 0.0, 0.0, *total)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(able, gl**2 / hl + gr**2 / hr - total[0] ** 2 / total[1], -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b), gl[f, b], hl[f, b], nl[f, b], *total)


_COUNTED = "key int, parent int, node int, other int, block int, hist binary"
_SPLITS = ("key int, node int, block int, gain double, feature int, cut int, lg double, lh double, ln double, "
           "g double, h double, n double, hist binary")


def _count(rows: DataFrame, trees: dict[int, Growing], wanted: list[tuple[int, int, int, int]], n_features: int, n_bins: int) -> DataFrame:
    """A row for each task, node and block of features: packed sums."""
    walks = {k: t.walk() for k, t in trees.items()}
    targets: dict[int, list[tuple[int, int, int]]] = {}
    for key, parent, small, other in wanted:
        targets.setdefault(key, []).append((parent, small, other))
    shift = np.arange(n_features) * n_bins
    names = [c.split()[0] for c in _COUNTED.split(", ")]
    schema = pa.schema([(c, pa.binary() if c == "hist" else pa.int32()) for c in names])

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, bins, g, h in _blocks(batch, n_features):
                if key not in targets:
                    continue
                at = leaf_of(walks[key], bins)
                for parent, small, other in targets[key]:
                    inside = np.flatnonzero(at == small)
                    if not len(inside):
                        continue
                    flat = (bins[inside] + shift).ravel()
                    part = np.stack([
                        np.bincount(flat, weights=w, minlength=n_features * n_bins)
                        for w in (np.repeat(g[inside], n_features), np.repeat(h[inside], n_features), None)])
                    name = (key, parent, small, other)
                    if name in sums:
                        sums[name] += part
                    else:
                        sums[name] = part
        for name, hist in sums.items():
            hist = hist.reshape(3, n_features, n_bins)
            rows_ = [(*name, f // FEATURE_BLOCK, hist[:, f: f + FEATURE_BLOCK].tobytes()) for f in range(0, n_features, FEATURE_BLOCK)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows_, columns=names), schema=schema, preserve_index=False)

    return rows.mapInArrow(run, _COUNTED)


def _splits(counted: DataFrame, parents: DataFrame | None, n_bins: int, min_rows: int) -> DataFrame:
    """The best split of every counted node and of its sibling, by block, with their sums."""
    names = [c.split()[0] for c in _SPLITS.split(", ")]

    def rows_of(key, block, made):
        out = []
        for node, hist in made:
            gain, f, *rest = best_split(hist, min_rows)
            out.append((key, node, block, gain, f + block * FEATURE_BLOCK if f >= 0 else -1, *rest, hist.tobytes()))
        return pd.DataFrame(out, columns=names)

    def added(frame):
        return np.sum([np.frombuffer(b, float) for b in frame["hist"]], axis=0).reshape(3, -1, n_bins)

    if parents is None:
        def alone(key, frame):
            return rows_of(int(key[0]), int(key[2]), [(int(frame["node"].iloc[0]), added(frame))])

        return counted.groupBy("key", "node", "block").applyInPandas(lambda key, frame: alone((key[0], key[1], key[2]), frame), _SPLITS)

    def both(key, small, whole):
        if not len(small):
            return rows_of(0, 0, [])
        hist = added(small)
        parent = np.frombuffer(whole["hist"].iloc[0], float).reshape(hist.shape)
        made = [(int(small["node"].iloc[0]), hist), (int(small["other"].iloc[0]), parent - hist)]
        return rows_of(int(key[0]), int(key[2]), made)

    return counted.groupBy("key", "parent", "block").cogroup(parents.groupBy("key", "node", "block")).applyInPandas(
        lambda key, small, whole: both(key, small, whole), _SPLITS)


def grow(
    rows: DataFrame, keys: list[int], *, n_features: int, n_bins: int, leaves: int = 63, depth: int | None = None, min_rows: int = 20,
) -> dict[int, tuple[np.ndarray, ...]]:
    """The walk of one tree for each of ``keys`` over ``rows`` (key, bins, g, h): single rows, or
    blocks of them whose ``g`` and ``h`` are arrays.

    Every model has up to ``leaves`` leaves of at least ``min_rows`` rows.  Gains and leaf values
    are those of Newton steps without penalties; ties go to the first feature and bin.
    """
    trees = {k: Growing(leaves, depth) for k in keys}
    wanted = [(k, -1, 0, -1) for k in keys] if depth is None or depth > 0 else []
    spark = rows.sparkSession
    held: list[tuple[str, set[tuple[int, int]]]] = []  # tables of sums, and whose they are
    while wanted:
        parents = None
        if held:
            asked = {(k, p) for k, p, _, _ in wanted}
            paths = [path for path, nodes in held if nodes & asked]
            sums = spark.read.schema(_SPLITS).parquet(*paths).select("key", "node", "block", "hist")
            parents = sums.where(F.concat_ws("|", "key", "node").isin([f"{k}|{p}" for k, p in sorted(asked)]))
        path = scratch_path(spark, "sums")
        found = write_table(_splits(_count(rows, trees, wanted, n_features, n_bins), parents, n_bins, min_rows), path)
        best: dict[tuple[int, int], tuple] = {}
        for r in found.drop("hist").collect():
            name = (r["key"], r["node"])
            if name not in best or (r["gain"], -r["block"]) > (best[name]["gain"], -best[name]["block"]):
                best[name] = r
        for (key, i), r in best.items():
            left = (r["lg"], r["lh"], r["ln"])
            right = (r["g"] - r["lg"], r["h"] - r["lh"], r["n"] - r["ln"])
            node = trees[key].nodes[i]
            node.split = (r["gain"], r["feature"], r["cut"], left, right)
            if i == 0:
                node.value = -r["g"] / r["h"] if r["h"] > 0 else 0.0
        for k, _, small, other in wanted:
            for i in (small, other):
                if i >= 0 and trees[k].nodes[i].split is None:
                    trees[k].nodes[i].split = (0.0,)
        held.append((path, set(best)))
        wanted = [(k, *w) for k, t in trees.items() for w in t.opened()]
        while not wanted and any(t._best_first()[1] for t in trees.values()):
            # every open node is at the depth limit, so nothing was left to count
            wanted = [(k, *w) for k, t in trees.items() for w in t.opened()]
    for path, _ in held:
        remove(spark, path)
    return {k: t.finished() for k, t in trees.items()}
