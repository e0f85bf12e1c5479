"""Boosted trees with a custom objective, scoring, and model studies.

Each boosting round grows one tree best leaf first (``trees.py``) on the gradients and
hessians of the objective; local models of several clusters grow in the same passes.
Rows stay distributed.  Trees are small node arrays, which score rows batch-wise and can
be stored as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindscape.functions.hashing import stable_hash
from bindscape.functions.prefix import hash_index
from bindscape.functions.scalars import sigmoid
from bindscape.functions.session import batches_of, settle, spread
from bindscape.operators import labels as lb, metrics as mt, trees as tr
from bindscape.operators.signal import C, join_features
from bindscape.operators.trees import Tree

Objective = Callable[[Column, Column], tuple[Column, Column]]


# ---- objectives: (margin, y) -> (gradient, hessian) ------------------------

def focal_isoform(alpha: float = 0.5, beta: float = 0.0, gamma: float = 1.0) -> Objective:
    """Shifted, sharpened logistic loss; ``alpha`` weighs positives, 1 - alpha
    negatives do not: both classes use ``1 - y + (2y - 1) alpha``."""
    def grad_hess(f: Column, y: Column) -> tuple[Column, Column]:
        side = 2.0 * y - 1.0
        p = sigmoid(beta + side * gamma * f)
        w = 1.0 - y + side * alpha
        return w * side * (p - 1.0), w * gamma * (1.0 - p) * p

    return grad_hess


def focal_positive(alpha: float = 1.0, beta: float = 0.0, gamma: float = 2.0) -> Objective:
    """The variant that only re-weighs positives."""
    def grad_hess(f: Column, y: Column) -> tuple[Column, Column]:
        side = 2.0 * y - 1.0
        p = sigmoid(beta + side * gamma * f)
        w = 1.0 + (alpha - 1.0) * y
        return w * side * (p - 1.0), w * gamma * (1.0 - p) * p

    return grad_hess


def imbalance_logistic(alpha: float = 5.0) -> Objective:
    def grad_hess(f: Column, y: Column) -> tuple[Column, Column]:
        p = sigmoid(f)
        return (alpha - 1.0) * p * y + p - alpha * y, ((alpha - 1.0) * y + 1.0) * p * (1.0 - p)

    return grad_hess


# ---- models -----------------------------------------------------------------

@dataclass
class Booster:
    learning_rate: float
    trees: list[Tree] = field(default_factory=list)
    best_round: int = 0
    history: list[tuple[int, str, float]] = field(default_factory=list)

    def used(self) -> list[Tree]:
        return self.trees[: self.best_round] if self.best_round else self.trees

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.used():
            out += self.learning_rate * t.value[t.leaves(x)]
        return out

    def leaf_values(self, x: np.ndarray) -> np.ndarray:
        return np.stack([t.value[t.leaves(x)] for t in self.used()], axis=1) * self.learning_rate

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), float(t.value[n]))
            for i, t in enumerate(self.used()) for n in range(len(t.value))
        ]
        return spark.createDataFrame(
            rows, "tree int, node int, feature int, threshold double, left int, right int, value double"
        )

    @staticmethod
    def from_table(table: DataFrame, learning_rate: float) -> Booster:
        pdf = table.orderBy("tree", "node").toPandas()
        trees = [
            Tree(*[g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value")])
            for _, g in pdf.groupby("tree")
        ]
        return Booster(learning_rate, trees, len(trees))


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))


def score(model: Booster, df: DataFrame, *, features: str = "features", name: str = "margin") -> DataFrame:
    """Add the raw margin of every row."""
    @F.arrow_udf("double")
    def margins(x: pa.Array) -> pa.Array:
        return pa.array(model.margins(tr.matrix(x)))

    return df.withColumn(name, margins(F.col(features)))


def leaf_outputs(model: Booster, df: DataFrame, *, features: str = "features", name: str = "leaves") -> DataFrame:
    """Add the array of leaf values, one per tree."""
    @F.arrow_udf("array<double>")
    def values(x: pa.Array) -> pa.Array:
        return tr.lists(model.leaf_values(tr.matrix(x)))

    return df.withColumn(name, values(F.col(features)))


def ensemble_score(models: Mapping[str, Booster], df: DataFrame, keys: Sequence[str], *, features: str = "features") -> DataFrame:
    """``keys, model_id, margin`` for every model, features read once."""
    names = list(models)

    @F.arrow_udf("array<double>")
    def margins(x: pa.Array) -> pa.Array:
        m = tr.matrix(x)
        return tr.lists(np.stack([models[n].margins(m) for n in names], axis=1))

    pairs = df.select(*keys, F.posexplode(margins(F.col(features))).alias("i", "margin"))
    return pairs.select(*keys, F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("model_id"), "margin")


# ---- training --------------------------------------------------------------

def training_set(
    signal: DataFrame, motifs: DataFrame, labels_a: DataFrame, labels_b: DataFrame, *,
    chroms: Sequence[str], scale_chrom: str | None = None,
) -> DataFrame:
    """Training rows on ``chroms``: bins on which both label tables agree,
    accessibility and (scaled) motif features side by side, ``y`` and ``weight``."""
    keep = F.col("chrom").isin(*chroms)
    agreed = lb.agreeing(labels_a.where(keep), labels_b.where(keep), C)
    scaled = motifs
    if scale_chrom is not None:
        top = motifs.where(F.col("chrom") == scale_chrom).agg(F.max(F.array_max("features"))).scalar()
        scaled = motifs.withColumn("__top", top).withColumn(
            "features", F.transform("features", lambda v: v / F.col("__top"))
        ).drop("__top")
    both = join_features(signal.where(keep), scaled.where(keep))
    return lb.weighted_target(agreed.select(*C, "label").join(both, list(C)))


def prior_shift(df: DataFrame, *, y: str = "y") -> float:
    """-log10(2 n / n_pos - 1), the margin shift of the focal objective."""
    row = mt.positive_prior(df, y=y).first()
    return float(row["beta"]) if row["beta"] is not None else 0.0


def average_precision_metric(df: DataFrame) -> dict[str, float]:
    """Average precision of each validation set (``set_name, margin, y``)."""
    rows = mt.average_precision(df, score="margin", by=["set_name"]).collect()
    return {r["set_name"]: float(r["auprc"]) for r in rows}


def _prior_shifts(rows: DataFrame) -> dict[int, float]:
    """``prior_shift`` of the rows of every ``key``."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
    return {r["key"]: float(-np.log10(2 * r["n"] / r["pos"] - 1)) if r["pos"] else 0.0 for r in counts}


def _by_key(values: Mapping[int, float]) -> Column:
    """The value of a row's ``key``; keys are few."""
    pairs = [F.lit(x) for k, v in sorted(values.items()) for x in (int(k), float(v))]
    return F.element_at(F.create_map(*pairs), F.col("key"))


def _weighted(objective: Objective, part: int) -> Column:
    """Weighted gradient (part 0) or hessian (part 1) of every row of a block."""
    def of_row(margin: Column, i: Column) -> Column:
        value = objective(margin, F.get("y", i))[part]
        return F.get("w", i) * (F.greatest(value, F.lit(1e-16)) if part else value)

    return F.transform("margin", of_row)


def train_boosted_by(
    df: DataFrame,
    key: str,
    *,
    features: str = "features",
    y: str = "y",
    weight: str | None = "weight",
    set_name: str = "set_name",
    init_margin: str | None = None,
    objective: Objective | None = None,
    rounds: int = 200,
    learning_rate: float = 0.05,
    leaves: int = 63,
    depth: int | None = None,
    max_bins: int = 255,
    min_rows: int = 20,
    patience: int | None = 50,
    metric: Callable[[DataFrame], dict[str, float]] = average_precision_metric,
    on_round: Callable[[int, dict[str, float]], None] | None = None,
    settle_every: int = 10,
    metric_every: int = 1,
    edges: list[np.ndarray] | None = None,
) -> dict[int, Booster]:
    """One model for the rows of each value of the integer column ``key``; the models grow in the
    same passes, so jobs do not depend on their number.

    As ``train_boosted``; every model has its own prior shift, best round and
    stop.  Set names that a metric sees are ``key|set`` where keys are several.  Bins are
    quantiles of all training rows unless ``edges`` are given.
    """
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins must be 2 to 255")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    start = F.col(init_margin).cast("double") if init_margin else F.lit(0.0)
    data = df.select(
        F.col(key).cast("int").alias("key"), F.col(features).alias("features"),
        F.col(y).cast("double").alias("y"), w.alias("w"), F.col(set_name).alias("set_name"), start.alias("margin"),
    )
    if edges is None:
        edges = tr.bin_edges(data.where("set_name = 'train'"), "features", max_bins)
    n_features, n_bins = len(edges), max((len(e) for e in edges), default=0) + 1
    with batches_of(df.sparkSession, tr.row_bytes(n_features)):
        rows = settle(spread(tr.packed(data, edges)))
    train, valid = rows.where("set_name = 'train'"), "set_name <> 'train'"
    shifts = _prior_shifts(train.select("key", F.explode("y").alias("y")))
    if not shifts:
        raise ValueError("no rows to train on")
    sets = [(r["key"], r["set_name"]) for r in rows.where(valid).select("key", "set_name").distinct().collect()]
    keys = sorted(shifts)
    if objective is None:
        objective = focal_isoform(beta=_by_key(shifts) if len(keys) > 1 else shifts[keys[0]])
    boosters = {k: Booster(learning_rate) for k in keys}
    best, active = dict.fromkeys(keys, -np.inf), list(keys)
    held: DataFrame | None = None
    for r in range(1, rounds + 1):
        fit = rows.where("set_name = 'train' AND fits").where(F.col("key").isin(active))
        fit = fit.select("key", "bins", _weighted(objective, 0).alias("g"), _weighted(objective, 1).alias("h")).persist(StorageLevel.MEMORY_AND_DISK)
        walks = tr.grow(fit, active, n_features=n_features, n_bins=n_bins, leaves=leaves, depth=depth, min_rows=min_rows)
        fit.unpersist()
        for k in active:
            boosters[k].trees.append(tr.with_thresholds(walks[k], edges))
        moved = rows.withColumn("margin", _moved(walks, n_features, learning_rate))
        if r % settle_every == 0:
            rows, old, held = settle(moved), held, None
        else:
            rows, old = moved.persist(StorageLevel.MEMORY_AND_DISK), held
            held = rows
        if sets and (r % metric_every == 0 or r == rounds):
            named = F.concat_ws("|", "key", "set_name") if len(keys) > 1 else F.col("set_name")
            judged = rows.where(valid).where(F.col("key").isin(active))
            judged = judged.select(named.alias("set_name"), F.explode(F.arrays_zip("margin", "y")).alias("row"))
            values = metric(judged.select("set_name", "row.margin", "row.y"))
            if on_round:
                on_round(r, values)
            for k in active:
                own = values if len(keys) == 1 else {n.split("|", 1)[1]: x for n, x in values.items() if n.split("|", 1)[0] == str(k)}
                if not own:
                    continue
                boosters[k].history += [(r, s, x) for s, x in sorted(own.items())]
                mean = float(np.mean(list(own.values())))
                if mean > best[k]:
                    best[k], boosters[k].best_round = mean, r
        if old is not None:
            old.unpersist()
        judged_keys = {k for k, _ in sets} if len(keys) > 1 else set(keys if sets else [])
        if patience is not None:
            active = [k for k in active if k not in judged_keys or r - boosters[k].best_round < patience]
        if not active:
            break
    if held is not None:
        held.unpersist()
    for b in boosters.values():
        b.best_round = b.best_round or len(b.trees)
    return boosters


def _moved(walks: Mapping[int, tuple], n_features: int, learning_rate: float) -> Column:
    """The margins of a block's rows after the newest trees."""
    @F.arrow_udf("array<double>")
    def values(key: pa.Array, bins: pa.Array, margin: pa.Array) -> pa.Array:
        out = []
        for one, b, m in zip(key.to_numpy(), bins, margin):
            m = m.values.to_numpy(zero_copy_only=False)
            if one in walks:
                at = tr.leaf_of(walks[one], np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, n_features))
                m = m + learning_rate * walks[one][4][at]
            out.append(m)
        return pa.array(out, pa.list_(pa.float64()))

    return values("key", "bins", "margin")


def train_boosted(df: DataFrame, **options) -> Booster:
    """Boost trees on the rows with ``set_name`` = 'train'.

    Other set names are validation sets: after every ``metric_every`` rounds, and
    the last, their mean metric decides the best round, and training stops ``patience`` rounds after it.
    Each tree takes the best split of any leaf until it has ``leaves`` of them; ``depth`` bounds its depth
    where given.  Rows of weight 0 are kept for counting and metrics but do not fit trees.
    Margins are written to the shared folder every few rounds so that lineage stays short.
    The options are those of ``train_boosted_by``.
    """
    return next(iter(train_boosted_by(df.withColumn("__model", F.lit(0)), "__model", **options).values()))


# ---- model studies ---------------------------------------------------------

def permute_columns(df: DataFrame, n_features: int, *, key: Sequence[str], seed: int = 1, features: str = "features") -> DataFrame:
    """Add ``permuted``: every feature independently shuffled over the rows.

    Rows get an index in hash order; feature j of the row at index i goes to
    index i + shift_j (mod n), so one shuffle moves all columns.
    """
    indexed = settle(hash_index(df, (), key, seed))
    n = indexed.count()
    long = indexed.select("idx", F.posexplode(features).alias("j", "v"))
    shift = 1 + F.pmod(stable_hash(seed, "j"), F.lit(max(n - 1, 1)))
    moved = long.select(F.pmod(F.col("idx") + shift, F.lit(n)).alias("idx"), "j", "v")
    donors = moved.groupBy("idx").agg(
        F.array(*[F.max(F.when(F.col("j") == i, F.col("v"))) for i in range(n_features)]).alias("permuted")
    )
    return indexed.join(donors, "idx").drop("idx")


def importance_blocks(n_features: int, *, half: int | None = None, block: int | None = None, first: int = 0) -> dict[str, list[int]]:
    """Column sets to shuffle: single columns, strand pairs (j, j + half),
    blocks of ``block`` after column ``first``, and the two families."""
    sets: dict[str, list[int]] = {"none": []}
    sets.update({f"column_{j}": [j] for j in range(first or n_features)})
    if half:
        sets.update({f"pair_{j}": [j, j + half] for j in range(half)})
    if block:
        sets.update({
            f"block_{b}": list(range(b, min(b + block, n_features))) for b in range(first, n_features, block)
        })
    if first:
        sets["family_signal"] = list(range(first))
        sets["family_motif"] = list(range(first, n_features))
    return sets


def permutation_importance(
    model: Booster, df: DataFrame, sets: Mapping[str, Sequence[int]], n_features: int, *, key: Sequence[str],
    y: str = "y", features: str = "features", seed: int = 1,
) -> DataFrame:
    """Average precision after shuffling each column set (all in one pass)."""
    names = list(sets)
    columns = [list(sets[n]) for n in names]

    @F.pandas_udf("array<double>")
    def variants(x: pd.Series, p: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        a, b = _matrix(x), _matrix(p)
        out = np.empty((len(a), len(columns)))
        for i, cols in enumerate(columns):
            mixed = a.copy()
            mixed[:, cols] = b[:, cols]
            out[:, i] = model.margins(mixed)
        return pd.Series(list(out))

    both = permute_columns(df, n_features, key=key, seed=seed, features=features)
    scored = both.select(y, F.posexplode(variants(F.col(features), F.col("permuted"))).alias("i", "score"))
    named = scored.select(y, "score", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("shuffled"))
    return mt.average_precision(named, y=y, by=["shuffled"])


def clustered_models(
    train: DataFrame, test: DataFrame, k: int, *, features: str = "features", empty_margin: float = -10.0, seed: int = 0, **options
) -> DataFrame:
    """k-means over train and test rows, one model per cluster, test rows scored
    by their cluster's model; clusters without positives give ``empty_margin``."""
    with_x = lambda d: d.withColumn("x", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    every = with_x(train.select(features)).select("x").unionByName(with_x(test.select(features)).select("x"))
    groups = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(every)
    train_c = settle(groups.transform(with_x(train)).drop("x"))
    test_c = settle(groups.transform(with_x(test)).drop("x"))
    positives = [r["cluster"] for r in train_c.where("y = 1 AND set_name = 'train'").select("cluster").distinct().collect()]
    if not positives:
        return test_c.withColumn("margin", F.lit(float(empty_margin)))
    models = train_boosted_by(train_c.where(F.col("cluster").isin(positives)), "cluster", features=features, **options)

    @F.arrow_udf("double")
    def margins(cluster: pa.Array, x: pa.Array) -> pa.Array:
        out, c, m = np.full(len(x), float(empty_margin)), cluster.to_numpy(), tr.matrix(x)
        for k in np.unique(c):
            if k in models:
                own = np.flatnonzero(c == k)
                out[own] = models[k].margins(m[own])
        return pa.array(out)

    return test_c.withColumn("margin", margins("cluster", F.col(features)))


def stack_replicates(tensor: DataFrame, labels: DataFrame) -> DataFrame:
    """One training row per replicate and bin, instead of their mean."""
    return lb.weighted_target(tensor.join(labels, list(C)))


def cross_validate(df: DataFrame, folds: int, *, fold: str = "fold", **options) -> DataFrame:
    """Mean average precision over folds, per round."""
    spark = df.sparkSession
    rows: list[tuple[int, str, float]] = []
    for f in range(folds):
        named = df.withColumn("set_name", F.when(F.col(fold) == f, F.lit(f"fold_{f}")).otherwise(F.lit("train")))
        rows += train_boosted(named, patience=None, **options).history
    history = spark.createDataFrame(rows, "round int, set_name string, auprc double")
    return mt.metric_mean(history)


def trial_parameters(space: Mapping[str, Sequence], n: int, *, seed: int) -> list[dict]:
    """``n`` seeded draws from a grid of choices."""
    rng = np.random.default_rng(seed)
    return [{name: choices[int(rng.integers(len(choices)))] for name, choices in space.items()} for _ in range(n)]


def run_trials(df: DataFrame, trials: Sequence[dict], **options) -> DataFrame:
    """Train once per parameter set; loss = 1 - best mean average precision."""
    rows = []
    for i, params in enumerate(trials):
        model = train_boosted(df, **{**options, **params})
        by_round: dict[int, list[float]] = {}
        for r, _, value in model.history:
            by_round.setdefault(r, []).append(value)
        best = max(float(np.mean(v)) for v in by_round.values())
        rows.append((1.0 - best, i, model.best_round, str(sorted(params.items()))))
    return df.sparkSession.createDataFrame(rows, "loss double, trial int, best_round int, params string")
