"""k-means with any metric, nearest centres and distances.

Centres are a model of k rows and travel with the tasks; rows never leave
their partitions except as per-cluster sums.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from bindscape.functions.prefix import exact_quantiles, hash_index
from bindscape.functions.session import settle
from bindscape.operators.normalize import pearson


def _euclidean(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
    return np.sqrt(np.maximum(sq, 0))


def _correlation(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    def unit(m):
        m = m - m.mean(1, keepdims=True)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    return 1 - unit(x) @ unit(c).T


def lq_metric(q: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """mean(|x - c|^q)."""
    def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.stack([(np.abs(x - row) ** q).mean(1) for row in c], axis=1)

    return distance


# metric name -> distances of every row to every centre
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": _euclidean,
    "cityblock": lambda x, c: np.stack([np.abs(x - r).sum(1) for r in c], axis=1),
    "chebyshev": lambda x, c: np.stack([np.abs(x - r).max(1) for r in c], axis=1),
    "correlation": _correlation,
    "lq": lq_metric(0.5),
}


def _metric(metric) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return METRICS[metric] if isinstance(metric, str) else metric


def distances(df: DataFrame, centres: np.ndarray, *, metric="euclidean", features: str = "features", name: str = "distances") -> DataFrame:
    """Add the array of distances to each centre."""
    fn = _metric(metric)

    @F.pandas_udf("array<double>")
    def measure(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(fn(np.stack(x.to_numpy()).astype(float), centres)))

    return df.withColumn(name, measure(F.col(features)))


def nearest_centre(df: DataFrame, centres: np.ndarray, *, metric="euclidean", features: str = "features") -> DataFrame:
    """Add ``cluster`` (first on ties) and its ``distance``."""
    out = distances(df, centres, metric=metric, features=features, name="__d")
    best = F.array_min("__d")
    return out.withColumn("cluster", (F.array_position("__d", best) - 1).cast("int")).withColumn("distance", best).drop("__d")


def pick_rows(df: DataFrame, k: int, *, key: Sequence[str], seed: int = 0, features: str = "features") -> np.ndarray:
    """k rows in hash order as initial centres."""
    rows = hash_index(df.select(*key, features), (), key, seed).where(F.col("idx") < k).orderBy("idx").collect()
    return np.array([r[features] for r in rows], dtype=float)


def kmeans(
    df: DataFrame, centres: np.ndarray, *, metric="euclidean", delta: float = 1e-3, max_iter: int = 100, features: str = "features"
) -> tuple[np.ndarray, DataFrame]:
    """Lloyd iterations: assign rows to their nearest centre, move the centres to
    the means.

    Converged when, from the second pass on, the mean distance differs from that
    of the pass before by at most the share ``delta``; the returned rows
    (``cluster``, ``distance``) belong to the returned centres.  Without
    convergence in ``max_iter`` passes a warning is given.  Each pass shuffles one
    partial sum per cluster and task.
    """
    centres = np.array(centres, dtype=float)
    dim = centres.shape[1]
    means: list[float] = []
    while True:
        assigned = nearest_centre(df, centres, metric=metric, features=features)
        stats = assigned.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d"),
            F.array(*[F.avg(F.get(features, F.lit(i))) for i in range(dim)]).alias("mean"),
        ).collect()
        means.append(sum(r["d"] for r in stats) / max(sum(r["n"] for r in stats), 1))
        converged = len(means) > 1 and abs(means[-1] - means[-2]) <= delta * means[-2]
        if converged or not stats:
            return centres, assigned
        if len(means) >= max_iter:
            warnings.warn(f"k-means has not converged in {max_iter} passes", stacklevel=2)
            return centres, assigned
        for r in stats:
            centres[r["cluster"]] = r["mean"]


def kmeans_two_pass(df: DataFrame, k: int, *, key: Sequence[str], n_sample: int = 0, seed: int = 0, **kw) -> tuple[np.ndarray, DataFrame]:
    """k-means of a hash sample of max(2 sqrt(n), 10 k) rows gives the starting
    centres of the full run."""
    features = kw.get("features", "features")
    n = df.count()
    size = n_sample or int(max(2 * n**0.5, 10 * k))
    sample = settle(hash_index(df, (), key, seed).where(F.col("idx") < size).drop("idx"))
    first, _ = kmeans(sample, pick_rows(sample, k, key=key, seed=seed + 1, features=features), **kw)
    return kmeans(df, first, **kw)


def radius_percentiles(assigned: DataFrame, probabilities: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Distance percentiles of each cluster."""
    q = exact_quantiles(assigned, ["cluster"], "distance", list(probabilities))
    return q.select("cluster", "q_idx", F.col("quantile").alias("radius"))


def reduce_profiles(df: DataFrame, n_profiles: int, k: int, *, by: str = "segment", panel: str = "panel", max_iter: int = 10) -> DataFrame:
    """Per segment, k-means (correlation distance) of the panel's profiles and
    the mean profile of each cluster at every bin (array of k).

    A profile that no longer shares its segment's shape moves to the centre it
    correlates with best; empty clusters keep their last centre.
    """
    start = df.withColumn("centres", F.slice(panel, 1, k))
    state = settle(start)
    for _ in range(max_iter):
        r = F.array(*[
            F.array(*[
                F.coalesce(F.round(pearson(F.get(panel, F.lit(j)), F.get("centres", F.lit(c))), 9), F.lit(-2.0))
                for c in range(k)
            ])
            for j in range(n_profiles)
        ])
        picked = state.groupBy(by).agg(r.alias("r")).select(
            by, F.transform("r", lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int")).alias("assign")
        )
        joined = state.drop("assign").join(picked, by)

        def mean_of(c: int):
            member = F.zip_with(panel, "assign", lambda v, a: F.when(a == c, v.cast("double")))
            kept = F.filter(member, lambda v: v.isNotNull())
            total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
            return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.get("centres", F.lit(c)))

        moved = settle(joined.withColumn("centres", F.array(*[mean_of(c) for c in range(k)])))
        if "assign" in state.columns:
            old = state.groupBy(by).agg(F.first("assign").alias("old"))
            new = moved.groupBy(by).agg(F.first("assign").alias("new"))
            if old.join(new, by).where("old <> new").limit(1).count() == 0:
                return moved
        state = moved
    warnings.warn(f"the profiles have not settled in {max_iter} passes", stacklevel=2)
    return state
