"""Gaussian mixture clustering with order selection, anchoring and profile names.

All numbers of clusters and all starts are fitted together: one pass over the rows an iteration yields every
fit's responsibility sums (counts, first and second moments), added up in Spark; the parameters that follow from
them are a few thousand numbers whatever the row count. A fit leaves the passes when its likelihood settles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.fixed import PROFILE_WEIGHTS
from panelwise.operators.indices import INDICES, zscore
from panelwise.operators.ordered import group_quantiles
from panelwise.session import materialize

VECTOR = "_vec"
#: the reference's rule for few rows
SMALL_N, SMALL_K = 50, 4
#: rows from which a start is drawn; every pass covers all rows
START_ROWS = 512
RIDGE = 1e-6


def assemble(df: DataFrame, features: list[str], order: str = "entity") -> DataFrame:
    """Standardised vectors, written once for the many passes."""
    std = zscore(df, {c: f"z_{c}" for c in features})
    vec = VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol=VECTOR).transform(std)
    return materialize(vec.repartition(F.col(order)).sortWithinPartitions(order))


@dataclass
class Fit:
    """One mixture on its way: weights (k), means (k, d), covariances (k, d, d)."""

    k: int
    seed: int
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -np.inf
    iterations: int = 0
    converged: bool = False


def _start(sample: np.ndarray, k: int, seed: int) -> Fit:
    """Spread centres (each next one by its squared distance), a few moves to the mean, then moments of the parts."""
    rng = np.random.default_rng([seed, k])
    n, d = sample.shape
    centres = sample[[rng.integers(n)]]
    while len(centres) < k:
        away = ((sample[:, None] - centres[None]) ** 2).sum(2).min(1)
        total = away.sum()
        centres = np.vstack([centres, sample[rng.choice(n, p=away / total) if total > 0 else rng.integers(n)]])
    for _ in range(10):
        part = ((sample[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([sample[part == c].mean(0) if (part == c).any() else centres[c] for c in range(k)])
    part = ((sample[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    counts = np.bincount(part, minlength=k).astype(float)
    inner = [(sample[part == c] - centres[c]).T @ (sample[part == c] - centres[c]) for c in range(k)]
    covariances = np.array([(m + d * np.eye(d)) / (c + d) for m, c in zip(inner, counts)])
    return Fit(k, seed, (counts + 1) / (n + k), centres, covariances)


def _whitened(fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Inverse Cholesky factors and the constant of each log density."""
    low = np.linalg.cholesky(fit.covariances)
    const = np.log(fit.weights) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1) - fit.means.shape[1] / 2 * np.log(2 * np.pi)
    return np.linalg.inv(low), const


def _width(k: int, d: int) -> int:
    return 1 + k * (1 + d + d * d)


def _pass(vectors: DataFrame, features: list[str], fits: list[Fit]) -> list[np.ndarray]:
    """For each fit: log-likelihood, counts, first and second moments by cluster, over all rows."""
    d = len(features)
    ready = [(f.means, *_whitened(f)) for f in fits]
    sizes = [_width(f.k, d) for f in fits]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.zeros(w) for w in sizes]
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x = x[np.isfinite(x).all(axis=1)]
            for total, (means, white, const) in zip(out, ready):
                k = len(means)
                y = np.einsum("kij,nkj->nki", white, x[:, None] - means[None])
                log_p = const - (y * y).sum(2) / 2
                top = log_p.max(1, keepdims=True, initial=-np.inf) if len(x) else np.zeros((0, 1))
                share = np.exp(log_p - top)
                whole = share.sum(1, keepdims=True)
                share /= whole
                total[0] += (np.log(whole) + top).sum()
                total[1 : 1 + k] += share.sum(0)
                total[1 + k : 1 + k + k * d] += (share.T @ x).ravel()
                total[1 + k + k * d :] += np.einsum("nk,ni,nj->kij", share, x, x).ravel()
        flat = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["slot", "value"])

    columns = vectors.select(*[F.col(f"z_{f}").cast("double") for f in features])
    merged = columns.mapInArrow(sums, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    flat = np.zeros(sum(sizes))
    # one number a slot: at most (k, seed) pairs x k x (1 + d + d^2), whatever the row count
    for r in merged.collect():
        flat[r["slot"]] = r["value"]
    return np.split(flat, np.cumsum(sizes)[:-1])


def _step(fit: Fit, sums: np.ndarray, d: int) -> None:
    """The parameters that follow from the sums."""
    k = fit.k
    counts = sums[1 : 1 + k] + 10 * np.finfo(float).eps
    fit.weights = counts / counts.sum()
    fit.means = sums[1 + k : 1 + k + k * d].reshape(k, d) / counts[:, None]
    second = sums[1 + k + k * d :].reshape(k, d, d) / counts[:, None, None]
    fit.covariances = second - fit.means[:, :, None] * fit.means[:, None, :] + RIDGE * np.eye(d)
    low = np.linalg.eigvalsh(fit.covariances)[:, 0]
    fit.covariances += np.maximum(RIDGE - low, 0.0)[:, None, None] * np.eye(d)


def fit_all(vectors: DataFrame, features: list[str], pairs: list[tuple[int, int]], max_iter: int = 100, tol: float = 1e-3) -> list[Fit]:
    """A fit for every (k, seed). The likelihood of a fit belongs to its final parameters."""
    d, columns = len(features), [f"z_{f}" for f in features]
    fits = []
    samples: dict[int, np.ndarray] = {}
    for k, seed in pairs:
        if seed not in samples:
            # a start needs a few rows only; they follow from the values, not from where rows lie
            rows = vectors.select(*columns).na.drop().orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(START_ROWS).collect()
            samples[seed] = np.array([list(r) for r in rows], dtype=float).reshape(-1, d)
        fits.append(_start(samples[seed], k, seed))
    live = fits
    while live:
        going = []
        for fit, sums in zip(live, _pass(vectors, features, live)):
            gain = (sums[0] - fit.log_likelihood) / max(sums[1 : 1 + fit.k].sum(), 1.0)
            fit.log_likelihood = float(sums[0])
            fit.converged = bool(abs(gain) < tol)
            if not fit.converged and fit.iterations < max_iter:
                fit.iterations += 1
                _step(fit, sums, d)
                going.append(fit)
        live = going
    return fits


def criteria(n: int, d: int, k: int, log_likelihood: float) -> tuple[float, float, float]:
    """AIC, BIC and AICc for full covariances."""
    p = k * (1 + d + d * (d + 1) // 2) - 1
    aic, bic = 2 * p - 2 * log_likelihood, p * np.log(n) - 2 * log_likelihood
    aicc = aic + (2.0 * p * p + 2.0 * p) / (n - p - 1) if n - p - 1 > 0 else float("inf")
    return float(aic), float(bic), float(aicc)


@dataclass
class Mixture:
    """Parameters in anchored order: cluster 0 has the largest anchor mean."""

    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    selection: list[tuple[int, float, float, float, float, int, bool]]


def select_and_fit(
    vectors: DataFrame, features: list[str], k_range: tuple[int, int] = (2, 8), seeds: tuple[int, ...] = (1, 2, 3), anchor: str | None = None, max_iter: int = 100
) -> Mixture:
    """The order with the least AICc, of each order the start with the best likelihood."""
    n, d = vectors.count(), len(features)
    low, high = k_range
    if n < SMALL_N:
        high = min(SMALL_K, high)
        low = min(low, high)
    fits = fit_all(vectors, features, [(k, seed) for k in range(low, high + 1) for seed in seeds], max_iter)
    tried, best = [], None
    for k in range(low, high + 1):
        fit = max((f for f in fits if f.k == k), key=lambda f: f.log_likelihood)
        aic, bic, aicc = criteria(n, d, k, fit.log_likelihood)
        tried.append((k, bic, aic, aicc, fit.log_likelihood, fit.iterations, fit.converged))
        if best is None or aicc < best[0]:
            best = (aicc, fit)
    fit = best[1]
    at = features.index(anchor) if anchor in features else 0
    order = np.argsort(-fit.means[:, at], kind="stable")
    return Mixture(features, fit.weights[order], fit.means[order], fit.covariances[order], tried)


def selection_table(mix: Mixture, spark) -> DataFrame:
    return spark.createDataFrame(mix.selection, "k int, bic double, aic double, aicc double, log_likelihood double, iterations int, converged boolean")


def name_profiles(means: np.ndarray, features: list[str]) -> list[str]:
    """One name for each cluster, in cluster order: the best score among the names still free."""
    x = means[:, [features.index(f) for f in INDICES]]
    terms = np.hstack([np.ones((len(x), 1)), x, np.abs(x[:, :2] - 0.5)])
    scores = terms @ np.array(list(PROFILE_WEIGHTS.values())).T
    free, names, labels = np.ones(scores.shape[1], bool), [], list(PROFILE_WEIGHTS)
    for k, row in enumerate(scores):
        best = int(np.where(free, row, -np.inf).argmax())
        names.append(labels[best] if free[best] else f"Cluster {k}")
        free[best] = False
    return names


def mahalanobis(cluster: Column, features: list[str], means: np.ndarray, covariances: np.ndarray, ridge: float = 1e-6) -> Column:
    """Distance to the row's own centroid, as plain arithmetic on literals."""
    out = F.lit(None).cast("double")
    for k in reversed(range(len(means))):
        inv = np.linalg.inv(covariances[k] + np.eye(len(features)) * ridge)
        diff = [F.col(c) - F.lit(float(means[k][i])) for i, c in enumerate(features)]
        total = F.lit(0.0)
        for i in range(len(features)):
            for j in range(len(features)):
                total = total + diff[i] * F.lit(float(inv[i, j])) * diff[j]
        out = F.when(cluster == k, F.sqrt(F.greatest(F.lit(0.0), total))).otherwise(out)
    return out


def log_densities(mix: Mixture) -> Column:
    """Weighted log density of every cluster, as plain arithmetic on literals."""
    white, const = _whitened(Fit(len(mix.weights), 0, mix.weights, mix.means, mix.covariances))
    out = []
    for k, mean in enumerate(mix.means):
        diff = [F.col(f"z_{f}") - F.lit(float(m)) for f, m in zip(mix.features, mean)]
        total = F.lit(float(const[k]))
        for i in range(len(diff)):
            y = F.lit(0.0)
            for j in range(i + 1):
                y = y + diff[j] * F.lit(float(white[k, i, j]))
            total = total - y * y / 2
        out.append(total)
    return F.array(*out)


def assign(vectors: DataFrame, mix: Mixture) -> DataFrame:
    """Anchored label, membership probabilities, distance and name per row."""
    scored = vectors.withColumn("_l", log_densities(mix)).withColumn("_m", F.array_max("_l"))
    scored = scored.withColumn("_e", F.transform("_l", lambda v: F.exp(v - F.col("_m"))))
    total = F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v)
    out = scored.withColumns({"cluster": (F.array_position("_l", F.col("_m")) - 1).cast("int"), "probabilities": F.transform("_e", lambda v: v / total)})
    names = F.array(*[F.lit(n) for n in _names(mix)])
    return out.withColumns(
        {
            "cluster_name": names[F.col("cluster")],
            "mahalanobis": mahalanobis(F.col("cluster"), [f"z_{f}" for f in mix.features], mix.means, mix.covariances),
        }
    ).drop("_l", "_m", "_e")


def _names(mix: Mixture) -> list[str]:
    if set(INDICES) <= set(mix.features):
        return name_profiles(mix.means, mix.features)
    return [f"Cluster {k}" for k in range(len(mix.means))]


def project_2d(vectors: DataFrame) -> DataFrame:
    """First two principal components of the standardised vectors."""
    model = PCA(k=2, inputCol=VECTOR, outputCol="_pc").fit(vectors)
    out = model.transform(vectors).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({"x_1": F.col("_pc")[0], "x_2": F.col("_pc")[1]}).drop("_pc")


def summary(assigned: DataFrame) -> DataFrame:
    """Size and median distance per cluster."""
    median = group_quantiles(assigned, "mahalanobis", "cluster", [0.5]).select("cluster", F.col("quantiles")[0].alias("median_distance"))
    sizes = assigned.groupBy("cluster", "cluster_name").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(median, "cluster", "left")


def centroids(assigned: DataFrame, mix: Mixture, original: DataFrame) -> DataFrame:
    """Centroids in original units with names and sizes."""
    stats = original.agg(*[e for c in mix.features for e in (F.avg(c), F.stddev_pop(c))]).first()
    rows = []
    for k, name in enumerate(_names(mix)):
        values = [float(mix.means[k][i]) * (stats[2 * i + 1] or 1.0) + stats[2 * i] for i in range(len(mix.features))]
        rows.append((k, name, *values))
    spark = assigned.sparkSession
    table = spark.createDataFrame(rows, "cluster int, cluster_name string, " + ", ".join(f"{f} double" for f in mix.features))
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return table.join(sizes, "cluster", "left").fillna({"size": 0})


def run(df: DataFrame, features: list[str] | None = None, k_range: tuple[int, int] = (2, 8), seeds: tuple[int, ...] = (1, 2, 3)) -> dict[str, DataFrame]:
    """All clustering outputs for a profile."""
    features = list(features or INDICES)
    vectors = assemble(df, features)
    mix = select_and_fit(vectors, features, k_range, seeds)
    assigned = materialize(project_2d(assign(vectors, mix)).drop(VECTOR, *[f"z_{f}" for f in features]))
    return {
        "clustered": assigned,
        "selection": selection_table(mix, df.sparkSession),
        "centroids": centroids(assigned, mix, df),
        "summary": summary(assigned),
    }
