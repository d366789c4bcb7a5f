"""A boosted-tree stand-in for the priority score and additive attributions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.columns import TINY
from panelwise.operators.ordered import with_row
from panelwise.session import materialize, scratch_path

FEATURES = [
    "a_total", "b_total", "c_total", "activity", "log_activity", "avg_update_ratio", "avg_b_ratio", "avg_c_ratio",
    "a1_share", "a2_share", "b2_share", "c2_share", "active_periods",
]


def fit_surrogate(df: DataFrame, target: str = "priority", features: list[str] | None = None, trees: int = 100, depth: int = 4, rate: float = 0.1, subsample: float = 0.8, seed: int = 42):
    """``(model, features, vectors)`` or None when fewer than three features exist."""
    used = [c for c in (features or FEATURES) if c in df.columns]
    if len(used) < 3 or target not in df.columns:
        return None
    x = df.select("entity", F.col(target).cast("double").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in used])
    x = VectorAssembler(inputCols=used, outputCol="features").transform(x)
    x = materialize(x.repartition("entity").sortWithinPartitions("entity"))
    model = GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed).fit(x)
    return model, used, x


def tree_leaves(model: GBTRegressionModel, spark) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves as (value, [(feature, low, high, cover share), ...]).

    Read back from the saved model; at most trees x 2^depth leaves. Repeated splits
    on a feature merge into one interval.
    """
    path = scratch_path(spark, "surrogate")
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    leaves = []
    weights = model.treeWeights
    by_tree: dict[int, dict] = {}
    for r in nodes:
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    for tree, table in by_tree.items():
        stack = [(0, {})]
        while stack:
            at, path_so_far = stack.pop()
            n = table[at]
            if n["leftChild"] < 0:
                leaves.append((weights[tree] * n["prediction"], [(f, *v) for f, v in path_so_far.items()]))
                continue
            f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            lo, hi, z = path_so_far.get(f, (-np.inf, np.inf, 1.0))
            for child, interval in ((n["leftChild"], (lo, min(hi, cut))), (n["rightChild"], (max(lo, cut), hi))):
                share = table[child]["rawCount"] / n["rawCount"]
                stack.append((child, path_so_far | {f: (*interval, z * share)}))
    return leaves


def base_value(leaves) -> float:
    return float(sum(v * np.prod([z for *_, z in path]) for v, path in leaves))


def shapley(x: np.ndarray, leaves) -> np.ndarray:
    """Path-dependent tree Shapley values (Lundberg et al.), all rows at once.

    A leaf of depth d touches at most d features, so the subset sum is short.
    """
    phi = np.zeros_like(x, dtype=float)
    for value, path in leaves:
        k = len(path)
        if not k:
            continue
        one = [(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi, _ in path]
        zero = [z for *_, z in path]
        for i in range(k):
            rest = [j for j in range(k) if j != i]
            total = np.zeros(len(x))
            for size in range(k):
                w = factorial(size) * factorial(k - size - 1) / factorial(k)
                for inside in combinations(rest, size):
                    term = np.full(len(x), w)
                    for j in rest:
                        term = term * (one[j] if j in inside else zero[j])
                    total += term
            phi[:, path[i][0]] += value * total * (one[i].astype(float) - zero[i])
    return phi


def attribute(fitted, spark) -> DataFrame:
    """``entity, contributions (array), base, prediction`` per row."""
    model, used, x = fitted
    leaves = tree_leaves(model, spark)
    shared = spark.sparkContext.broadcast(leaves)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def phi(v: pd.DataFrame) -> pd.Series:
        return pd.Series(list(shapley(v.to_numpy(dtype=float), shared.value)))

    scored = model.transform(x)
    return scored.select(
        "entity", phi(F.struct(*used)).alias("contributions"), F.lit(base_value(leaves)).alias("base"), "prediction"
    )


def attribute_by_importance(df: DataFrame, importances: dict[str, float]) -> DataFrame:
    """Fallback: importance times the standardised value, 0 for constant columns."""
    names = list(importances)
    x = df.select("entity", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    stats = x.agg(*[F.avg(c).alias(f"_m_{c}") for c in names], *[F.stddev_pop(c).alias(f"_s_{c}") for c in names])
    cells = [
        F.when(F.col(f"_s_{c}") > 0, F.lit(float(importances[c])) * F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))).otherwise(F.lit(0.0))
        for c in names
    ]
    return with_row(x, stats).select("entity", F.array(*cells).alias("contributions"))


def _long(attributed: DataFrame, names: list[str]) -> DataFrame:
    rows = F.posexplode(F.col("contributions")).alias("_i", "contribution")
    return attributed.select("entity", rows).select("entity", F.array(*[F.lit(n) for n in names])[F.col("_i")].alias("feature"), "contribution")


def top_features(attributed: DataFrame, names: list[str], k: int = 3) -> DataFrame:
    """The k largest absolute contributions per row, as columns."""
    pairs = F.transform(
        "contributions", lambda v, i: F.struct((-F.abs(v)).alias("key"), i.alias("i"), F.array(*[F.lit(n) for n in names])[i].alias("feature"), v.alias("value"))
    )
    best = F.slice(F.sort_array(pairs), 1, k)
    out = attributed.withColumn("_b", best)
    cols = [c for j in range(k) for c in (F.col("_b")[j]["feature"].alias(f"top_{j + 1}_feature"), F.col("_b")[j]["value"].alias(f"top_{j + 1}_value"))]
    total = F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v)
    return out.select("entity", total.alias("contribution_sum"), *cols)


def global_importance(attributed: DataFrame, names: list[str]) -> DataFrame:
    """Mean absolute contribution and its percent of the total, largest first."""
    per = _long(attributed, names).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    total = per.agg(F.sum("mean_abs").alias("_t"))
    out = with_row(per, total).withColumn("importance_pct", 100.0 * F.col("mean_abs") / (F.col("_t") + F.lit(TINY))).drop("_t")
    return out.orderBy(F.desc("mean_abs"), "feature")


def run(df: DataFrame, trees: int = 100) -> dict[str, DataFrame]:
    """Summary and importance tables; typed and empty when no model can be fitted."""
    spark = df.sparkSession
    fitted = fit_surrogate(df, trees=trees)
    if fitted is None:
        tops = ", ".join(f"top_{j}_feature string, top_{j}_value double" for j in (1, 2, 3))
        return {
            "attribution": spark.createDataFrame([], f"entity string, contribution_sum double, {tops}, prediction double"),
            "importance": spark.createDataFrame([], "feature string, mean_abs double, importance_pct double"),
        }
    out = materialize(attribute(fitted, spark))
    names = fitted[1]
    return {
        "attribution": top_features(out, names).join(out.select("entity", "prediction"), "entity"),
        "importance": global_importance(out, names),
    }
