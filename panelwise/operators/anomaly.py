"""Distribution-based outlier scores, isolation forest and their ensemble."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.columns import TINY
from panelwise.operators.indices import INDICES, _keep, zscore
from panelwise.operators.ordered import quantile_row, with_ranks, with_row
from panelwise.session import materialize


def rescale(df: DataFrame, column: str, out: str, reverse: bool) -> DataFrame:
    """Score to 0-1: ``1-(s-min)/(range+1e-10)`` or ``(s-min)/range`` (0 if flat)."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    wide = with_row(df, ends)
    up, span = F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo")
    if reverse:
        score = 1 - up / (span + F.lit(TINY))
    else:
        score = F.when(span < TINY, F.lit(0.0)).otherwise(F.try_divide(up.cast("double"), span.cast("double")))
    return wide.withColumn(out, score).drop("_lo", "_hi")


def _skew_sign(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sign of the third central moment per column, one row."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    wide = with_row(df, means)
    return wide.agg(*[F.signum(F.avg(F.pow(F.col(c) - F.col(f"_m_{c}"), 3))).alias(f"_k_{c}") for c in columns])


def tail_score(df: DataFrame, columns: list[str] | None = None, share: float = 0.1, small_rows: int | None = None) -> DataFrame:
    """Empirical-CDF outlier score: per column the largest of left, right and
    skew-chosen tail, summed over columns. Adds ``ecod_raw``, ``ecod_score``,
    ``ecod_label``.
    """
    columns = list(columns or INDICES)
    specs = [(c, f"_{side}_{c}", "cdf", side == "r") for c in columns for side in ("l", "r")]
    rows = df.count()
    ranked = with_row(with_ranks(df, specs, small_rows, rows=rows), _skew_sign(df, columns))
    total = F.lit(0.0)
    for c in columns:
        left, right, k = -F.ln(f"_l_{c}"), -F.ln(f"_r_{c}"), F.col(f"_k_{c}")
        chosen = F.when(k < 0, left).when(k > 0, right).otherwise(left + right)
        total = total + F.greatest(left, right, chosen)
    keep = df.columns
    scored = _keep(ranked.withColumn("ecod_raw", total).select(*keep, "ecod_raw"), rows)
    scored = rescale(scored, "ecod_raw", "ecod_score", False)
    limit = quantile_row(scored, {"_t": ("ecod_raw", 1 - share)}, rows=rows)
    return with_row(scored, limit).withColumn("ecod_label", (F.col("ecod_raw") > F.col("_t")).cast("long")).drop("_t")


def rank_tail_score(df: DataFrame, columns: list[str] | None = None, small_rows: int | None = None) -> DataFrame:
    """Rank-based variant: average rank over n+1, the more extreme tail per column."""
    columns = list(columns or INDICES)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    rows = df.count()
    ranked = with_row(with_ranks(df, [(c, f"_r_{c}", "average", False) for c in columns], small_rows, rows=rows), n)
    total = F.lit(0.0)
    for c in columns:
        share = F.col(f"_r_{c}") / (F.col("_n") + 1)
        total = total + F.greatest(-F.ln(share + F.lit(TINY)), -F.ln(1 - share + F.lit(TINY)))
    scored = _keep(ranked.withColumn("tail_raw", total).select(*df.columns, "tail_raw"), rows)
    scored = rescale(scored, "tail_raw", "tail_score", False)
    limit = quantile_row(scored, {"_t": ("tail_raw", 0.9)}, rows=rows)
    return with_row(scored, limit).withColumn("tail_label", (F.col("tail_raw") >= F.col("_t")).cast("long")).drop("_t")


# ---- isolation forest --------------------------------------------------------------

TREES, SAMPLE = 200, 256
_NODE = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def _path_bonus(n: np.ndarray) -> np.ndarray:
    """Average unsuccessful search length in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree from its bounded sample; node rows out."""
    tree = int(key[0])
    rng = np.random.default_rng(42_000 + tree)
    x = pdf.sort_values("_h")[[c for c in pdf.columns if c.startswith("f_")]].to_numpy()
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    stack = [(np.arange(len(x)), 0, -1, False)]
    while stack:
        rows, depth, parent, is_right = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][5 if is_right else 4] = me
        spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([tree, me, -1, 0.0, -1, -1, depth + float(_path_bonus(np.array([len(rows)]))[0])])
            continue
        f = int(rng.choice(usable))
        lo, hi = x[rows, f].min(), x[rows, f].max()
        cut = float(rng.uniform(lo, hi))
        go_left = x[rows, f] <= cut
        nodes.append([tree, me, f, cut, -1, -1, 0.0])
        stack.append((rows[~go_left], depth + 1, me, True))
        stack.append((rows[go_left], depth + 1, me, False))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])


#: Rows offered to a tree for each row it needs; the surplus makes a short tree next to impossible.
OFFER = 1.6


def grow_forest(df: DataFrame, key: str, features: list[str], trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Node table of an isolation forest; every tree sees ``min(rows, sample)`` rows.

    One rule for all sizes: a row is offered to ``OFFER * trees * sample / rows`` trees (at most all), found by
    stepping round the ring of trees from a hashed start, and each tree keeps its rows of
    smallest hash. Hashes of the key make the forest the same on every run.
    """
    rows = max(df.count(), 1)
    cols = [F.col(c).cast("double").alias(f"f_{i}") for i, c in enumerate(features)]
    base = df.select(F.xxhash64(F.col(key), F.lit(17)).alias("_k"), *cols)
    # steps that share no factor with the number of trees visit each tree once
    steps = F.array(*[F.lit(s) for s in range(1, max(trees, 2)) if gcd(s, trees) == 1][:64])
    offers = min(float(trees), OFFER * trees * sample / rows)
    grid = 1 << 30
    extra = (F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(grid)) < int((offers % 1.0) * grid)).cast("int")
    base = base.withColumn("_m", F.least(F.lit(int(offers)) + extra, F.lit(trees))).where("_m > 0")
    start, step = F.pmod(F.xxhash64("_k", F.lit(2)), F.lit(trees)), F.element_at(steps, (F.pmod(F.xxhash64("_k", F.lit(3)), F.size(steps)) + 1).cast("int"))
    base = base.withColumns({"_s": start, "_d": step}).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    base = base.withColumn("tree", F.pmod(F.col("_s") + F.col("_j") * F.col("_d"), F.lit(trees)).cast("int")).drop("_m", "_s", "_d", "_j")
    base = base.withColumn("_h", F.xxhash64("_k", "tree"))
    w = Window.partitionBy("tree").orderBy("_h", "_k")
    picked = base.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= sample)
    return picked.groupBy("tree").applyInPandas(_grow, _NODE)


def forest_score(df: DataFrame, key: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, share: float = 0.1) -> DataFrame:
    """Adds ``forest_raw`` (larger is more normal), ``forest_score``, ``forest_label``."""
    size = min(df.count(), sample)
    # at most trees * (2 * sample - 1) node rows
    nodes = grow_forest(df, key, features, trees, sample).toPandas()
    packed = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        packed.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth")))
    forest = df.sparkSession.sparkContext.broadcast(packed)
    norm = float(_path_bonus(np.array([size]))[0]) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.DataFrame) -> pd.Series:
        m = x.to_numpy(dtype=float)
        total = np.zeros(len(m))
        who = np.arange(len(m))
        for feature, threshold, left, right, depth in forest.value:
            at = np.zeros(len(m), dtype=int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = m[who[inner], f[inner]] <= threshold[at[inner]]
                at[inner] = np.where(go, left[at[inner]], right[at[inner]])
            total += depth[at]
        return pd.Series(-np.power(2.0, -(total / len(forest.value)) / norm))

    scored = df.withColumn("forest_raw", score(F.struct(*[F.col(c).cast("double").alias(c) for c in features])))
    scored = rescale(materialize(scored), "forest_raw", "forest_score", True)
    limit = quantile_row(scored, {"_t": ("forest_raw", share)})
    return with_row(scored, limit).withColumn("forest_label", (F.col("forest_raw") < F.col("_t")).cast("long")).drop("_t")


# ---- ensemble ----------------------------------------------------------------------


def ensemble(df: DataFrame, first: str, second: str, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted score, top-tenth flag and severity rank (1 = most anomalous)."""
    rows = df.count()
    scored = _keep(df.withColumn("ensemble_score", F.lit(weights[0]) * F.col(first) + F.lit(weights[1]) * F.col(second)), rows)
    limit = quantile_row(scored, {"_t": ("ensemble_score", 0.9)}, rows=rows)
    out = with_row(with_ranks(scored, [("ensemble_score", "_sev", "min", True)], rows=rows), limit)
    return out.withColumns(
        {"ensemble_flag": (F.col("ensemble_score") >= F.col("_t")).cast("long"), "severity_rank": F.col("_sev").cast("long")}
    ).drop("_sev", "_t")


def detect(df: DataFrame, key: str = "entity", features: list[str] | None = None) -> DataFrame:
    """Standardise, score with both detectors, combine."""
    features = list(features or INDICES)
    std = materialize(zscore(df, {c: f"z_{c}" for c in features}))
    z = [f"z_{c}" for c in features]
    both = materialize(tail_score(forest_score(std, key, z), z))
    return ensemble(both, "forest_score", "ecod_score").drop(*z)
