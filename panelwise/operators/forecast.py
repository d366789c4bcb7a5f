"""Trend forecasts per entity, hold-out backtests and an order search.

Everything is per-entity aggregation over panel rows (one row per period), so all
entities are fitted in one shuffle; no loop over entities exists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.fixed import CAPACITY, TREND_AIC, TREND_ORDER, TREND_SEASONAL, Z80, Z95
from panelwise.operators.stats import error_metrics


def as_series(panel: DataFrame, value: str, entity: str = "entity", period: str = "period") -> DataFrame:
    """``(entity, period, y, t, n)`` with a 0-based row index per entity."""
    w = Window.partitionBy(entity).orderBy(period)
    whole = Window.partitionBy(entity)
    return panel.select(
        F.col(entity).alias("entity"),
        F.col(period).alias("period"),
        F.col(value).cast("double").alias("y"),
        (F.row_number().over(w) - 1).cast("long").alias("t"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )


def _slope_intercept(t: Column, y: Column, cond: Column | None = None) -> tuple[Column, Column]:
    """Least squares on t; a single point gives slope 0 through that point."""
    if cond is not None:
        t, y = F.when(cond, t), F.when(cond, y)
    t = F.when(y.isNotNull(), t).cast("double")
    slope = F.coalesce(F.try_divide(F.covar_pop(t, y), F.var_pop(t)), F.lit(0.0))
    return slope, F.avg(y) - slope * F.avg(t)


def fit_trend(series: DataFrame) -> DataFrame:
    """Per entity: slope, intercept, band sigma, rows, last period, largest value."""
    slope, intercept = _slope_intercept(F.col("t"), F.col("y"))
    sigma = F.when(F.count(F.lit(1)) > 1, F.stddev_pop("y")).otherwise(0.1 * F.first("y"))
    out = series.groupBy("entity").agg(
        slope.alias("slope"),
        intercept.alias("intercept"),
        sigma.alias("_sigma"),
        F.count(F.lit(1)).alias("n_obs"),
        F.max("period").alias("last_period"),
        (F.lit(CAPACITY) * F.max("y")).alias("capacity"),
    )
    return out.withColumn("sigma", F.when(F.col("_sigma") < 1e-12, F.lit(1.0)).otherwise(F.col("_sigma"))).drop("_sigma")


def project(fit: DataFrame, horizon: int = 12) -> DataFrame:
    """Forecast rows: mean clipped at 0 and widening 80/95 % bands."""
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    mean = F.greatest(F.lit(0.0), F.col("slope") * (F.col("n_obs") + F.col("step") - 1) + F.col("intercept"))
    h80 = F.lit(Z80) * F.col("sigma") * F.sqrt(F.col("step").cast("double"))
    h95 = F.lit(Z95) * F.col("sigma") * F.sqrt(F.col("step").cast("double"))
    return steps.withColumn("mean", mean).select(
        "entity",
        "step",
        F.add_months("last_period", F.col("step").cast("int")).alias("period"),
        "mean",
        F.greatest(F.lit(0.0), F.col("mean") - h80).alias("lower_80"),
        (F.col("mean") + h80).alias("upper_80"),
        F.greatest(F.lit(0.0), F.col("mean") - h95).alias("lower_95"),
        (F.col("mean") + h95).alias("upper_95"),
        "capacity",
    )


def breach_step(forecast: DataFrame) -> DataFrame:
    """First step whose upper 95 % bound exceeds the capacity, -1 if none."""
    hit = F.min(F.when(F.col("upper_95") > F.col("capacity"), F.col("step")))
    return forecast.groupBy("entity").agg(F.coalesce(hit, F.lit(-1).cast("long")).alias("breach_step"))


def holdout_rows(series: DataFrame, test_size: int = 3, min_train: int = 8) -> DataFrame:
    """Predictions for the held-out last rows; short series use smaller splits.

    The training fit is a conditional aggregate over the entity's own window, so
    fit and test rows need one shuffle together.
    """
    n = F.col("n")
    short = n < min_train + test_size
    size = F.when(~short, F.lit(test_size)).when(n >= 7, F.lit(2)).when(n >= 5, F.lit(1))
    marked = series.withColumn("_train", F.col("n") - size)
    whole = Window.partitionBy("entity")
    train = F.col("t") < F.col("_train")
    t, y = F.when(train, F.col("t").cast("double")), F.when(train, F.col("y"))
    slope = F.coalesce(F.try_divide(F.covar_pop(t, y).over(whole), F.var_pop(t).over(whole)), F.lit(0.0))
    fitted = marked.withColumns({"_slope": slope, "_ty": F.avg(y).over(whole), "_tt": F.avg(t).over(whole)})
    predicted = F.greatest(F.lit(0.0), F.col("_ty") + F.col("_slope") * (F.col("t") - F.col("_tt")))
    return fitted.where(F.col("_train").isNotNull() & ~train).select(
        "entity", "period", F.col("y").alias("actual"), predicted.alias("predicted"), F.col("_train").alias("n_train")
    )


def backtest(series: DataFrame, test_size: int = 3, min_train: int = 8) -> DataFrame:
    return error_metrics(holdout_rows(series, test_size, min_train), "actual", "predicted", ["entity"])


def run_trend(panel: DataFrame, value: str, horizon: int = 12, min_obs: int = 4) -> tuple[DataFrame, DataFrame]:
    """Forecast rows and the model summary; short entities are listed as not fitted."""
    series = as_series(panel, value)
    fit = fit_trend(series)
    ready = fit.where(F.col("n_obs") >= min_obs)
    forecast = project(ready, horizon)
    scored = backtest(series.where(F.col("n") >= min_obs))
    ok = F.col("n_obs") >= min_obs
    summary = (
        fit.select("entity", "n_obs", "capacity")
        .join(breach_step(forecast), "entity", "left")
        .join(scored, "entity", "left")
        .select(
            "entity",
            "n_obs",
            ok.alias("fitted"),
            F.when(ok, F.lit(TREND_AIC)).alias("aic"),
            F.when(ok, F.lit(TREND_ORDER)).alias("model_order"),
            F.when(ok, F.lit(TREND_SEASONAL)).alias("seasonal_order"),
            F.when(ok, F.col("capacity")).alias("capacity"),
            F.coalesce("breach_step", F.lit(-1).cast("long")).alias("breach_step"),
            F.col("mape").alias("backtest_mape"),
            F.col("rmse").alias("backtest_rmse"),
            F.col("mae").alias("backtest_mae"),
        )
    )
    return forecast.drop("capacity"), summary


def breach_queue(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("breach_step") > -1).orderBy("breach_step", "entity")


# ---- order search --------------------------------------------------------------------
#
# Candidates (p,d,q)(P,D,Q) are compared by a two-stage regression: a long
# autoregression yields residuals, then each candidate regresses the differenced
# series on its lags and residual lags. For one (entity, d, D) every candidate's
# regressors are a subset of the same ten columns, so ONE moment matrix per
# (entity, d, D), summed by Spark, serves all 36 candidates.

SEASON = 12
_AR_LAGS = [1, 2, SEASON, SEASON + 1, SEASON + 2]
_LONG = [1, 2, 3, 4, SEASON, SEASON + 1]


def moments(df: DataFrame, keys: list[str], names: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Row count and sums of products (upper triangle) over complete rows, per key."""
    cells = F.expr("array(" + ", ".join(f"sum({a} * {b})" for i, a in enumerate(names) for b in names[i:]) + ")")
    return df.dropna(subset=names).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carry], F.count(F.lit(1)).alias("rows"), cells.alias("gram")
    )


def _unpack(flat, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    at = np.triu_indices(k)
    g[at] = np.asarray(flat, dtype=float)
    return g + g.T - np.diag(np.diag(g))


def _ols(g: np.ndarray, cols: list[int], target: int) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares from a moment matrix."""
    a, b = g[np.ix_(cols, cols)], g[cols, target]
    beta = np.linalg.lstsq(a, b, rcond=1e-11)[0]
    return beta, float(max(g[target, target] - 2 * beta @ b + beta @ a @ beta, 0.0))


def _candidate_columns(p: int, q: int, P: int, Q: int) -> list[int]:
    """Positions among [const, 5 series lags, 5 residual lags]."""
    lags = lambda n, N: [i + SEASON * j for j in range(N + 1) for i in range(n + 1) if i or j]
    return [0] + [1 + _AR_LAGS.index(v) for v in lags(p, P)] + [6 + _AR_LAGS.index(v) for v in lags(q, Q)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _long_fit(gram: pd.Series, rows: pd.Series) -> pd.Series:
    k = len(_LONG) + 2
    out = []
    for g, n in zip(gram, rows):
        if n < k + 2 or g is None or any(v is None or np.isnan(v) for v in g):
            out.append(None)
        else:
            out.append(_ols(_unpack(g, k), list(range(k - 1)), k - 1)[0].tolist())
    return pd.Series(out)


_CANDIDATE = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("p", "q", "sp", "sq")] + [T.StructField(c, T.DoubleType()) for c in ("aic", "rss")]
)


@F.pandas_udf(T.ArrayType(_CANDIDATE))
def _score_candidates(gram: pd.Series, rows: pd.Series) -> pd.Series:
    out = []
    for g, n in zip(gram, rows):
        found = []
        if n and g is not None and not any(v is None or np.isnan(v) for v in g):
            full = _unpack(g, 12)
            for p in range(3):
                for q in range(3):
                    for P in range(2):
                        for Q in range(2):
                            cols = _candidate_columns(p, q, P, Q)
                            if n > len(cols) + 2:
                                rss = _ols(full, cols, 11)[1]
                                aic = n * np.log(max(rss, 1e-12) / n) + 2 * (len(cols) + 1)
                                found.append({"p": p, "q": q, "sp": P, "sq": Q, "aic": float(aic), "rss": rss})
        out.append(found)
    return pd.Series(out)


def search_orders(panel: DataFrame, value: str, min_obs: int = 24) -> DataFrame:
    """All scored candidates: ``(entity, d, sd, p, q, sp, sq, aic, rss, rows)``.

    Criteria are put on one scale across differencing orders by the per-row
    likelihood of the series in its own (standardised) units.
    """
    w = Window.partitionBy("entity", "d", "sd").orderBy("t")
    series = as_series(panel, value).where(F.col("n") >= min_obs)
    scale = F.stddev_pop("y").over(Window.partitionBy("entity"))
    center = F.avg("y").over(Window.partitionBy("entity"))
    base = series.withColumn("z", (F.col("y") - center) / F.when(scale < 1e-12, F.lit(1.0)).otherwise(scale))
    grid = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("sd")) for d in (0, 1) for s in (0, 1)]))
    each = base.withColumn("_g", grid).select("entity", "t", "z", F.col("_g.d").alias("d"), F.col("_g.sd").alias("sd"))
    each = each.withColumn("z", F.when(F.col("d") == 1, F.col("z") - F.lag("z", 1).over(w)).otherwise(F.col("z")))
    each = each.withColumn("z", F.when(F.col("sd") == 1, F.col("z") - F.lag("z", SEASON).over(w)).otherwise(F.col("z")))
    lagged = each.withColumns({"one": F.lit(1.0)} | {f"l_{k}": F.lag("z", k).over(w) for k in sorted({*_LONG, *_AR_LAGS})})
    first = moments(lagged, ["entity", "d", "sd"], ["one", *[f"l_{k}" for k in _LONG], "z"])
    coef = first.select("entity", "d", "sd", _long_fit("gram", "rows").alias("coef")).where(F.col("coef").isNotNull())
    fitted = F.col("coef")[0]
    for i, k in enumerate(_LONG):
        fitted = fitted + F.col("coef")[i + 1] * F.col(f"l_{k}")
    resid = lagged.join(coef, ["entity", "d", "sd"]).withColumn("e", F.col("z") - fitted)
    resid = resid.withColumns({f"e_{k}": F.lag("e", k).over(w) for k in _AR_LAGS})
    second = moments(resid, ["entity", "d", "sd"], ["one", *[f"l_{k}" for k in _AR_LAGS], *[f"e_{k}" for k in _AR_LAGS], "z"])
    scored = second.select("entity", "d", "sd", "rows", F.explode(_score_candidates("gram", "rows")).alias("c"))
    # criteria per row make samples of different length comparable
    return scored.select("entity", "d", "sd", "c.p", "c.q", "c.sp", "c.sq", (F.col("c.aic") / F.col("rows")).alias("aic"), "c.rss", "rows")


def best_orders(panel: DataFrame, value: str) -> DataFrame:
    """Lowest-criterion candidate per entity; shorter series fall back by length."""
    cand = search_orders(panel, value)
    best = cand.groupBy("entity").agg(F.min(F.struct("aic", "d", "sd", "p", "q", "sp", "sq")).alias("b"))
    sizes = panel.groupBy("entity").agg(F.count(F.lit(1)).alias("n_obs"))
    text = lambda *c: F.concat(F.lit("("), F.concat_ws(", ", *[F.col(f"b.{x}").cast("string") for x in c]), F.lit(")"))
    return sizes.join(best, "entity", "left").select(
        "entity",
        "n_obs",
        F.when(F.col("b").isNotNull(), text("p", "d", "q"))
        .when(F.col("n_obs") >= 8, F.lit("(1, 1, 1)"))
        .otherwise(F.lit(TREND_ORDER))
        .alias("model_order"),
        F.when(F.col("b").isNotNull(), text("sp", "sd", "sq")).otherwise(F.lit(TREND_SEASONAL)).alias("seasonal_order"),
        F.col("b.aic").alias("aic"),
    )
