"""Structural breaks, unit-root tests and lead-lag (Granger) tests per entity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.fixed import CUSUM_CRITICAL
from panelwise.functions.tails import adf_tail, f_tail
from panelwise.session import materialize
from panelwise.operators.forecast import _ols, _unpack, as_series, moments

# ---- break detection -----------------------------------------------------------------


def cusum_path(series: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Cumulative normalised residuals after the split point of each entity."""
    usable = series.where(F.col("n") >= 6).withColumn(
        "k", F.greatest(F.floor(F.col("n") * F.lit(fraction)), F.lit(3)).cast("long")
    )
    whole = Window.partitionBy("entity")
    train = F.col("t") < F.col("k")
    t, y = F.when(train, F.col("t").cast("double")), F.when(train, F.col("y"))
    fit = usable.withColumns(
        {
            "_b": F.coalesce(F.try_divide(F.covar_pop(t, y).over(whole), F.var_pop(t).over(whole)), F.lit(0.0)),
            "_ym": F.avg(y).over(whole),
            "_tm": F.avg(t).over(whole),
        }
    )
    res = fit.withColumn("residual", F.col("y") - F.col("_ym") - F.col("_b") * (F.col("t") - F.col("_tm")))
    # residuals of a least-squares fit have mean 0, so their deviation is the RMS
    sigma = F.sqrt(F.avg(F.when(train, F.col("residual") * F.col("residual"))).over(whole))
    res = res.withColumn("_s", F.when(sigma < 1e-12, F.lit(1.0)).otherwise(sigma))
    up = Window.partitionBy("entity").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return res.withColumn("cusum", F.sum(F.when(~train, F.col("residual") / F.col("_s"))).over(up)).where(~train).select(
        "entity", "period", "t", "k", "n", "cusum"
    )


def cusum_test(panel: DataFrame, value: str = "update_ratio", min_obs: int = 4) -> DataFrame:
    """Largest absolute path value, 5 % critical value, break flag and period."""
    series = as_series(panel, value).where(F.col("n") >= min_obs)
    sizes = series.groupBy("entity").agg(F.count(F.lit(1)).alias("n_obs"))
    peak = cusum_path(series).groupBy("entity").agg(
        F.max(F.abs("cusum")).alias("cusum_max"),
        F.first(F.lit(CUSUM_CRITICAL) * F.sqrt((F.col("n") - F.col("k")).cast("double"))).alias("critical"),
        F.max_by("period", F.struct(F.abs("cusum"), -F.col("t"))).alias("_at"),
    )
    hit = F.coalesce(F.col("cusum_max") > F.col("critical"), F.lit(False))
    return sizes.join(peak, "entity", "left").select(
        "entity", "cusum_max", "critical", hit.alias("break_detected"), "n_obs", F.when(hit, F.col("_at")).alias("break_period")
    )


def break_timeline(cusum: DataFrame) -> DataFrame:
    return cusum.where("break_detected").groupBy("break_period").agg(F.count(F.lit(1)).alias("breaks")).orderBy("break_period")


# ---- unit roots and differencing -------------------------------------------------------

MAX_DIFFS = 2
MEASURES = ("a_total", "b_total", "c_total")


def series_arrays(panel: DataFrame, measures=MEASURES) -> DataFrame:
    """``(entity, measure, y)``: one array per series, at most one value per period."""
    rows = F.sort_array(F.collect_list(F.struct("period", *[F.col(m).cast("double").alias(m) for m in measures])))
    arrays = panel.groupBy("entity").agg(rows.alias("_h"))
    field = lambda m: lambda v: v[m]
    each = [F.struct(F.lit(m).alias("measure"), F.transform("_h", field(m)).alias("y")) for m in measures]
    return arrays.select("entity", F.inline(F.array(*each)))


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, float(((y - x @ beta) ** 2).sum())


def adf_statistic(y: np.ndarray) -> tuple[int, float]:
    """Lag count (lowest AIC on a common sample) and t-statistic of the level."""
    n = len(y)
    top = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    if top < 0 or np.std(y) < 1e-12 * max(1.0, np.abs(y).max()):
        return 0, np.nan
    y = (y - y.mean()) / y.std()
    dy = np.diff(y)
    columns = np.column_stack([np.ones(len(dy)), y[:-1], *[np.r_[np.full(k, np.nan), dy[:-k]] for k in range(1, top + 1)]])
    best, lag = np.inf, 0
    for k in range(top + 1):
        x, target = columns[top:, : k + 2], dy[top:]
        if len(target) <= k + 2:
            break
        aic = len(target) * np.log(max(_least_squares(x, target)[1], 1e-300) / len(target)) + 2 * (k + 2)
        if aic < best:
            best, lag = aic, k
    x, target = columns[lag:, : lag + 2], dy[lag:]
    if len(target) <= lag + 2 or np.linalg.matrix_rank(x) < lag + 2:
        return lag, np.nan
    beta, rss = _least_squares(x, target)
    se = np.sqrt(rss / (len(target) - lag - 2) * np.linalg.inv(x.T @ x)[1, 1])
    return lag, float(beta[1] / se) if se > 0 else np.nan


_TEST = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("n_obs", T.LongType()), T.StructField("lags", T.LongType()), T.StructField("adf", T.DoubleType())])


@F.pandas_udf(T.ArrayType(_TEST))
def _adf_tests(series: pd.Series) -> pd.Series:
    """The test on the series and its first two differences."""
    out = []
    for y in series:
        rows = []
        for d in range(MAX_DIFFS + 1):
            z = np.diff(np.asarray(y, dtype=float), d)
            lag, stat = adf_statistic(z)
            rows.append({"d": d, "n_obs": len(z), "lags": lag, "adf": None if np.isnan(stat) else stat})
        out.append(rows)
    return pd.Series(out)


def unit_root(panel: DataFrame, measures=MEASURES) -> DataFrame:
    """Augmented Dickey-Fuller tests with a constant, for every series and d = 0..2.

    One shuffle builds the arrays; a test that cannot run has no p-value.
    """
    tested = series_arrays(panel, measures).select("entity", "measure", F.explode(_adf_tests("y")).alias("_t"))
    return tested.select("entity", "measure", "_t.*").withColumn("p_value", adf_tail(F.col("adf")))


def differencing_order(panel: DataFrame, measures=MEASURES) -> DataFrame:
    """Smallest d whose test rejects a unit root (or cannot be run); at most 2."""
    ok = F.coalesce(F.col("p_value") < 0.05, F.lit(True))
    return unit_root(panel, measures).groupBy("entity", "measure").agg(
        F.coalesce(F.min(F.when(ok, F.col("d"))), F.lit(MAX_DIFFS)).cast("int").alias("d")
    )


def differenced(panel: DataFrame, measures, diffs: DataFrame) -> DataFrame:
    """``(entity, t, measures..., dmax, raw)``: each series differenced to its own order,
    cut to the rows that all series of the entity share.
    """
    w = Window.partitionBy("entity").orderBy("period")
    orders = diffs.groupBy("entity").agg(
        F.max("d").alias("dmax"), *[F.max(F.when(F.col("measure") == m, F.col("d"))).alias(f"_d_{m}") for m in measures]
    )
    x = panel.select("entity", "period", *[F.col(m).cast("double").alias(m) for m in measures]).withColumns(
        {"t": F.row_number().over(w) - 1, "raw": F.count(F.lit(1)).over(Window.partitionBy("entity"))}
    )
    x = x.withColumns({f"_1_{m}": F.col(m) - F.lag(m).over(w) for m in measures})
    x = x.withColumns({f"_2_{m}": F.col(f"_1_{m}") - F.lag(f"_1_{m}").over(w) for m in measures})
    x = x.join(orders, "entity").where(F.col("t") >= F.col("dmax"))
    pick = lambda m: F.when(F.col(f"_d_{m}") == 0, F.col(m)).when(F.col(f"_d_{m}") == 1, F.col(f"_1_{m}")).otherwise(F.col(f"_2_{m}"))
    return x.select("entity", "t", "raw", "dmax", *[pick(m).alias(m) for m in measures])


# ---- lead-lag tests --------------------------------------------------------------------

PAIRS = [("a_total", "b_total"), ("a_total", "c_total"), ("b_total", "c_total")]


def _two_fits(max_lag: int):
    """Residual sums without and with the other measure's lags, from moments of [1, y lags, x lags, y]."""
    target = 2 * max_lag + 1

    @F.pandas_udf(T.StructType([T.StructField("rss_r", T.DoubleType()), T.StructField("rss_u", T.DoubleType())]))
    def fits(gram: pd.Series, lag: pd.Series) -> pd.DataFrame:
        res = []
        for g, p in zip(gram, lag):
            if g is None or any(v is None or np.isnan(v) for v in g):
                res.append((np.nan, np.nan))
                continue
            full = _unpack(g, target + 1)
            own, other = list(range(p + 1)), list(range(max_lag + 1, max_lag + 1 + p))
            res.append((_ols(full, own, target)[1], _ols(full, own + other, target)[1]))
        return pd.DataFrame(res, columns=["rss_r", "rss_u"])

    return fits


def granger(panel: DataFrame, pairs=PAIRS, max_lag: int = 3, min_obs: int = 6, diffs: DataFrame | None = None) -> DataFrame:
    """F-tests that lags of one measure help predict another, per entity and lag.

    Every series is differenced to its own order first; the pair is then cut to the
    rows all of an entity's series share at the tail. ``diffs`` may give the orders
    as ``(entity, measure, d)``.
    """
    measures = sorted({m for p in pairs for m in p})
    # three joins read the orders
    diffs = materialize(differencing_order(panel, measures)) if diffs is None else diffs
    wide = differenced(panel, measures, diffs).where((F.col("raw") >= min_obs) & (F.col("raw") - F.col("dmax") >= min_obs))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("cause"), F.lit(y).alias("effect"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in pairs]))
    tall = wide.withColumn("_p", each).select("entity", "t", (F.col("raw") - F.col("dmax")).alias("obs"), "_p.cause", "_p.effect", "_p.x", "_p.y")
    w = Window.partitionBy("entity", "cause", "effect").orderBy("t")
    whole = Window.partitionBy("entity", "cause", "effect")
    unit = lambda c: (F.col(c) - F.avg(c).over(whole)) / F.when(F.stddev_pop(c).over(whole) < 1e-12, F.lit(1.0)).otherwise(F.stddev_pop(c).over(whole))
    tall = tall.withColumns({"sy": F.stddev_pop("y").over(whole), "zx": unit("x"), "zy": unit("y")})
    steps = range(1, max_lag + 1)
    lagged = tall.withColumns({f"y_{k}": F.lag("zy", k).over(w) for k in steps} | {f"x_{k}": F.lag("zx", k).over(w) for k in steps})
    grid = lagged.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
    used = {f"{v}_{k}": F.when(F.col("lag") < k, F.lit(0.0)).otherwise(F.col(f"{v}_{k}")) for v in "yx" for k in steps}
    grid = grid.withColumns(used | {"one": F.lit(1.0)})
    names = ["one", *[f"y_{k}" for k in steps], *[f"x_{k}" for k in steps], "zy"]
    gram = moments(grid, ["entity", "cause", "effect", "lag"], names, ("obs", "sy"))
    fits = gram.withColumn("f", _two_fits(max_lag)("gram", "lag"))
    df2 = F.col("rows") - 2 * F.col("lag") - 1
    scale = F.col("sy") * F.col("sy")
    usable = (F.col("obs") > 2 * F.col("lag") + 1) & (df2 > 0) & (F.col("f.rss_u") * scale >= 1e-12)
    stat = F.when(usable, ((F.col("f.rss_r") - F.col("f.rss_u")) / F.col("lag")) / (F.col("f.rss_u") / df2))
    out = fits.withColumn("f_statistic", stat).withColumn("p_value", f_tail(F.col("f_statistic"), F.col("lag"), df2))
    cause = diffs.select("entity", F.col("measure").alias("cause"), F.col("d").alias("cause_diffs"))
    effect = diffs.select("entity", F.col("measure").alias("effect"), F.col("d").alias("effect_diffs"))
    out = out.join(cause, ["entity", "cause"]).join(effect, ["entity", "effect"])
    return out.select(
        "entity", "cause", "effect", "cause_diffs", "effect_diffs", "lag", "f_statistic", "p_value",
        F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"),
        (F.col("f.rss_r") * scale).alias("rss_restricted"), (F.col("f.rss_u") * scale).alias("rss_unrestricted"),
    )


def link_counts(tests: DataFrame) -> DataFrame:
    return tests.where("significant").groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("links"))


def differenced_share(tests: DataFrame) -> DataFrame:
    one = tests.agg(F.count_if(F.col("cause_diffs") > 0).alias("differenced"), F.count(F.lit(1)).alias("tests"))
    return one.withColumn("percent", F.round(F.try_divide(100.0 * F.col("differenced"), F.col("tests").cast("double"))))


def first_significant(tests: DataFrame) -> DataFrame:
    """Lowest significant lag per entity and pair."""
    return tests.where("significant").groupBy("entity", "cause", "effect").agg(
        F.min("lag").cast("long").alias("lag"), F.min_by("p_value", "lag").alias("p_value")
    )
