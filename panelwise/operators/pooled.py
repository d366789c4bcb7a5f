"""One forecasting model for all entities: features, validation, recursive forecast."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.operators.ordered import running
from panelwise.operators.stats import group_means, rolling, sequence_number, shifts, with_total
from panelwise.session import materialize

LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)
DEPTH = 12


def calendar_features(period: Column) -> dict[str, Column]:
    m = F.month(period)
    angle = F.lit(2 * math.pi) * m / F.lit(12.0)
    return {
        "month": m.cast("long"), "quarter": F.quarter(period).cast("long"), "year": F.year(period).cast("long"),
        "month_sin": F.sin(angle), "month_cos": F.cos(angle),
    }


def entity_codes(df: DataFrame) -> DataFrame:
    """0-based code of every entity in sorted order."""
    keys = materialize(df.select("entity").distinct())
    return running(keys, [("entity", False)], position="_p").select("entity", (F.col("_p") - 1).alias("entity_code"))


def panel_features(df: DataFrame, value: str = "value") -> DataFrame:
    """Descriptive features: calendar, lags, rolling windows with the current row,
    trend, period and entity means with deviations.
    """
    out = df.join(entity_codes(df), "entity").withColumns(calendar_features(F.col("period")))
    out = group_means(sequence_number(rolling(shifts(out, value, LAGS), value, WINDOWS)), value)
    return out


# ---- model features: only what is known before the row -----------------------------------

MODEL_FEATURES = [
    "entity_code", "month", "quarter", "year", "month_sin", "month_cos", *[f"lag_{k}" for k in LAGS],
    *[f"past_{s}_{w}" for w in WINDOWS for s in ("mean", "std")], "trend",
]


def _history_features(past: Column) -> dict[str, Column]:
    """Lag and window features from the array of the last values (at most 12), oldest first.

    A shorter history fills what it lacks: a lag before its start is 0, a window covers the values there
    are, the deviation of fewer than two is 0.
    """
    size = F.size(past)
    out = {f"lag_{k}": F.coalesce(F.get(past, size - k), F.lit(0.0)) for k in LAGS}
    for w in WINDOWS:
        n = F.least(size, F.lit(w)).cast("double")
        last = F.slice(past, F.greatest(size - w, F.lit(0)) + 1, F.lit(w))
        mean = F.when(n > 0, F.aggregate(last, F.lit(0.0), lambda s, v: s + v) / n).otherwise(0.0)
        sq = F.aggregate(last, F.lit(0.0), lambda s, v: s + v * v)
        out[f"past_mean_{w}"] = mean
        out[f"past_std_{w}"] = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (sq - n * mean * mean) / (n - 1)))).otherwise(0.0)
    return out


def _last(past: Column) -> Column:
    return F.slice(past, F.greatest(F.size(past) - DEPTH, F.lit(0)) + 1, F.lit(DEPTH))


def training_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a full 12-row history, as model features and label."""
    w = Window.partitionBy("entity").orderBy("period")
    past = F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(-DEPTH, -1))
    rows = df.select("entity", "period", F.col(value).cast("double").alias("label"), past.alias("_past"), (F.row_number().over(w) - 1).cast("double").alias("trend"))
    rows = rows.where(F.size("_past") == DEPTH).join(entity_codes(df), "entity")
    return rows.withColumns(calendar_features(F.col("period")) | _history_features(F.col("_past"))).drop("_past")


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features").transform(df)


VALIDATION = "_validation"


def _learner(trees: int, stop: bool = False) -> GBTRegressor:
    """``stop``: trees are added only while the rows marked for validation gain from them."""
    more = {"validationIndicatorCol": VALIDATION, "validationTol": 0.0} if stop else {}
    return GBTRegressor(maxIter=trees, maxDepth=5, stepSize=0.1, seed=42, **more)


def cross_validate(rows: DataFrame, folds: int = 3, trees: int = 30) -> DataFrame:
    """Forward-chaining validation on period cut-offs: train before, stop and test after. ``trees`` is the most that are added."""
    rows = materialize(_vectors(rows))
    # the list of periods is short
    periods = [r[0] for r in rows.select("period").distinct().orderBy("period").collect()]
    size = len(periods) // (folds + 1)
    parts = []
    for k in range(folds):
        lo, hi = periods[len(periods) - (folds - k) * size], periods[min(len(periods) - 1, len(periods) - (folds - k - 1) * size - 1)]
        own = rows.where(F.col("period") <= F.lit(hi)).withColumn(VALIDATION, F.col("period") >= F.lit(lo))
        model = _learner(trees, stop=True).fit(own)
        scored = model.transform(own.where(VALIDATION))
        err = F.col("label") - F.col("prediction")
        parts.append(scored.agg(
            F.lit(k).alias("fold"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.count(F.lit(1)).alias("rows"),
            F.lit(model.getNumTrees).alias("trees"), F.lit(lo).alias("test_from"), F.lit(hi).alias("test_to"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit(rows: DataFrame, trees: int = 30):
    return _learner(trees).fit(materialize(_vectors(rows)))


def forecast(df: DataFrame, model, value: str = "value", horizon: int = 12, total: str | None = "National") -> DataFrame:
    """Recursive forecast: every step scores all entities at once, each from the month after its own last row.

    The state is one row per entity with its last 12 values (fewer for a short history; rows without a value are none); each step is
    written to the checkpoint folder, so lineage stays one step long. Every entity has ``horizon`` rows.
    """
    ordered = F.sort_array(F.collect_list(F.struct("period", F.col(value).cast("double").alias("v"))))
    w = Window.partitionBy("entity").orderBy(F.col(value).isNull(), F.desc("period"))
    last = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= DEPTH)
    sizes = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("period").alias("last"))
    state = last.groupBy("entity").agg(ordered.alias("_h")).join(sizes, "entity").join(entity_codes(df), "entity")
    past = F.filter(F.transform("_h", lambda s: s["v"]), lambda v: v.isNotNull())
    state = materialize(state.select("entity", "entity_code", past.alias("past"), F.col("last").alias("period"), F.col("n").cast("double").alias("trend")))
    steps = []
    for _ in range(horizon):
        nxt = state.withColumn("period", F.add_months("period", 1))
        x = nxt.withColumns(calendar_features(F.col("period")) | _history_features(F.col("past")))
        scored = model.transform(_vectors(x)).select(
            "entity", "entity_code", "period", (F.col("trend") + 1).alias("trend"), _last(F.concat("past", F.array("prediction"))).alias("past"), F.col("prediction").alias("forecast")
        )
        state = materialize(scored)
        steps.append(state.select("entity", "period", "forecast"))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return with_total(out, "forecast", total) if total else out


def importance(model, spark, top: int = 20) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(MODEL_FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
