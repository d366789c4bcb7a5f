"""Composite 0-1 indices, rule labels, flags and the priority queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import EPS, TINY, first_match
from panelwise.functions.fixed import ACTION_RULES, BANDS, LABEL_RULES, MAD_SIGMA, PRIORITY, QUADRANTS
from panelwise.operators.ordered import SMALL_ROWS, quantile_row, running, with_ranks, with_row
from panelwise.session import materialize

INDICES = ["maturity", "pressure", "volatility", "predictability"]


# ---- normalisation -------------------------------------------------------------

def minmax(df: DataFrame, columns: dict[str, str], guarded: bool = True) -> DataFrame:
    """Scale columns to 0-1; ``{input: output}``. All bounds come from one aggregate."""
    bounds = df.agg(
        *[F.min(c).alias(f"_lo_{o}") for c, o in columns.items()], *[F.max(c).alias(f"_hi_{o}") for c, o in columns.items()]
    )
    wide = with_row(df, bounds)
    made = {}
    for c, o in columns.items():
        lo, span = F.col(f"_lo_{o}"), F.col(f"_hi_{o}") - F.col(f"_lo_{o}")
        if guarded:
            made[o] = F.when(span.isNull() | (span <= EPS), F.lit(0.0)).otherwise((F.col(c) - lo) / (span + F.lit(EPS)))
        else:
            made[o] = F.when(span == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(c) - lo, span))
    return wide.withColumns(made).drop(*bounds.columns)


def zscore(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Standardise with the population deviation; constant columns are only centred."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{o}") for c, o in columns.items()], *[F.stddev_pop(c).alias(f"_s_{o}") for c, o in columns.items()]
    )
    wide = with_row(df, stats)
    return wide.withColumns(
        {
            o: (F.col(c) - F.col(f"_m_{o}")) / F.when(F.col(f"_s_{o}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{o}"))
            for c, o in columns.items()
        }
    ).drop(*stats.columns)


def median_deviation(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``med_<c>`` and ``mad_<c>`` per column."""
    rows = df.count()
    med = quantile_row(df, {f"med_{c}": (c, 0.5) for c in columns}, rows=rows)
    dev = with_row(df, med).select(*[F.abs(F.col(c) - F.col(f"med_{c}")).alias(f"_d_{c}") for c in columns])
    mad = quantile_row(_keep(dev, rows), {f"mad_{c}": (f"_d_{c}", 0.5) for c in columns}, rows=rows)
    return with_row(med, mad)


def robust_score(df: DataFrame, columns: dict[str, str], unit: bool = True) -> DataFrame:
    """Median/MAD z-score, squashed to 0-1 when ``unit``."""
    params = median_deviation(df, list(columns))
    wide = with_row(df, params)
    made = {}
    for c, o in columns.items():
        z = F.when(F.col(f"mad_{c}") < TINY, F.lit(0.0)).otherwise(
            (F.col(c) - F.col(f"med_{c}")) / (F.lit(MAD_SIGMA) * F.col(f"mad_{c}"))
        )
        made[o] = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) if unit else z
    return wide.withColumns(made).drop(*params.columns)


# ---- rules ---------------------------------------------------------------------

def _holds(tests: list[tuple[str, str, float]]) -> Column:
    cond = F.lit(True)
    for index, op, limit in tests:
        cond = cond & (F.col(index) > limit if op == ">" else F.col(index) < limit)
    return cond


def label_column(rules=LABEL_RULES) -> Column:
    return first_match([(_holds(t), F.lit(name)) for name, t in rules[:-1]], F.lit(rules[-1][0]))


def with_action(df: DataFrame, rules=ACTION_RULES) -> DataFrame:
    """Status and action from one ordered rule list, evaluated once per row."""
    pair = lambda r: F.struct(F.lit(r[0]).alias("status"), F.lit(r[1]).alias("action"))
    chosen = first_match([(_holds(r[2]), pair(r)) for r in rules[:-1]], pair(rules[-1]))
    return df.withColumn("_act", chosen).withColumns({"status": F.col("_act.status"), "action": F.col("_act.action")}).drop("_act")


def risk_column(label: Column | str) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return (
        F.when(label.isNull(), F.lit("Unknown"))
        .when(label.contains("Maintenance Stress") | label.contains("Overloaded"), F.lit("Critical"))
        .when(label.contains("Unpredictable"), F.lit("Warning"))
        .otherwise(F.lit("Stable"))
    )


def band_column(index: str) -> Column:
    low, high = BANDS[index]
    return F.when(F.col(index) >= high, F.lit("high")).when(F.col(index) < low, F.lit("low")).otherwise(F.lit("moderate"))


def quadrant(df: DataFrame) -> DataFrame:
    med = quantile_row(df, {"_mm": ("maturity", 0.5), "_pm": ("pressure", 0.5)})
    right, up = F.col("maturity") > F.col("_mm"), F.col("pressure") > F.col("_pm")
    name = first_match(
        [((right if r else ~right) & (up if u else ~up), F.lit(label)) for (r, u), label in QUADRANTS.items()], None
    )
    return with_row(df, med).withColumn("quadrant", name).drop("_mm", "_pm")


def risk_zones(df: DataFrame) -> DataFrame:
    med = quantile_row(df, {"_am": ("activity", 0.5)})
    return (
        with_row(df, med)
        .withColumns(
            {
                "pressure_zone": (F.col("pressure") > 0.6) & (F.col("maturity") < 0.3),
                "volatile_zone": (F.col("volatility") > 0.6) & (F.col("activity") > F.col("_am")),
            }
        )
        .drop("_am")
    )


# ---- indices -------------------------------------------------------------------

def raw_indices(profile: DataFrame, rows: int | None = None) -> DataFrame:
    ranked = with_ranks(profile, [(f"{f}_total", f"{f}_rank", "average", True) for f in "abc"], rows=rows)
    return ranked.withColumns(
        {
            "maturity_raw": F.col("a_rank") + F.col("b_rank") + F.col("c_rank"),
            "pressure_raw": F.log1p(F.col("b_total") + F.col("c_total")) - F.log1p("a_total"),
            "volatility_raw": F.coalesce("ratio_cv", F.lit(0.0)),
            "predictability_raw": F.coalesce(F.abs("lag1_corr"), F.lit(0.0)),
        }
    )


def _keep(df: DataFrame, rows: int) -> DataFrame:
    """Write an expensive table that is read twice; recompute a small one instead."""
    return materialize(df) if rows > SMALL_ROWS else df


def index_profile(profile: DataFrame) -> DataFrame:
    """Profile with four indices relative to the entities present, labels and actions."""
    profile = materialize(profile)
    rows = profile.count()
    raw = _keep(raw_indices(profile, rows), rows)
    scaled = minmax(raw, {f"{i}_raw": i for i in INDICES})
    scaled = scaled.withColumn("maturity", F.lit(1.0) - F.col("maturity"))
    return with_action(scaled.withColumn("label", label_column()))


# ---- flags and priority ----------------------------------------------------------

FLAGS = ["flag_stress", "flag_mismatch", "flag_scale", "flag_distance"]


def anomaly_flags(indexed: DataFrame, ensemble: DataFrame | None = None) -> DataFrame:
    """Four distribution-relative flags and their count.

    ``ensemble`` may add ``(entity, ensemble_flag)``; without it that flag is 0.
    """
    rows = indexed.count()
    ranked = with_ranks(indexed, [("log_activity", "expected_volatility", "fraction", False)], rows=rows)
    first = quantile_row(
        indexed,
        {
            "_v1": ("volatility", 0.25),
            "_v3": ("volatility", 0.75),
            "_p3": ("pressure", 0.75),
            "_m1": ("maturity", 0.25),
            "_mm": ("maturity", 0.5),
            "_pm": ("pressure", 0.5),
        },
        rows=rows,
    )
    step = with_row(ranked, first).withColumns(
        {
            "flag_stress": F.col("volatility") > F.col("_v3") + F.lit(1.5) * (F.col("_v3") - F.col("_v1")),
            "flag_mismatch": (F.col("pressure") > F.col("_p3")) & (F.col("maturity") < F.col("_m1")),
            "volatility_excess": F.col("volatility") - F.col("expected_volatility"),
            "index_distance": F.sqrt(
                F.pow(F.col("maturity") - F.col("_mm"), 2) + F.pow(F.col("pressure") - F.col("_pm"), 2)
            ),
        }
    ).drop(*first.columns)
    step = _keep(step, rows)
    second = quantile_row(step, {"_e9": ("volatility_excess", 0.9), "_d9": ("index_distance", 0.9)}, rows=rows)
    out = with_row(step, second).withColumns(
        {
            "flag_scale": F.col("volatility_excess") > F.col("_e9"),
            "flag_distance": F.col("index_distance") > F.col("_d9"),
        }
    ).drop(*second.columns)
    if ensemble is None:
        out = out.withColumn("ensemble_flag", F.lit(0).cast("long"))
    else:
        out = out.join(ensemble.select("entity", "ensemble_flag"), "entity", "left").fillna({"ensemble_flag": 0})
    count = F.col("ensemble_flag").cast("long")
    for f in FLAGS:
        count = count + F.coalesce(F.col(f).cast("long"), F.lit(0).cast("long"))
    return out.withColumn("flag_count", count)


def anomaly_order() -> list[Column]:
    return [F.desc("flag_count"), F.desc("volatility"), F.desc("pressure"), F.asc("entity")]


def priority_column() -> Column:
    # flags are divided by 4 although the ensemble adds a fifth
    return (
        PRIORITY["pressure"] * F.col("pressure")
        + PRIORITY["volatility"] * F.col("volatility")
        + PRIORITY["unpredictability"] * (1 - F.col("predictability"))
        + PRIORITY["flags"] * F.coalesce(F.col("flag_count"), F.lit(0)) / F.lit(4.0)
        + PRIORITY["immaturity"] * (1 - F.col("maturity"))
    )


def focus_summary(flagged: DataFrame) -> DataFrame:
    """The profile with flags and priority; sort with ``focus_order`` when shown."""
    return flagged.withColumn("priority", priority_column())


def focus_order() -> list[Column]:
    return [F.desc("priority"), F.asc("entity")]


def pareto(df: DataFrame, guarded: bool = True) -> DataFrame:
    """Activity rank and cumulative share, largest first."""
    total = df.agg(F.sum("activity").alias("_total"))
    ordered = with_row(
        running(df, [("activity", True), ("entity", False)], {"_cum": F.col("activity")}, position="activity_rank"), total
    )
    den = F.col("_total") + F.lit(EPS) if guarded else F.col("_total").cast("double")
    return ordered.withColumn("cum_share", F.col("_cum") / den).drop("_cum", "_total")
