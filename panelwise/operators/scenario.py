"""Scenario scoring: lever settings -> index changes and a demand multiplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import clamp01
from panelwise.functions.fixed import EFFECTS, LEVERS, PRESETS, SENSITIVITY
from panelwise.operators.indices import INDICES


def saturating(lever: Column, effect: float, rate: float) -> Column:
    return F.lit(effect) * (1 - F.exp(-F.lit(rate) * lever / 100))


def preset_table(spark) -> DataFrame:
    """Action text -> lever settings, one row per action."""
    rows = [(action, *levers) for action, levers in PRESETS.items()]
    return spark.createDataFrame(rows, "action string, " + ", ".join(f"{n} double" for n in LEVERS))


def score(levered: DataFrame) -> DataFrame:
    """Index changes (4 digits), new index values and the demand multiplier.

    ``levered`` is the indexed profile with one column per lever.
    """
    sens = {
        name: F.greatest(F.lit(floor), F.lit(offset) + sign * F.coalesce(F.col(index), F.lit(0.5)))
        for name, (floor, offset, sign, index) in SENSITIVITY.items()
    }

    def total(target: str) -> Column:
        out = F.lit(0.0)
        for lever, effect, rate, family in EFFECTS[target]:
            out = out + saturating(F.coalesce(F.col(lever), F.lit(0.0)), effect, rate) * sens[family]
        return out

    made = {f"delta_{i}": F.round(-total(i) if i == "volatility" else total(i), 4) for i in INDICES}
    out = levered.withColumns(made | {"demand_multiplier": F.round(1 + total("demand"), 4)})
    return out.withColumns({f"new_{i}": clamp01(F.col(i) + F.col(f"delta_{i}")) for i in INDICES})


def with_presets(indexed: DataFrame) -> DataFrame:
    """Levers by the entity's own action text."""
    # five fixed rows
    return indexed.join(F.broadcast(preset_table(indexed.sparkSession)), "action", "left")


def with_scenarios(indexed: DataFrame, scenarios: list[tuple[str, dict[str, float]]]) -> DataFrame:
    """Every entity under each of a short list of named scenarios."""
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(float(s.get(k, 0.0))).alias(k) for k in LEVERS]) for n, s in scenarios])
    return indexed.select("*", F.inline(cases))


def impact_table(scored: DataFrame, keys: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Long table: indicator, baseline, simulated, delta and direction."""
    rows = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).alias("baseline"), F.col(f"new_{i}").alias("simulated")) for i in INDICES])
    out = scored.select(*keys, F.inline(rows)).withColumn("delta", F.col("simulated") - F.col("baseline"))
    return out.withColumn(
        "direction", F.when(F.col("delta") > 0.001, F.lit("up")).when(F.col("delta") < -0.001, F.lit("down")).otherwise(F.lit("unchanged"))
    )


def scale_forecast(forecast: DataFrame, factors: DataFrame) -> DataFrame:
    """Mean and 95 % bounds times the entity's demand multiplier."""
    out = forecast.join(factors.select("entity", "demand_multiplier"), "entity")
    return out.withColumns({c: F.col(c) * F.col("demand_multiplier") for c in ("mean", "lower_95", "upper_95")})


def capacity_envelope(summary: DataFrame) -> DataFrame:
    return summary.withColumns({"capacity_low": F.col("capacity") * 0.9, "capacity_high": F.col("capacity") * 1.1})
