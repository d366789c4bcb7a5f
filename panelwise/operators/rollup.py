"""Facts -> panel (entity x period) -> entity profile and period summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.columns import add_all, month_start, ratio, safe_corr, variation

BANDS_OF = {"a": ["a_1", "a_2", "a_3"], "b": ["b_1", "b_2"], "c": ["c_1", "c_2"]}
KEYS = ["entity", "period"]


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "period": month_start(d),
            "year_month": F.date_format(d, "yyyy-MM"),
            "year": F.year(d).cast("long"),
            "month": F.month(d).cast("long"),
            "quarter": F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
        }
    )


def row_totals(df: DataFrame, feed: str) -> DataFrame:
    return df.withColumn(f"{feed}_total", add_all(BANDS_OF[feed]))


def rollup(facts: DataFrame, feed: str, date: str = "date") -> DataFrame:
    """Sums per entity and month; the map side combines before the shuffle."""
    bands = BANDS_OF[feed]
    summed = (
        facts.where(F.col("entity").isNotNull())
        .select("entity", month_start(date).alias("period"), *bands)
        .groupBy(*KEYS)
        .agg(*[F.sum(b).alias(b) for b in bands])
    )
    return summed.select(*KEYS, add_all(bands).alias(f"{feed}_total"), *bands)


def join_feeds(a: DataFrame, b: DataFrame, c: DataFrame, how: str = "inner") -> DataFrame:
    """Join three rolled-up feeds on entity and period."""
    return a.join(b, KEYS, how).join(c, KEYS, how)


def with_ratios(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {
            "update_ratio": ratio(F.col("b_total") + F.col("c_total"), "a_total"),
            "b_ratio": ratio("b_total", "a_total"),
            "c_ratio": ratio("c_total", "a_total"),
            "a1_share": ratio("a_1", "a_total"),
            "a2_share": ratio("a_2", "a_total"),
            "b2_share": ratio("b_2", "b_total"),
            "c2_share": ratio("c_2", "c_total"),
            "activity": add_all(["a_total", "b_total", "c_total"]),
        }
    )


def build_panel(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    return with_ratios(join_feeds(rollup(a, "a"), rollup(b, "b"), rollup(c, "c")))


def densify(panel: DataFrame, columns: list[str], fill: int = 0) -> DataFrame:
    """Add the months an entity skips between its first and last one.

    The other operators take rows as consecutive; use this first where lag 1 must
    mean the month before.
    """
    span = panel.groupBy("entity").agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    months = F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("period")
    return span.select("entity", months).join(panel.select(*KEYS, *columns), KEYS, "left").fillna(fill, columns)


def variation_by_entity(panel: DataFrame) -> DataFrame:
    return panel.groupBy("entity").agg(
        variation("a_total").alias("a_cv"),
        variation("b_total").alias("b_cv"),
        variation("c_total").alias("c_cv"),
        variation("update_ratio").alias("ratio_cv"),
    )


def _with_leads(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("period")
    return panel.withColumns({"_c1": F.lead("c_2", 1).over(w), "_c2": F.lead("c_2", 2).over(w)})


def _lag_corr(lead: str):
    return F.when(F.count(F.lit(1)) >= 3, safe_corr("a_2", lead))


def lag_correlation(panel: DataFrame) -> DataFrame:
    """Correlation of one measure with another one and two rows later, per entity."""
    return _with_leads(panel).groupBy("entity").agg(_lag_corr("_c1").alias("lag1_corr"), _lag_corr("_c2").alias("lag2_corr"))


def entity_profile(panel: DataFrame) -> DataFrame:
    """One row per entity: totals, mean shares, variation and lag correlation.

    The window and the aggregation share one shuffle on the entity; a panel row
    is already an aggregate, so an entity holds one row per period at most.
    """
    prof = (
        _with_leads(panel)
        .groupBy("entity")
        .agg(
            *[F.sum(f"{f}_total").alias(f"{f}_total") for f in "abc"],
            *[F.avg(c).alias(c) for c in ("a1_share", "a2_share", "b2_share", "c2_share")],
            F.avg("update_ratio").alias("avg_update_ratio"),
            F.avg("b_ratio").alias("avg_b_ratio"),
            F.avg("c_ratio").alias("avg_c_ratio"),
            F.count("period").alias("active_periods"),
            variation("a_total").alias("a_cv"),
            variation("b_total").alias("b_cv"),
            variation("c_total").alias("c_cv"),
            variation("update_ratio").alias("ratio_cv"),
            _lag_corr("_c1").alias("lag1_corr"),
            _lag_corr("_c2").alias("lag2_corr"),
        )
    )
    return prof.withColumn("activity", add_all(["a_total", "b_total", "c_total"])).withColumn("log_activity", F.log1p("activity"))


def period_summary(panel: DataFrame) -> DataFrame:
    out = panel.groupBy("period").agg(
        *[F.sum(f"{f}_total").alias(f"{f}_total") for f in "abc"],
        *[F.avg(c).alias(c) for c in ("b_ratio", "c_ratio", "update_ratio", "a1_share", "b2_share", "c2_share")],
    )
    return out.withColumn("activity", add_all(["a_total", "b_total", "c_total"]))
