"""Outlier-robust indices and entropy-based predictability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators.indices import robust_score
from panelwise.operators.stats import entropy, histogram


def entropy_predictability(panel: DataFrame, value: str = "activity", max_bins: int = 12) -> DataFrame:
    """``1 - H / H_max`` of the histogram of an entity's values; NULL below 3 rows."""
    hist = histogram(panel, value, F.least(F.lit(max_bins), F.col("_n")), ["entity"])
    sized = hist.groupBy("entity").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("rows"))
    out = entropy(hist, "n", ["entity"]).join(sized, "entity")
    top = F.when(F.col("bins") > 1, F.log2(F.col("bins").cast("double"))).otherwise(F.lit(1.0))
    enough = F.col("rows") >= 3
    return out.select(
        "entity",
        F.when(enough, F.col("entropy")).alias("entropy"),
        F.when(enough, F.col("entropy") / top).alias("entropy_share"),
        F.when(enough, 1 - F.col("entropy") / top).alias("entropy_predictability"),
    )


def robust_indices(raw: DataFrame, entropy_detail: DataFrame | None = None) -> DataFrame:
    """Median/MAD versions of three indices; adds the entropy one when given."""
    out = robust_score(
        raw, {"maturity_raw": "robust_maturity", "pressure_raw": "robust_pressure", "volatility_raw": "robust_volatility"}
    ).withColumn("robust_maturity", 1 - F.col("robust_maturity"))
    if entropy_detail is not None:
        out = out.join(entropy_detail.select("entity", "entropy_predictability"), "entity", "left").withColumn(
            "robust_predictability", F.coalesce("entropy_predictability", F.lit(0.0))
        )
    return out
