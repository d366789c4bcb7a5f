"""Distribution drift between a baseline and a current table.

Columns are turned into ``(feature, side, value)`` rows; each test is then one grouped
job over all features, and only a row per feature reaches a tail function. The tall
form is a narrow step after the scan, so it is made again per test, not stored: hand
in stored tables when the inputs themselves are expensive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import nan_to_null
from panelwise.functions.tails import chi2_tail, ks_method, ks_tail
from panelwise.operators.ordered import group_quantiles, ladder

KS_LIMIT, PSI_LIMIT, JS_LIMIT = 0.05, 0.1, 0.1


def pooled(baseline: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Both tables as ``(side, feature, value)``; side 0 is the baseline. NaN is missing."""
    return tall(baseline, features).withColumn("side", F.lit(0)).unionByName(tall(current, features).withColumn("side", F.lit(1)))


def tall(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) of every value that is not missing."""
    cols = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in features])
    return cols.unpivot([], list(features), "feature", "value").where(F.col("value").isNotNull())


def _ref() -> Column:
    return F.count_if(F.col("side") == 0)


def _cur() -> Column:
    return F.count_if(F.col("side") == 1)


# ---- two-sample distance ----------------------------------------------------------------


def ks_distance(pool: DataFrame, small_rows: int | None = None) -> DataFrame:
    """Largest gap between the two empirical distribution functions, per feature."""
    steps = ladder(pool, "value", {"ref": _ref(), "cur": _cur()}, ["feature"], small_rows)
    gap = F.abs(
        F.try_divide(F.col("cum_ref").cast("double"), F.col("total_ref").cast("double"))
        - F.try_divide(F.col("cum_cur").cast("double"), F.col("total_cur").cast("double"))
    )
    return steps.groupBy("feature").agg(F.max(gap).alias("ks"), F.max("total_ref").alias("n_ref"), F.max("total_cur").alias("n_cur"))


def covariate_drift(pool: DataFrame, alpha: float = 0.05, small_rows: int | None = None, method: str = "auto") -> DataFrame:
    """Distance, p-value and its method, drift flag and severity by alpha and alpha / 10."""
    enough = (F.col("n_ref") >= 2) & (F.col("n_cur") >= 2)
    out = ks_distance(pool, small_rows).withColumn("ks", F.when(enough, F.col("ks")))
    out = out.withColumn("p_value", ks_tail(F.col("ks"), F.col("n_ref"), F.col("n_cur"), method)).withColumn("p_method", ks_method(F.col("n_ref"), F.col("n_cur"), method))
    drifted = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    severity = (
        F.when(~enough, F.lit("insufficient_data"))
        .when(~drifted, F.lit("stable"))
        .when(F.col("p_value") < alpha / 10, F.lit("critical"))
        .otherwise(F.lit("warning"))
    )
    return out.withColumns({"drift_detected": drifted, "severity": severity})


# ---- binned measures ---------------------------------------------------------------------


def _binned(pool: DataFrame, bins: int, top: float = 0.0) -> DataFrame:
    """Counts per feature and equal-width bin over the pooled range, both sides."""
    span = pool.groupBy("feature").agg(F.min("value").alias("_lo"), (F.max("value") + F.lit(top)).alias("_hi"), _ref().alias("n_ref"), _cur().alias("n_cur"))
    flat = F.col("_hi") == F.col("_lo")
    span = span.select(
        "feature", "n_ref", "n_cur",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins).alias("_w"),
    )
    number = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_lo")) / F.col("_w")))
    # one row per monitored column, so never more rows than a table has columns
    counts = pool.join(F.broadcast(span.select("feature", "_lo", "_w")), "feature").groupBy("feature", number.alias("bin")).agg(_ref().alias("c_ref"), _cur().alias("c_cur"))
    grid = span.select("feature", "n_ref", "n_cur", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").fillna({"c_ref": 0, "c_cur": 0})


def psi_equal_width(pool: DataFrame, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Stability index over equal-width bins with smoothed proportions."""
    p = (F.col("c_ref") + F.lit(eps)) / (F.col("n_ref") + F.lit(eps * bins))
    q = (F.col("c_cur") + F.lit(eps)) / (F.col("n_cur") + F.lit(eps * bins))
    return _binned(pool, bins, top=1e-10).groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def psi_quantile(pool: DataFrame, bins: int = 10, floor: float = 1e-10, small_rows: int | None = None) -> DataFrame:
    """Stability index over baseline-quantile bins with open ends."""
    cuts = group_quantiles(pool.where("side = 0"), "value", "feature", [i / bins for i in range(bins + 1)], small_rows)
    distinct = F.array_distinct("quantiles")
    cuts = cuts.select("feature", F.size(distinct).alias("_k"), F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0))).alias("_edges"))
    sizes = pool.groupBy("feature").agg(_ref().alias("n_ref"), _cur().alias("n_cur"))
    # one row per monitored column
    placed = pool.join(F.broadcast(cuts), "feature").withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col("value"))))
    counts = placed.groupBy("feature", "bin").agg(_ref().alias("c_ref"), _cur().alias("c_cur"))
    p = F.greatest(F.try_divide(F.col("c_ref").cast("double"), F.col("n_ref").cast("double")), F.lit(floor))
    q = F.greatest(F.try_divide(F.col("c_cur").cast("double"), F.col("n_cur").cast("double")), F.lit(floor))
    # a bin that is empty on both sides adds 0, so only occupied bins are summed
    total = counts.join(sizes, "feature").groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    return total.join(cuts.select("feature", "_k"), "feature").select("feature", F.when(F.col("_k") >= 2, F.col("psi")).alias("psi"))


def baseline_bins(baseline: DataFrame, features: Sequence[str], bins: int = 10, small_rows: int | None = None) -> DataFrame:
    """(feature, edges, c_ref, n_ref): inner edges at baseline quantiles and the baseline's count in each bin.

    One row a feature, to be stored: counts against it merge over batches. Features without two
    different values have no row.
    """
    pool = tall(baseline, features)
    cuts = group_quantiles(pool, "value", "feature", [i / bins for i in range(bins + 1)], small_rows)
    distinct = F.array_distinct("quantiles")
    cuts = cuts.where(F.size(distinct) >= 2).select("feature", F.slice(distinct, 2, F.size(distinct) - 2).alias("edges"))
    counts = bin_counts(pool, cuts).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"), F.sum("n").alias("n_ref"))
    each = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.col("found")[b], F.lit(0).cast("long")))
    return cuts.join(counts, "feature").select("feature", "edges", each.alias("c_ref"), "n_ref")


def bin_counts(pool: DataFrame, bins: DataFrame) -> DataFrame:
    """(feature, bin, n) of the values of ``pool`` (feature, value) between the ``edges`` of ``bins``."""
    placed = pool.join(bins.select("feature", "edges"), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    return placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def psi_of_counts(bins: DataFrame, counts: DataFrame, floor: float = 1e-10) -> DataFrame:
    """(feature, n_cur, psi) of ``bin_counts`` against ``baseline_bins``; no row for a feature without counts."""
    cur = counts.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"), F.sum("n").alias("n_cur"))
    p = lambda c: F.greatest(c / F.col("n_ref"), F.lit(floor))
    q = lambda b: F.greatest(F.coalesce(F.col("found")[b] / F.col("n_cur"), F.lit(0.0)), F.lit(floor))
    parts = F.transform("c_ref", lambda c, b: (q(b) - p(c)) * F.ln(q(b) / p(c)))
    return bins.join(cur, "feature").select("feature", "n_cur", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("psi"))


def js_distance(pool: DataFrame, bins: int = 50) -> DataFrame:
    """Jensen-Shannon distance (root of the divergence, natural log) over common bins."""
    p, q = F.col("c_ref") / F.col("n_ref"), F.col("c_cur") / F.col("n_cur")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))
    return _binned(pool, bins).groupBy("feature").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part(p) + part(q)) / 2)).alias("js"))


# ---- categories ----------------------------------------------------------------------------


def chi_square(baseline: DataFrame, current: DataFrame, features: Sequence[str], with_p: bool = True) -> DataFrame:
    """Independence test of category counts, corrected when there is one degree of freedom."""
    def tall(df, side):
        return df.select(*[F.col(c).cast("string").alias(c) for c in features]).unpivot([], list(features), "feature", "category").withColumn("side", F.lit(side))

    rows = tall(baseline, 0).unionByName(tall(current, 1)).where(F.col("category").isNotNull())
    counts = rows.groupBy("feature", "category").agg(_ref().alias("o_0"), _cur().alias("o_1"))
    totals = counts.groupBy("feature").agg(F.sum("o_0").alias("t_0"), F.sum("o_1").alias("t_1"), (F.count(F.lit(1)) - 1).alias("dof"))
    wide = counts.join(F.broadcast(totals), "feature")  # one row per monitored column
    line, every = F.col("o_0") + F.col("o_1"), (F.col("t_0") + F.col("t_1")).cast("double")

    def cell(i):
        e = line * F.col(f"t_{i}") / every
        gap = F.abs(F.col(f"o_{i}") - e)
        gap = F.when(F.col("dof") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.try_divide(gap * gap, e)

    out = wide.groupBy("feature").agg(F.sum(cell(0) + cell(1)).alias("chi2"), F.max("dof").alias("dof"))
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_tail(F.col("chi2"), F.col("dof"))))
    return out


# ---- severity, monitor, history ------------------------------------------------------------


def _three(value: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    return F.when(value.isNull(), F.lit("unknown")).when(value < low, F.lit(names[0])).when(value < high, F.lit(names[1])).otherwise(F.lit(names[2]))


def severity_psi(psi: Column) -> Column:
    return _three(psi, 0.1, 0.2, ("none", "moderate", "severe"))


def severity_js(js: Column) -> Column:
    return _three(js, 0.1, 0.3, ("none", "moderate", "severe"))


def severity_p(p: Column) -> Column:
    return F.when(p.isNull(), F.lit("unknown")).when(p > 0.1, F.lit("none")).when(p > 0.01, F.lit("moderate")).otherwise(F.lit("severe"))


def severity_psi_score(psi: Column) -> Column:
    return _three(psi, 0.10, 0.25, ("stable", "warning", "critical"))


REPORT = ["feature", "test", "statistic", "p_value", "drift_detected", "severity"]


def monitor(baseline: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Long report: KS and quantile PSI per numeric column, chi-square per category column."""
    parts = []
    if numeric:
        pool = pooled(baseline, current, numeric)
        ks = ks_distance(pool).withColumn("p_value", ks_tail(F.col("ks"), F.col("n_ref"), F.col("n_cur")))
        parts.append(ks.select("feature", F.lit("KS").alias("test"), F.col("ks").alias("statistic"), "p_value", F.coalesce(F.col("p_value") < KS_LIMIT, F.lit(False)).alias("drift_detected"), severity_p(F.col("p_value")).alias("severity")))
        psi = psi_quantile(pool)
        parts.append(psi.select("feature", F.lit("PSI").alias("test"), F.col("psi").alias("statistic"), F.lit(None).cast("double").alias("p_value"), F.coalesce(F.col("psi") > PSI_LIMIT, F.lit(False)).alias("drift_detected"), severity_psi(F.col("psi")).alias("severity")))
    if categorical:
        chi = chi_square(baseline, current, categorical)
        parts.append(chi.select("feature", F.lit("Chi2").alias("test"), F.col("chi2").alias("statistic"), "p_value", F.coalesce(F.col("p_value") < KS_LIMIT, F.lit(False)).alias("drift_detected"), severity_p(F.col("p_value")).alias("severity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*REPORT)


def drift_totals(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number and percent of drifted features (any test) per run."""
    per = report.groupBy(*keys, "feature").agg(F.max("drift_detected").alias("d"))
    out = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("features"), F.count_if("d").alias("drifted"))
    return out.withColumn("drifted_pct", F.col("drifted") * 100 / F.col("features").cast("double"))


def append_history(report: DataFrame, path: str, run: str, at: str) -> None:
    """Append one run to the history table."""
    report.withColumns({"run": F.lit(run), "run_at": F.lit(at).cast("timestamp")}).write.mode("append").parquet(path)


def should_retrain(history: DataFrame, limit: float = 20.0) -> DataFrame:
    """Whether the latest run's drifted percent reaches the limit."""
    runs = drift_totals(history, ["run", "run_at"])
    return runs.agg(F.max_by("run", "run_at").alias("run"), F.max_by("drifted_pct", "run_at").alias("drifted_pct")).withColumn(
        "retrain", F.coalesce(F.col("drifted_pct") >= limit, F.lit(False))
    )


def baseline_check(baseline: DataFrame | None, current: DataFrame, features: Sequence[str], score: str | None = "ensemble_score", alpha: float = 0.05) -> DataFrame:
    """KS per index plus PSI of an anomaly score when both tables hold it.

    Without a baseline the result is empty but typed.
    """
    schema = "feature string, check_type string, ks double, p_value double, drift_detected boolean, severity string, psi double"
    if baseline is None:
        return current.sparkSession.createDataFrame([], schema)
    shared = [f for f in features if f in baseline.columns and f in current.columns]
    pool = pooled(baseline, current, shared)
    none = F.lit(None).cast("double")
    out = covariate_drift(pool, alpha).select("feature", F.lit("KS_covariate").alias("check_type"), "ks", "p_value", "drift_detected", "severity", none.alias("psi"))
    if score and score in baseline.columns and score in current.columns:
        psi = psi_equal_width(pooled(baseline, current, [score]))
        out = out.unionByName(psi.select("feature", F.lit("PSI_concept").alias("check_type"), none.alias("ks"), none.alias("p_value"), (F.col("psi") >= 0.10).alias("drift_detected"), severity_psi_score(F.col("psi")).alias("severity"), "psi"))
    return out
