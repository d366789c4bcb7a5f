"""Aggregates, windows, reshaping and scope filters over panels and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.columns import EPS, TINY, safe_corr
from panelwise.operators.ordered import quantile_row, small_side, with_ranks, with_row
from panelwise.session import materialize

# ---- scope -----------------------------------------------------------------------


def in_scope(df: DataFrame, start: str | None = None, end: str | None = None, entities: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Inclusive date window and entity set; an empty set keeps every entity."""
    if start is not None:
        df = df.where(F.col(date) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(date) <= F.to_date(F.lit(end)))
    return df.where(F.col("entity").isin(list(entities))) if entities else df


def require_rows(**feeds: DataFrame) -> None:
    """Fail when a scoped feed holds no row (reads one row of each)."""
    empty = [name for name, df in feeds.items() if df.isEmpty()]
    if empty:
        raise ValueError("no rows left in: " + ", ".join(sorted(empty)))


def restrict(outputs: dict[str, DataFrame], entities: Sequence[str]) -> dict[str, DataFrame]:
    """Keep chosen entities in every entity-keyed output; indices stay global.

    The Pareto view is computed again over the entities kept.
    """
    from panelwise.operators.indices import pareto
    kept = {
        k: (df.where(F.col("entity").isin(list(entities))) if entities and "entity" in df.columns else df) for k, df in outputs.items()
    }
    kept["pareto"] = pareto(materialize(kept["profile"]), guarded=False)
    return kept


def cascade(profile: DataFrame, keep: Column, others: Sequence[DataFrame]) -> list[DataFrame]:
    """Filter the profile by ``keep`` and pass its entities on to other outputs."""
    keys = profile.where(keep).select("entity")
    return [df.join(keys, "entity", "left_semi") for df in others]


# ---- aggregates --------------------------------------------------------------------


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs in one aggregate (upper triangle), then one row per metric."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    one = df.agg(*[safe_corr(columns[i], columns[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    rows = [
        F.struct(
            F.lit(columns[i]).alias("metric"),
            *[F.col(f"c_{min(i, j)}_{max(i, j)}").alias(columns[j]) for j in range(k)],
        )
        for i in range(k)
    ]
    return one.select(F.inline(F.array(*rows)))


def pair_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(safe_corr(x, y).alias("value"))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rank correlation for ``(metric, x, y)`` pairs."""
    columns = list(dict.fromkeys(c for _, x, y in pairs for c in (x, y)))
    ranked = with_ranks(df, [(c, f"_r_{c}", "average", False) for c in columns])
    one = ranked.agg(*[safe_corr(f"_r_{x}", f"_r_{y}").alias(m) for m, x, y in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m, _, _ in pairs])))


def histogram(df: DataFrame, value: str, bins: Column, groups: Sequence[str] = (), span: DataFrame | None = None) -> DataFrame:
    """Equal-width counts with a closed last bin; empty bins are reported as 0.

    ``bins`` may depend on the group size ``_n``. A constant group is widened by 0.5
    on both sides. ``span`` may give the edges as ``(groups..., _lo, _hi, _n)``.
    """
    groups = list(groups)
    known = df.where(F.col(value).isNotNull())
    if span is None:
        span = known.groupBy(*groups).agg(
            F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count(F.lit(1)).alias("_n")
        )
    flat = F.col("_hi") == F.col("_lo")
    edges = span.select(
        *groups,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")).alias("_w"),
        bins.cast("long").alias("_bins"),
    )
    wide = known.join(edges, groups) if groups else with_row(known, edges)
    bin_no = F.least(F.col("_bins") - 1, F.floor((F.col(value) - F.col("_lo")) / (F.col("_w") / F.col("_bins"))))
    counts = wide.groupBy(*groups, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = edges.select(*groups, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bins") - 1)).alias("bin"))
    return grid.join(counts, groups + ["bin"], "left").select(*groups, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def entropy(counts: DataFrame, count: str, groups: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy in bits of non-negative counts; 0 for an empty group."""
    groups = list(groups)
    # sum(p log p) = sum(c log c)/N - log N, so one aggregate is enough
    c = F.col(count).cast("double")
    total = F.sum(c)
    plogp = F.sum(F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0)))
    h = F.when(total < TINY, F.lit(0.0)).otherwise(F.log2(F.greatest(total, F.lit(TINY))) - plogp / F.greatest(total, F.lit(TINY)))
    return counts.groupBy(*groups).agg(h.alias("entropy"))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    total = df.agg(F.sum(value).alias("_total"))
    return with_row(df, total).withColumn(name, F.col(value) / (F.col("_total") + F.lit(EPS))).drop("_total")


def distinct_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exact distinct counts, ``{column: output}``."""
    return df.agg(*[F.count_distinct(c).alias(o) for c, o in columns.items()])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, one per row: the list may be long."""
    return df.select(column).distinct().orderBy(column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))


def mode_of(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per group, the smallest one on ties."""
    counts = df.groupBy(*groups, column).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*groups).agg(F.min_by(column, F.struct(-F.col("_c"), F.col(column))).alias(column))


def kpi_row(panel: DataFrame, flagged: DataFrame) -> DataFrame:
    base = flagged.agg(
        F.count("entity").alias("entities"),
        F.sum("activity").alias("total"),
        F.count_if(F.col("flag_count") > 0).alias("flagged"),
        F.count_if(F.col("flag_count") >= 2).alias("high_risk"),
    )
    out = with_row(base, panel.agg(F.count_distinct("period").alias("periods")))
    out = with_row(out, mode_of(flagged, "label").withColumnRenamed("label", "top_label"))
    return out.select("entities", "periods", "total", "flagged", "high_risk", "top_label")


def alert_row(models: DataFrame, flagged: DataFrame) -> DataFrame:
    """Breach, multi-flag and stress counts for the alert line."""
    breached = F.coalesce(F.col("breach_step"), F.lit(-1)) > -1
    one = models.agg(F.count_if(breached).alias("breached"), F.min(F.when(breached, F.col("breach_step"))).alias("earliest_step"))
    two = flagged.agg(
        F.count_if(F.col("flag_count") >= 2).alias("multi_flag"),
        F.count_if(F.coalesce(F.col("label"), F.lit("")).contains("Maintenance Stress")).alias("stressed"),
    )
    return with_row(one, two)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, exact quartiles and range per column."""
    one = df.agg(
        *[e for c in columns for e in (
            F.count(c).alias(f"count_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"),
            F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}"))]
    )
    q = quantile_row(df, {f"{n}_{c}": (c, p) for c in columns for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))})
    keys = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")
    rows = [F.struct(F.lit(c).alias("metric"), *[F.col(f"{k}_{c}").alias(k) for k in keys]) for c in columns]
    return with_row(one, q).select(F.inline(F.array(*rows)))


def band_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.sum(c).alias(c) for c in columns])
    whole = reduce(lambda x, y: x + y, [F.col(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("band"), F.col(c).alias("total"), F.try_divide(F.col(c).cast("double"), whole.cast("double")).alias("share")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def table_profile(df: DataFrame) -> DataFrame:
    """Row count and null count per column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("rows"), F.col(c).alias("nulls")) for c in df.columns]
    return one.select(F.inline(F.array(*rows)))


def error_metrics(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """MAPE over non-zero actuals (percent), RMSE and MAE."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.groupBy(*groups).agg(
        (F.avg(F.abs(F.try_divide(a - p, a))) * 100).alias("mape"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
    )


def compare_models(aligned: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    """RMSE of two forecasts on the same keyed rows and the gain of the first."""
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(actual).cast("double") - F.col(c), 2)))
    one = aligned.agg(rmse(first).alias("first_rmse"), rmse(second).alias("second_rmse"))
    return one.withColumn("improvement_pct", F.try_divide(F.col("second_rmse") - F.col("first_rmse"), F.col("second_rmse")) * 100)


# ---- windows -----------------------------------------------------------------------

BY_ENTITY = ("entity", "period")


def _ordered(group: str = "entity", order: str = "period"):
    return Window.partitionBy(group).orderBy(order)


def shifts(df: DataFrame, value: str, lags: Sequence[int] = (), leads: Sequence[int] = ()) -> DataFrame:
    w = _ordered()
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags} | {f"lead_{k}": F.lead(value, k).over(w) for k in leads})


def rolling(df: DataFrame, value: str, windows: Sequence[int]) -> DataFrame:
    made = {}
    for k in windows:
        w = _ordered().rowsBetween(-(k - 1), 0)
        made[f"mean_{k}"] = F.avg(value).over(w)
        made[f"std_{k}"] = F.stddev_samp(value).over(w)
    return df.withColumns(made)


def sequence_number(df: DataFrame, name: str = "trend") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(_ordered()) - 1).cast("long"))


def group_means(df: DataFrame, value: str) -> DataFrame:
    """Mean per period and per entity beside each row, and the gaps to them.

    Period means are aggregated and joined back: a period may hold very many rows.
    """
    per = materialize(df.groupBy("period").agg(F.avg(value).alias("period_mean")))
    out = df.join(small_side(per, per.count()), "period").withColumn("entity_mean", F.avg(value).over(Window.partitionBy("entity")))
    return out.withColumns({"period_gap": F.col(value) - F.col("period_mean"), "entity_gap": F.col(value) - F.col("entity_mean")})


def difference(df: DataFrame, value: str, order: int, name: str) -> DataFrame:
    """Difference of the given order along the rows of an entity."""
    out = df.withColumn(name, F.col(value))
    for _ in range(order):
        out = out.withColumn(name, F.col(name) - F.lag(name).over(_ordered()))
    return out


def percent_below(df: DataFrame, value: str, name: str = "pct") -> DataFrame:
    """Whole percent of rows strictly below each row's value, with a badge."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    out = with_row(with_ranks(df, [(value, "_low", "min", False)]), n)
    out = out.withColumn(name, F.floor(F.lit(100) * (F.col("_low") - 1) / F.col("_n")).cast("long")).drop("_low", "_n")
    p = F.col(name)
    badge = (
        F.when(p >= 90, F.concat(F.lit("Top "), (100 - p).cast("string"), F.lit("%")))
        .when(p >= 40, F.concat(p.cast("string"), F.lit("th pct")))
        .otherwise(F.concat(F.lit("Bottom "), (p + 1).cast("string"), F.lit("%")))
    )
    return out.withColumn("badge", badge)


def gap_statistics(df: DataFrame, date: str, groups: Sequence[str]) -> DataFrame:
    """Day gaps between consecutive dates per group.

    Dates are counted first, so a date with very many rows is one row: its repeats
    are gaps of 0 days with that weight.
    """
    groups = list(groups)
    days = df.groupBy(*groups, date).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*groups).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    steps = days.withColumn("_gap", gap).select(
        *groups,
        F.col(date),
        F.col("_c"),
        F.explode(F.array(F.struct(F.col("_gap").alias("g"), F.lit(1).cast("long").alias("c")), F.struct(F.lit(0).alias("g"), (F.col("_c") - 1).alias("c")))).alias("_s"),
    )
    return steps.groupBy(*groups).agg(
        F.percentile(F.when(F.col("_s.c") > 0, F.col("_s.g")), F.lit(0.5), F.greatest(F.col("_s.c"), F.lit(1))).alias("median_gap"),
        F.max("_s.g").cast("long").alias("max_gap"),
        (F.sum("_s.c") - F.count_distinct(date)).alias("duplicate_dates"),
    ).withColumns(
        {
            "large_gaps": F.col("max_gap") > 3 * F.col("median_gap"),
            "no_duplicates": F.col("duplicate_dates") == 0,
        }
    )


def sorted_flag(df: DataFrame, date: str, position: str, groups: Sequence[str]) -> DataFrame:
    """Whether dates never decrease along ``position``, per group.

    Rows are first reduced to one per date: dates are in order exactly when every
    date ends before the next one starts.
    """
    groups = list(groups)
    days = df.groupBy(*groups, date).agg(F.min(position).alias("_first"), F.max(position).alias("_last"))
    w = Window.partitionBy(*groups).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    back = days.withColumn("_back", F.col("_first") < F.max("_last").over(w))
    return back.groupBy(*groups).agg((F.count_if("_back") == 0).alias("dates_sorted"))


def last_rows(df: DataFrame, count: int) -> DataFrame:
    w = Window.partitionBy("entity").orderBy(F.desc("period"))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= count).drop("_k")


# ---- ordering, sets, shape ---------------------------------------------------------


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_by(df: DataFrame, metric: str, groups: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Row with the smallest metric per group; keys decide ties."""
    picked = df.groupBy(*groups).agg(F.min(F.struct(metric, *keys)).alias("_b"))
    return picked.select(*groups, *[F.col(f"_b.{k}").alias(k) for k in keys], F.col(f"_b.{metric}").alias(metric))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def with_total(df: DataFrame, value: str, label: str) -> DataFrame:
    """Detail rows plus one total row per period, from one grouping-sets aggregate."""
    sets = df.groupingSets([[F.col("entity"), F.col("period")], [F.col("period")]], "entity", "period")
    out = sets.agg(F.sum(value).alias(value), F.grouping("entity").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col("entity")).alias("entity"), "period", value)


def set_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.subtract(y)


def set_equal(x: DataFrame, y: DataFrame) -> DataFrame:
    extra = x.subtract(y).unionByName(y.subtract(x))
    return extra.agg((F.count(F.lit(1)) == 0).alias("equal"))


def common_keys(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.intersect(y)


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(columns), "measure", "value")


def to_wide(df: DataFrame, value: str, entities: Sequence[str]) -> DataFrame:
    """Period x entity matrix for a given, explicit list of entities."""
    return df.where(F.col("entity").isin(list(entities))).groupBy("period").pivot("entity", list(entities)).agg(F.max(value))


def peer_comparison(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """One entity's values beside the medians of all."""
    med = quantile_row(df, {f"_m_{c}": (c, 0.5) for c in columns})
    own = with_row(df.where(F.col("entity") == entity), med)
    rows = [F.struct(F.lit(c).alias("indicator"), F.col(c).alias("own"), F.col(f"_m_{c}").alias("peers")) for c in columns]
    return own.select(F.inline(F.array(*rows)))
