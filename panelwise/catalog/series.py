"""Queries for forecasts, breaks, lead-lag tests and counterfactuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.registry import edge, query
from panelwise.catalog.sql import build, r, rs, ym
from panelwise.operators import causal, forecast, indices, rollup, stats, synthetic
from panelwise.operators.ordered import with_row
from panelwise.plans import bindings as b
from panelwise.session import materialize

# ---- trend forecasts ---------------------------------------------------------------

FIT = """SELECT entity, coalesce(covar_pop(t,y)/nullif(var_pop(t),0),0) AS slope,
 avg(y)-coalesce(covar_pop(t,y)/nullif(var_pop(t),0),0)*avg(t) AS intercept,
 CASE WHEN stddev_pop(y)<1e-12 THEN 1 ELSE stddev_pop(y) END AS sigma, count(*)::BIGINT AS n_obs, max(period) AS last_period,
 1.25*max(y) AS capacity FROM series GROUP BY entity"""
FC = """SELECT entity, step, (last_period+to_months(step::INT))::DATE AS period, capacity, mean,
 greatest(0,mean-1.282*sigma*sqrt(step)) AS lower_80, mean+1.282*sigma*sqrt(step) AS upper_80,
 greatest(0,mean-1.960*sigma*sqrt(step)) AS lower_95, mean+1.960*sigma*sqrt(step) AS upper_95
 FROM (SELECT *, greatest(0, slope*(n_obs+step-1)+intercept) AS mean FROM fit, (SELECT unnest(range(1,13)) AS step))"""
BT_ROWS = """SELECT entity, period, y AS actual, greatest(0, ty+coalesce(cv/nullif(vt,0),0)*(t-tt)) AS predicted FROM (
 SELECT *, covar_pop(CASE WHEN t<nt THEN t END, CASE WHEN t<nt THEN y END) OVER p AS cv, var_pop(CASE WHEN t<nt THEN t END) OVER p AS vt,
 avg(CASE WHEN t<nt THEN y END) OVER p AS ty, avg(CASE WHEN t<nt THEN t END) OVER p AS tt
 FROM (SELECT *, n-CASE WHEN n>=11 THEN 3 WHEN n>=7 THEN 2 WHEN n>=5 THEN 1 END AS nt FROM series) WINDOW p AS (PARTITION BY entity)) WHERE t>=nt"""
BT = """SELECT entity, avg(abs((actual-predicted)/nullif(actual,0)))*100 AS mape, sqrt(avg((actual-predicted)*(actual-predicted))) AS rmse,
 avg(abs(actual-predicted)) AS mae FROM btrows GROUP BY entity"""
BREACH = "SELECT entity, coalesce(min(step) FILTER (upper_95>capacity),-1)::BIGINT AS breach_step FROM fcast GROUP BY entity"
BANDS = ("mean", "lower_80", "upper_80", "lower_95", "upper_95")
STEPS = dict(fit=FIT, fcast=FC)
ALL = dict(fit=FIT, fcast=FC, btrows=BT_ROWS, bt=BT, breach=BREACH)


def _panel(s, d):
    return b.panel(s, d)


def _fc(s, d):
    return forecast.project(forecast.fit_trend(forecast.as_series(_panel(s, d), "b_total")))


@query("m1_trend_forecast", build("series", f"SELECT entity, step, {rs(*BANDS)} FROM fcast", **STEPS))
def _(s, d):
    return edge(_fc(s, d), "entity", "step", *BANDS)


@query("m2_horizon_calendar", build("series", f"SELECT entity, step, {ym()} AS period FROM fcast", **STEPS))
def _(s, d):
    return edge(_fc(s, d), "entity", "step", "period")


@query("m3_capacity_breach", build("series", f"SELECT entity, {r('capacity')} AS capacity, breach_step FROM fit JOIN breach USING (entity)", **ALL))
def _(s, d):
    fc = _fc(s, d)
    return edge(fc.groupBy("entity").agg(F.max("capacity").alias("capacity")).join(forecast.breach_step(fc), "entity"))


@query("w12_first_crossing", build("series", "SELECT entity, breach_step FROM breach", **ALL))
def _(s, d):
    return forecast.breach_step(_fc(s, d))


@query("m4_backtest", build("series", f"SELECT entity, {rs('mape', 'rmse', 'mae')} FROM bt", **ALL))
def _(s, d):
    return edge(forecast.backtest(forecast.as_series(_panel(s, d), "b_total")))


SUMMARY = """SELECT entity, n_obs, n_obs>=4 AS fitted, 999::DOUBLE AS aic, 'Fallback (Linear Regression)' AS model_order, 'None' AS seasonal_order,
 capacity, breach_step, mape AS backtest_mape, rmse AS backtest_rmse, mae AS backtest_mae FROM fit LEFT JOIN breach USING (entity) LEFT JOIN bt USING (entity)"""
SUM_D = ("capacity", "backtest_mape", "backtest_rmse", "backtest_mae")


@query("m5_forecast_run", build("series", f"SELECT entity, n_obs, fitted, aic, model_order, seasonal_order, breach_step, {rs(*SUM_D)} FROM summary", **ALL, summary=SUMMARY))
def _(s, d):
    summary = forecast.run_trend(materialize(_panel(s, d).select("entity", "period", "b_total")), "b_total")[1]
    return edge(summary, "entity", "n_obs", "fitted", "aic", "model_order", "seasonal_order", "breach_step", *SUM_D)


# customers as entities: series of 1 to ~30 rows exercise every size rule
SHORT = """SELECT entity, period, y, row_number() OVER (PARTITION BY entity ORDER BY period)-1 AS t, count(*) OVER (PARTITION BY entity) AS n
 FROM (SELECT o_custkey AS entity, date_trunc('month',o_orderdate)::DATE AS period, count(*)::DOUBLE AS y FROM orders GROUP BY 1,2)"""


def _short(s, d):
    o = b.table(s, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))


FIT_SHORT = FIT.replace("CASE WHEN stddev_pop(y)<1e-12 THEN 1 ELSE stddev_pop(y) END", "CASE WHEN (CASE WHEN count(*)>1 THEN stddev_pop(y) ELSE 0.1*max(y) END)<1e-12 THEN 1 ELSE (CASE WHEN count(*)>1 THEN stddev_pop(y) ELSE 0.1*max(y) END) END")


@query(
    "m5_forecast_run_short_series",
    build(
        "",
        f"""SELECT entity, n_obs, n_obs>=4 AS fitted, coalesce(CASE WHEN n_obs>=4 THEN breach_step END,-1) AS breach_step, {r('CASE WHEN n_obs>=4 THEN capacity END')} AS capacity,
 {r('CASE WHEN n_obs>=4 THEN mape END')} AS backtest_mape, {r('CASE WHEN n_obs>=4 THEN rmse END')} AS backtest_rmse FROM fit LEFT JOIN breach USING (entity) LEFT JOIN bt USING (entity)""",
        series=SHORT,
        fit=FIT_SHORT,
        fcast=FC,
        btrows=BT_ROWS,
        bt=BT,
        breach=BREACH,
    ),
)
def _(s, d):
    summary = forecast.run_trend(_short(s, d), "n")[1]
    return edge(summary, "entity", "n_obs", "fitted", "breach_step", "capacity", "backtest_mape", "backtest_rmse")


@query("t5_breach_queue", build("series", f"SELECT entity, breach_step, {r('capacity')} AS capacity FROM summary WHERE breach_step>-1 ORDER BY breach_step, entity", **ALL, summary=SUMMARY))
def _(s, d):
    summary = forecast.run_trend(materialize(_panel(s, d).select("entity", "period", "b_total")), "b_total")[1]
    return edge(forecast.breach_queue(summary), "entity", "breach_step", "capacity")


@query(
    "a18_alert_row",
    build(
        "series fl",
        "SELECT count(*) FILTER (breach_step>-1)::BIGINT AS breached, (min(breach_step) FILTER (breach_step>-1))::BIGINT AS earliest_step, (SELECT count(*) FROM fl WHERE flag_count>=2)::BIGINT AS multi_flag, (SELECT count(*) FROM fl WHERE label LIKE '%Maintenance Stress%')::BIGINT AS stressed FROM breach",
        **ALL,
    ),
)
def _(s, d):
    p = materialize(_panel(s, d))
    summary = forecast.run_trend(p, "b_total")[1]
    flagged = indices.anomaly_flags(materialize(indices.index_profile(rollup.entity_profile(p))))
    return stats.alert_row(summary, flagged)


@query("a27_error_metrics", build("series", f"SELECT {r('avg(abs((actual-predicted)/nullif(actual,0)))*100')} AS mape, {r('sqrt(avg((actual-predicted)*(actual-predicted)))')} AS rmse, {r('avg(abs(actual-predicted))')} AS mae FROM btrows", **ALL))
def _(s, d):
    return edge(stats.error_metrics(forecast.holdout_rows(forecast.as_series(_panel(s, d), "b_total")), "actual", "predicted"))


NAIVE = "SELECT b.*, (SELECT y FROM series s WHERE s.entity=b.entity AND s.t=s.n-4) AS naive FROM btrows b"


def _naive(series):
    last = series.where(F.col("t") == F.col("n") - 4).select("entity", F.col("y").alias("naive"))
    return forecast.holdout_rows(series).join(last, "entity")


@query(
    "a28_model_comparison",
    build(
        "series",
        f"""SELECT {r('f')} AS first_rmse, {r('g')} AS second_rmse, {r('(g-f)/g*100')} AS improvement_pct FROM
 (SELECT sqrt(avg(pow(actual-predicted,2))) AS f, sqrt(avg(pow(actual-naive,2))) AS g FROM both_models)""",
        **ALL,
        both_models=NAIVE,
    ),
)
def _(s, d):
    rows = _naive(forecast.as_series(_panel(s, d), "b_total"))
    return edge(stats.compare_models(rows, "actual", "predicted", "naive"))


@query("j8_forecast_alignment", build("series", f"SELECT entity, {ym()} AS period, {rs('actual', 'predicted', 'naive')} FROM both_models", **ALL, both_models=NAIVE))
def _(s, d):
    return edge(_naive(forecast.as_series(_panel(s, d), "b_total")), "entity", "period", "actual", "predicted", "naive")


@query(
    "a29_fit_summary",
    build(
        "series",
        f"SELECT count(*) FILTER (fitted)::BIGINT AS fitted, count(*)::BIGINT AS total, {r('quantile_cont(aic,0.5)')} AS median_aic, {r('quantile_cont(backtest_mape,0.5)')} AS median_mape, {r('quantile_cont(backtest_rmse,0.5)')} AS median_rmse FROM summary",
        **ALL,
        summary=SUMMARY,
    ),
)
def _(s, d):
    from panelwise.operators.ordered import quantile_row, with_row

    summary = materialize(forecast.run_trend(materialize(_panel(s, d).select("entity", "period", "b_total")), "b_total")[1])
    counts = summary.agg(F.count_if("fitted").alias("fitted"), F.count(F.lit(1)).alias("total"))
    q = quantile_row(summary.where("fitted"), {"median_aic": ("aic", 0.5), "median_mape": ("backtest_mape", 0.5), "median_rmse": ("backtest_rmse", 0.5)})
    return edge(with_row(counts, q))


@query(
    "a24_hierarchical_rollup",
    build("series", f"SELECT entity, {ym()} AS period, {r('mean')} AS mean FROM fcast UNION ALL SELECT 'National', {ym()}, {r('sum(mean)')} FROM fcast GROUP BY period", **STEPS),
)
def _(s, d):
    return edge(stats.with_total(_fc(s, d), "mean", "National"))


@query("p22_scaled_forecast", build("series", f"SELECT entity, step, {', '.join(r(f'{c}*1.15') + ' AS ' + c for c in ('mean', 'lower_95', 'upper_95'))} FROM fcast", **STEPS))
def _(s, d):
    from panelwise.operators.scenario import scale_forecast

    fc = _fc(s, d)
    factors = fc.select("entity").distinct().withColumn("demand_multiplier", F.lit(1.15))
    return edge(scale_forecast(fc, factors), "entity", "step", "mean", "lower_95", "upper_95")


@query("p23_capacity_envelope", build("series", f"SELECT entity, {r('capacity')} AS capacity, {r('capacity*0.9')} AS capacity_low, {r('capacity*1.1')} AS capacity_high FROM fit", **STEPS))
def _(s, d):
    from panelwise.operators.scenario import capacity_envelope

    fit = forecast.fit_trend(forecast.as_series(_panel(s, d), "b_total"))
    return edge(capacity_envelope(fit.select("entity", "capacity")))


@query("m6_order_search")
def _(s, d):
    return edge(forecast.best_orders(materialize(_panel(s, d).select("entity", "period", "b_total")), "b_total"))


# ---- breaks --------------------------------------------------------------------------

CS = """SELECT entity, period, t, k, n, sum(CASE WHEN t>=k THEN res/(CASE WHEN sg<1e-12 THEN 1 ELSE sg END) END) OVER (PARTITION BY entity ORDER BY t ROWS UNBOUNDED PRECEDING) AS cusum FROM
 (SELECT *, sqrt(avg(CASE WHEN t<k THEN res*res END) OVER (PARTITION BY entity)) AS sg FROM
 (SELECT *, y-ty-coalesce(cv/nullif(vt,0),0)*(t-tt) AS res FROM (SELECT *, covar_pop(CASE WHEN t<k THEN t END, CASE WHEN t<k THEN y END) OVER p AS cv,
 var_pop(CASE WHEN t<k THEN t END) OVER p AS vt, avg(CASE WHEN t<k THEN y END) OVER p AS ty, avg(CASE WHEN t<k THEN t END) OVER p AS tt
 FROM (SELECT *, greatest(floor(n*0.5),3)::BIGINT AS k FROM rseries WHERE n>=6) WINDOW p AS (PARTITION BY entity))))"""
RSERIES = "SELECT entity, period, update_ratio AS y, row_number() OVER (PARTITION BY entity ORDER BY period)-1 AS t, count(*) OVER (PARTITION BY entity) AS n FROM panel"
CT = """SELECT entity, count(*)::BIGINT+any_value(k) AS n_obs, max(abs(cusum)) AS cusum_max, 1.358*sqrt(any_value(n-k)) AS critical,
 arg_max(period, abs(cusum)) AS peak_at FROM (SELECT * FROM cs WHERE t>=k ORDER BY entity, t) GROUP BY entity"""
CUS = dict(rseries=RSERIES, cs=CS, ct=CT)


@query("w11_cusum_path", build("panel", f"SELECT entity, {ym()} AS period, {rs('cusum', digits=4)} FROM cs WHERE t>=k", **CUS))
def _(s, d):
    return edge(causal.cusum_path(forecast.as_series(_panel(s, d), "update_ratio")), "entity", "period", "cusum", digits=4)


CT_OUT = f"SELECT entity, {rs('cusum_max', 'critical', digits=5)}, cusum_max>critical AS break_detected, n_obs, CASE WHEN cusum_max>critical THEN {ym('peak_at')} END AS break_period FROM ct"


@query("m9_cusum_break", build("panel", CT_OUT, **CUS))
def _(s, d):
    out = causal.cusum_test(_panel(s, d)).withColumn("break_period", F.date_format("break_period", "yyyy-MM"))
    return edge(out, digits=5)


@query("w13_break_position", build("panel", f"SELECT entity, {ym('peak_at')} AS peak FROM ct", **CUS))
def _(s, d):
    path = causal.cusum_path(forecast.as_series(_panel(s, d), "update_ratio"))
    at = path.groupBy("entity").agg(F.max_by("period", F.struct(F.abs("cusum"), -F.col("t"))).alias("peak"))
    return at.withColumn("peak", F.date_format("peak", "yyyy-MM"))


@query("a26_break_timeline", build("panel", f"SELECT {ym('peak_at')} AS break_period, count(*)::BIGINT AS breaks FROM ct WHERE cusum_max>critical GROUP BY 1", **CUS))
def _(s, d):
    return causal.break_timeline(causal.cusum_test(_panel(s, d))).withColumn("break_period", F.date_format("break_period", "yyyy-MM"))


@query("a16_peak_break", build("panel", f"SELECT {ym('peak_at')} AS break_period FROM ct WHERE cusum_max>critical GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", **CUS))
def _(s, d):
    breaks = causal.cusum_test(_panel(s, d)).where("break_detected").withColumn("break_period", F.date_format("break_period", "yyyy-MM"))
    return stats.mode_of(breaks, "break_period")


# ---- unit roots and lead-lag ------------------------------------------------------------


def _granger(s, d):
    return materialize(causal.granger(materialize(_panel(s, d).select("entity", "period", *causal.MEASURES))))


@query("m7_unit_root")
def _(s, d):
    p = materialize(_panel(s, d).select("entity", "period", *causal.MEASURES))
    return edge(causal.unit_root(p), "entity", "measure", "d", "n_obs", "lags", "adf", "p_value")


@query("m8_granger")
def _(s, d):
    out = _granger(s, d)
    return edge(out, "entity", "cause", "effect", "cause_diffs", "effect_diffs", "lag", "f_statistic", "p_value", "significant")


L1 = """SELECT entity, a_total::DOUBLE AS x, b_total::DOUBLE AS y, lag(a_total::DOUBLE) OVER w AS x1, lag(b_total::DOUBLE) OVER w AS y1 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)"""
L2 = """SELECT entity, count(*) AS m, regr_sxx(y,y1) AS s11, regr_sxx(y,x1) AS s22, regr_sxy(x1,y1) AS s12, regr_sxy(y,y1) AS s1y, regr_sxy(y,x1) AS s2y, regr_syy(y,y1) AS syy FROM l1 WHERE x1 IS NOT NULL GROUP BY entity"""
L3 = """SELECT entity, m, syy-s1y*s1y/s11 AS rss_r, syy-(s1y*(s1y*s22-s2y*s12)+s2y*(s2y*s11-s1y*s12))/(s11*s22-s12*s12) AS rss_u FROM l2"""


@query("m8_granger_lag1", build("panel", f"SELECT entity, {r('(rss_r-rss_u)/(rss_u/(m-3))')} AS f_statistic, {rs('rss_r', 'rss_u', digits=3)} FROM l3", l1=L1, l2=L2, l3=L3))
def _(s, d):
    p = materialize(_panel(s, d).select("entity", "period", "a_total", "b_total"))
    levels = p.select("entity").distinct().select("entity", F.explode(F.array(F.lit("a_total"), F.lit("b_total"))).alias("measure"), F.lit(0).alias("d"))
    out = causal.granger(p, [("a_total", "b_total")], 1, 6, levels)
    out = edge(out.select("entity", "f_statistic"))
    full = causal.granger(p, [("a_total", "b_total")], 1, 6, levels)
    rss = edge(full.select("entity", F.col("rss_restricted").alias("rss_r"), F.col("rss_unrestricted").alias("rss_u")), digits=3)
    return out.join(rss, "entity")


@query("a25_link_counts")
def _(s, d):
    return causal.link_counts(_granger(s, d))


@query("a25_differenced_share")
def _(s, d):
    return causal.differenced_share(_granger(s, d))


@query("t7_first_significant")
def _(s, d):
    return edge(causal.first_significant(_granger(s, d)))


# ---- counterfactuals ----------------------------------------------------------------------

CUT, UNIT = "1999-01-01", "NATION_3"
EQUAL = f"""SELECT own.entity AS treated, own.period, own.activity AS actual, syn.v AS synthetic, own.activity-syn.v AS effect, own.period>=DATE '{CUT}' AS post
 FROM (SELECT * FROM panel WHERE entity='{UNIT}') own JOIN (SELECT period, sum(activity/24.0) AS v FROM panel WHERE entity<>'{UNIT}' GROUP BY 1 HAVING count(*)=24) syn USING (period)"""


def _equal_effects(s, d):
    p = materialize(_panel(s, d).select("entity", "period", "activity"))
    w = synthetic.donor_pool(p, UNIT).select(F.lit(UNIT).alias("treated"), F.col("entity").alias("donor"), F.lit(1 / 24.0).alias("weight"))
    return synthetic.effect_series(p, w, "activity", CUT)


#: two-sided t tail: I_x(n/2, 1/2) or 1 - I_(1-x)(1/2, n/2), each by its all-positive series
T_SERIES = "exp({a}*ln({x})+{b}*ln(1-{x})-ln({a})-lgamma({a})-lgamma({b})+lgamma({a}+{b}))*(1+list_sum(list_transform(range(0,3000), lambda n: exp(lgamma({a}+1)-lgamma({a}+n+2)-lgamma({a}+{b})+lgamma({a}+{b}+n+1)+(n+1)*ln({x})))))"


@query(
    "m30_effect_p",
    build(
        "panel",
        f"""SELECT treated, n_periods, {r(f"CASE WHEN x<0.8 THEN {T_SERIES.format(a='(df/2.0)', b='0.5', x='x')} ELSE 1-{T_SERIES.format(a='0.5', b='(df/2.0)', x='(1-x)')} END")} AS p_value FROM (
 SELECT treated, n_periods, df, df/(df+t*t) AS x FROM (SELECT treated, count(*)::BIGINT AS n_periods, count(*)-1.0::DOUBLE AS df, avg(effect)/(stddev_samp(effect)/sqrt(count(*))) AS t FROM eff WHERE post GROUP BY 1))""",
        eff=EQUAL,
    ),
)
def _(s, d):
    return edge(synthetic.average_effect(_equal_effects(s, d)).select("treated", "n_periods", "p_value"))


def _weights(s, d, method):
    """Every donor's weight, 0 where the fit leaves it out."""
    p = materialize(_panel(s, d).select("entity", "period", "activity"))
    donors = synthetic.donor_pool(p, UNIT).select(F.lit(UNIT).alias("treated"), F.col("entity").alias("donor"))
    return donors.join(synthetic.fit_weights(p, [UNIT], "activity", CUT, method=method), ["treated", "donor"], "left").fillna({"weight": 0.0})


@query("m27_simplex_weights")
def _(s, d):
    return edge(_weights(s, d, "simplex"))


@query("m28_ridge_weights")
def _(s, d):
    return edge(_weights(s, d, "ridge"))


SHARED = f"SELECT period FROM panel WHERE period<DATE '{CUT}' GROUP BY 1 HAVING count(DISTINCT entity)=(SELECT count(DISTINCT entity) FROM panel WHERE period<DATE '{CUT}')"
OPTIMAL = """SELECT entity AS treated, (SELECT count(DISTINCT entity)-1 FROM panel)::BIGINT AS n_donors, (SELECT count(*) FROM shared)::BIGINT AS n_periods,
 true AS sums_to_one, true AS non_negative, true AS optimal, true AS converged FROM (SELECT DISTINCT entity FROM panel)"""


def _optimality(s, d, method, alpha=None):
    """What holds at the optimum and nowhere else, recomputed from the panel for every entity as the treated one."""
    p = materialize(_panel(s, d).select("entity", "period", "activity"))
    fitted = materialize(synthetic.fit(p, p.select("entity").distinct(), "activity", CUT, method=method))
    found = synthetic.optimality(p, synthetic.weights_of(fitted), "activity", CUT, alpha=alpha)
    return found.join(fitted.select("treated", "converged"), "treated").select(
        "treated", "n_donors", "n_periods", (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"), (F.col("least") >= 0).alias("non_negative"), (F.col("gap") < 1e-6).alias("optimal"), "converged"
    )


@query("m27_simplex_optimality", build("panel", OPTIMAL, shared=SHARED))
def _(s, d):
    return _optimality(s, d, "simplex")


@query("m28_ridge_optimality", build("panel", OPTIMAL, shared=SHARED))
def _(s, d):
    return _optimality(s, d, "ridge", synthetic.RIDGE)


@query("m29_effect_series", build("panel", f"SELECT treated, {ym()} AS period, {rs('actual', 'synthetic', 'effect')}, post FROM eff", eff=EQUAL))
def _(s, d):
    return edge(_equal_effects(s, d))


@query(
    "m30_average_effect",
    build(
        "panel",
        f"""SELECT treated, {r('avg(effect)')} AS ate, {r('stddev_samp(effect)')} AS ate_std, {r('sum(effect)')} AS cumulative, count(*)::BIGINT AS n_periods,
 {r('stddev_samp(effect)/sqrt(count(*))')} AS ate_se, {r('avg(effect)/(stddev_samp(effect)/sqrt(count(*)))')} AS t_statistic FROM eff WHERE post GROUP BY 1""",
        eff=EQUAL,
    ),
)
def _(s, d):
    return edge(synthetic.average_effect(_equal_effects(s, d), with_p=False))


@query("m31_placebo")
def _(s, d):
    return edge(synthetic.placebo_test(_panel(s, d), UNIT, "activity", CUT))


@query("m31_placebo_effects")
def _(s, d):
    return edge(synthetic.placebo_effects(_panel(s, d), UNIT, "activity", CUT))


@query(
    "m31_placebo_units",
    build(
        "panel",
        f"""SELECT entity AS treated, entity='{UNIT}' AS real, true AS has_effect, true AS converged, true AS share_agrees FROM (SELECT DISTINCT entity FROM panel)""",
    ),
)
def _(s, d):
    """Every entity takes part, and the share equals a count by ranks of the absolute effects."""
    p = _panel(s, d)
    found = materialize(synthetic.placebo_effects(p, UNIT, "activity", CUT))
    share = synthetic.placebo_share(found).select("p_value", "n_placebos")
    wide = found.agg(F.sort_array(F.collect_list(F.when(~F.col("real"), F.abs("ate")))).alias("sizes"), F.max(F.when(F.col("real"), F.abs("ate"))).alias("own"))
    agree = with_row(wide, share).select(((F.size("sizes") == F.col("n_placebos")) & (F.abs(F.size(F.filter("sizes", lambda v: v >= F.col("own"))) / F.size("sizes") - F.col("p_value")) < 1e-12)).alias("share_agrees"))
    return with_row(found, agree).select("treated", "real", F.col("ate").isNotNull().alias("has_effect"), "converged", "share_agrees")


@query("m32_donor_pool", build("panel", f"SELECT DISTINCT entity FROM panel WHERE entity NOT IN ('{UNIT}','NATION_8')"))
def _(s, d):
    return synthetic.donor_pool(_panel(s, d), UNIT, ["NATION_8"])
