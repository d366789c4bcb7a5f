"""Queries for data quality, drift and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.registry import edge, query
from panelwise.catalog.sql import build, r, rs
from panelwise.functions.fixed import EFFECTS, LEVERS, PRESETS, SENSITIVITY
from panelwise.operators import drift, indices, quality, scenario, stats
from panelwise.operators.ordered import with_row
from panelwise.plans import bindings as b
from panelwise.session import materialize

# ---- scenarios -------------------------------------------------------------------------


def _sens(family):
    floor, off, sign, index = SENSITIVITY[family]
    return f"greatest({floor}, {off}{'+' if sign > 0 else '-'}{index})"


def _effect(target):
    return "(" + "+".join(f"{m}*(1-exp(-{k}*{lever}/100))*{_sens(f)}" for lever, m, k, f in EFFECTS[target]) + ")"


DELTAS = ", ".join(f"round({'-' if i == 'volatility' else ''}{_effect(i)},4) AS delta_{i}" for i in indices.INDICES) + f", round(1+{_effect('demand')},4) AS demand_multiplier"
NEWS = ", ".join(f"greatest(0,least(1,{i}+delta_{i})) AS new_{i}" for i in indices.INDICES)
PRESET_VALUES = "SELECT * FROM (VALUES " + ", ".join("('" + a + "'," + ",".join(f"{x}::DOUBLE" for x in v) + ")" for a, v in PRESETS.items()) + ") p(action," + ",".join(LEVERS) + ")"
SCORED = f"SELECT *, {NEWS} FROM (SELECT idx.*, {DELTAS} FROM idx JOIN presets USING (action))"
SC_OUT = tuple(f"delta_{i}" for i in indices.INDICES) + tuple(f"new_{i}" for i in indices.INDICES) + ("demand_multiplier",)


@query("p21_scenario_presets", build("idx", f"SELECT entity, {rs(*SC_OUT)} FROM scored", presets=PRESET_VALUES, scored=SCORED))
def _(s, d):
    return edge(scenario.score(scenario.with_presets(b.indexed(s, d))), "entity", *SC_OUT)


CASES = [("drive", {"enrollment_drive": 50.0, "fee_waiver": 20.0}), ("capacity", {"infrastructure_investment": 60.0, "operator_training": 30.0, "seasonal_uniformity": 80.0})]
CASE_VALUES = "SELECT * FROM (VALUES " + ", ".join(f"('{n}'," + ",".join(f"{c.get(k, 0.0)}::DOUBLE" for k in LEVERS) + ")" for n, c in CASES) + ") p(scenario," + ",".join(LEVERS) + ")"
SCORED2 = f"SELECT *, {NEWS} FROM (SELECT idx.*, scenario, {DELTAS} FROM idx, cases)"


@query("p21_scenario_grid", build("idx", f"SELECT entity, scenario, {rs(*SC_OUT)} FROM scored", cases=CASE_VALUES, scored=SCORED2))
def _(s, d):
    return edge(scenario.score(scenario.with_scenarios(b.indexed(s, d), CASES)), "entity", "scenario", *SC_OUT)


IMPACT = " UNION ALL ".join(f"SELECT entity, '{i}' AS indicator, {i} AS baseline, new_{i} AS simulated, new_{i}-{i} AS delta FROM scored" for i in indices.INDICES)


@query(
    "p24_impact_table",
    build(
        "idx",
        f"SELECT entity, indicator, {rs('baseline', 'simulated', 'delta')}, CASE WHEN delta>0.001 THEN 'up' WHEN delta<-0.001 THEN 'down' ELSE 'unchanged' END AS direction FROM impact",
        presets=PRESET_VALUES,
        scored=SCORED,
        impact=IMPACT,
    ),
)
def _(s, d):
    return edge(scenario.impact_table(scenario.score(scenario.with_presets(b.indexed(s, d)))), "entity", "indicator", "baseline", "simulated", "delta", "direction")


# ---- quality ------------------------------------------------------------------------------


@query(
    "v1_schema_report",
    "SELECT 'orders' AS dataset, c AS check_name, ok AS success, k AS details, (SELECT count(*) FROM orders)::BIGINT AS rows FROM (VALUES ('has_o_orderkey', true, 'bigint'), ('o_orderkey_is_bigint', true, 'bigint'),"
    " ('has_o_totalprice', true, 'double'), ('o_totalprice_is_bigint', false, 'double'), ('has_registrar', false, 'missing')) t(c, ok, k)",
)
def _(s, d):
    o = b.table(s, d, "orders")
    report = quality.schema_report(o, "orders", {"o_orderkey": "bigint", "o_totalprice": "bigint", "registrar": "string"})
    return with_row(report, o.agg(F.count(F.lit(1)).alias("rows")))


@query(
    "v2_value_range",
    "SELECT 'customer' AS dataset, 'c_acctbal_in_range' AS check_name, count(*) FILTER (c_acctbal<0 OR c_acctbal>9000)=0 AS success, count(*) FILTER (c_acctbal<0 OR c_acctbal>9000)::BIGINT AS violations FROM customer"
    " UNION ALL SELECT 'customer','c_custkey_in_range', count(*) FILTER (c_custkey<1)=0, count(*) FILTER (c_custkey<1) FROM customer",
)
def _(s, d):
    return quality.run_checks(b.table(s, d, "customer"), "customer", [quality.in_range("c_acctbal", 0, 9000), quality.in_range("c_custkey", 1)])


@query(
    "v3_not_null",
    "SELECT 'orders' AS dataset, c||'_not_null' AS check_name, n=0 AS success, n AS violations FROM (SELECT 'o_custkey' AS c, count(*) FILTER (o_custkey IS NULL)::BIGINT AS n FROM orders UNION ALL SELECT 'open_price', count(*) FILTER (o_orderstatus<>'O') FROM orders)",
)
def _(s, d):
    o = b.table(s, d, "orders").withColumn("open_price", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))
    return quality.run_checks(o, "orders", [quality.not_null("o_custkey"), quality.not_null("open_price")])


@query(
    "v4_unique",
    "SELECT 'lineitem' AS dataset, c AS check_name, n=0 AS success, n AS violations FROM (SELECT 'line_unique' AS c, (count(*)-(SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT AS n FROM lineitem UNION ALL SELECT 'l_orderkey_unique', (count(*)-count(DISTINCT l_orderkey))::BIGINT FROM lineitem)",
)
def _(s, d):
    li = b.table(s, d, "lineitem")
    return quality.run_checks(li, "lineitem", [quality.unique(["l_orderkey", "l_linenumber"], "line_unique"), quality.unique(["l_orderkey"])])


@query(
    "v5_date_range",
    "SELECT 'orders' AS dataset, 'o_orderdate_in_range' AS check_name, n=0 AS success, n AS violations FROM (SELECT count(*) FILTER (o_orderdate::DATE<DATE '1996-01-01' OR o_orderdate::DATE>DATE '2001-01-01')::BIGINT AS n FROM orders)",
)
def _(s, d):
    o = b.table(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return quality.run_checks(o, "orders", [quality.date_range("o_orderdate", "1996-01-01", "2001-01-01")])


@query(
    "v6_all_non_negative",
    "SELECT 'supplier' AS dataset, c||'_non_negative' AS check_name, n=0 AS success, n AS violations FROM (SELECT 's_suppkey' AS c, count(*) FILTER (s_suppkey<0)::BIGINT AS n FROM supplier UNION ALL SELECT 's_nationkey', count(*) FILTER (s_nationkey<0) FROM supplier UNION ALL SELECT 's_acctbal', count(*) FILTER (s_acctbal<0) FROM supplier)",
)
def _(s, d):
    t = b.table(s, d, "supplier")
    return quality.run_checks(t, "supplier", quality.all_non_negative(t))


@query("v7_index_bounds", build("idx", " UNION ALL ".join(f"SELECT 'profile' AS dataset, '{i}_in_range' AS check_name, count(*) FILTER ({i}<0 OR {i}>1)=0 AS success, count(*) FILTER ({i}<0 OR {i}>1)::BIGINT AS violations FROM idx" for i in indices.INDICES)))
def _(s, d):
    return quality.run_checks(b.indexed(s, d), "profile", quality.index_bounds(indices.INDICES))


@query(
    "v8_time_series_checks",
    build(
        "panel",
        """SELECT entity, quantile_cont(g,0.5)::DOUBLE AS median_gap, max(g)::BIGINT AS max_gap, max(g)>3*quantile_cont(g,0.5) AS large_gaps, 0::BIGINT AS duplicate_dates, true AS no_duplicates
 FROM (SELECT entity, date_diff('day', lag(period) OVER (PARTITION BY entity ORDER BY period), period) AS g FROM panel) GROUP BY 1""",
    ),
)
def _(s, d):
    return stats.gap_statistics(b.panel(s, d), "period", ["entity"]).select("entity", "median_gap", "max_gap", "large_gaps", "duplicate_dates", "no_duplicates")


@query(
    "v8_dates_sorted",
    "SELECT event_type, count(*) FILTER (d<p)=0 AS dates_sorted FROM (SELECT event_type, ts::DATE AS d, lag(ts::DATE) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY 1"
    " UNION ALL SELECT 'by time', count(*) FILTER (d<p)=0 FROM (SELECT ts::DATE AS d, lag(ts::DATE) OVER (ORDER BY ts) AS p FROM events)",
)
def _(s, d):
    e = b.table(s, d, "events").select("event_id", "event_type", "ts", F.col("ts").cast("date").alias("date"))
    by_id = stats.sorted_flag(e, "date", "event_id", ["event_type"])
    by_time = stats.sorted_flag(e.withColumn("event_type", F.lit("by time")), "date", "ts", ["event_type"])
    return by_id.unionByName(by_time)


@query(
    "v9_validation_report",
    build(
        "idx",
        "SELECT dataset, count(*)::BIGINT AS checks, count(*) FILTER (ok)::BIGINT AS passed, "
        + r("count(*) FILTER (ok)/count(*)::DOUBLE")
        + " AS rate FROM (SELECT 'supplier' AS dataset, count(*) FILTER (s_suppkey<0)=0 AS ok FROM supplier UNION ALL SELECT 'supplier', count(*) FILTER (s_nationkey<0)=0 FROM supplier UNION ALL SELECT 'supplier', count(*) FILTER (s_acctbal<0)=0 FROM supplier"
        + "".join(f" UNION ALL SELECT 'profile', count(*) FILTER ({i}<0 OR {i}>1)=0 FROM idx" for i in indices.INDICES)
        + ") GROUP BY 1",
    ),
)
def _(s, d):
    t = b.table(s, d, "supplier")
    report = stats.union_all(
        [quality.run_checks(t, "supplier", quality.all_non_negative(t)), quality.run_checks(b.indexed(s, d), "profile", quality.index_bounds(indices.INDICES))]
    )
    return edge(quality.success_rate(quality.as_report(report)))


def _contract(s, d):
    c = b.table(s, d, "customer").select(
        F.when(F.col("c_custkey") % 11 == 0, F.lit("x?")).otherwise(F.col("c_custkey").cast("string")).alias("k"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("name"),
        F.col("c_acctbal").cast("string").alias("bal"),
    )
    return quality.apply_contract(c, [quality.Rule("k", "bigint", False, 0), quality.Rule("name", "string", False), quality.Rule("bal", "double", True, 0)])


@query("v10_contract_valid", f"SELECT c_custkey AS k, c_name AS name, {r('c_acctbal')} AS bal FROM customer WHERE c_custkey%11<>0 AND c_custkey%13<>0 AND c_acctbal>=0")
def _(s, d):
    return edge(_contract(s, d)[0])


@query(
    "v10_contract_quarantine",
    "SELECT c_name AS name, concat_ws('; ', CASE WHEN c_custkey%11=0 THEN 'k: not bigint' END, CASE WHEN c_custkey%13=0 THEN 'name: null' END, CASE WHEN c_acctbal<0 THEN 'bal: below 0' END) AS reasons FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey%13<>0 THEN c_name END AS c_name FROM customer) WHERE c_custkey%11=0 OR c_custkey%13=0 OR c_acctbal<0",
)
def _(s, d):
    return _contract(s, d)[1].select("name", F.concat_ws("; ", "violations").alias("reasons"))


# ---- drift ---------------------------------------------------------------------------------

HALF = "TIMESTAMP '2024-01-16 00:00:00'"


def _halves(s, d):
    e = b.table(s, d, "events").withColumn("hour", F.hour("ts").cast("double"))
    cut = F.lit("2024-01-16").cast("timestamp")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)


POOL = f"""SELECT 'value' AS feature, value::DOUBLE AS v, (ts>={HALF})::INT AS side FROM events UNION ALL
 SELECT 'user_id', user_id::DOUBLE, (ts>={HALF})::INT FROM events"""
FEATURES = ["value", "user_id"]


def _pool(s, d):
    return drift.pooled(*_halves(s, d), FEATURES)


KSQ = f"""SELECT feature, {r('max(abs(fr-fc))')} AS ks, max(nr)::BIGINT AS n_ref, max(nc)::BIGINT AS n_cur FROM (SELECT feature,
 sum(cr) OVER (PARTITION BY feature ORDER BY v)/(sum(cr) OVER (PARTITION BY feature))::DOUBLE AS fr, sum(cr) OVER (PARTITION BY feature) AS nr,
 sum(cc) OVER (PARTITION BY feature ORDER BY v)/(sum(cc) OVER (PARTITION BY feature))::DOUBLE AS fc, sum(cc) OVER (PARTITION BY feature) AS nc
 FROM (SELECT feature, v, count(*) FILTER (side=0) AS cr, count(*) FILTER (side=1) AS cc FROM pool GROUP BY 1,2)) GROUP BY 1"""


@query("q1_ks_distance", build("", KSQ, pool=POOL))
def _(s, d):
    return edge(drift.ks_distance(_pool(s, d)))


@query("q1_ks_distance_bucketed", build("", KSQ, pool=POOL))
def _(s, d):
    return edge(drift.ks_distance(_pool(s, d), small_rows=0))


KS_RAW = KSQ.replace(r("max(abs(fr-fc))"), "max(abs(fr-fc))")
KS_P = f"""SELECT feature, {r('ks')} AS ks, n_ref, n_cur, {r('least(1,greatest(0,2*list_sum(list_transform(range(1,101), lambda k: (CASE WHEN k%2=1 THEN 1 ELSE -1 END)*exp(-2*k*k*d*d*n_ref*n_cur/(n_ref+n_cur)::DOUBLE)))))')} AS p_value, 'asymptotic' AS p_method
 FROM (SELECT feature, ks, ks AS d, n_ref, n_cur FROM ksq)"""


@query("q1_ks_asymptotic", build("", KS_P, pool=POOL, ksq=KS_RAW))
def _(s, d):
    return edge(drift.covariate_drift(_pool(s, d), method="asymptotic").select("feature", "ks", "n_ref", "n_cur", "p_value", "p_method"))


@query("q1_ks_test")
def _(s, d):
    return edge(drift.covariate_drift(_pool(s, d)))


def _bins(k, top):
    return f"""SELECT feature, bin, count(v) FILTER (side=0) AS cr, count(v) FILTER (side=1) AS cc, any_value(nr) AS nr, any_value(nc) AS nc FROM
 (SELECT feature, nr, nc, lo, (hi-lo)/{k} AS w, unnest(range({k})) AS bin FROM (SELECT feature, min(v) AS lo, max(v)+{top} AS hi, count(*) FILTER (side=0) AS nr, count(*) FILTER (side=1) AS nc FROM pool GROUP BY 1)) g
 LEFT JOIN (SELECT pool.feature AS f, v, side, least({k}-1, floor((v-lo2)/((hi2-lo2)/{k}))::BIGINT) AS b FROM pool JOIN (SELECT feature, min(v) AS lo2, max(v)+{top} AS hi2 FROM pool GROUP BY 1) e ON e.feature=pool.feature) x
 ON f=feature AND b=bin GROUP BY 1,2"""


PSI1 = f"SELECT feature, {r('sum((q-p)*ln(q/p))')} AS psi FROM (SELECT feature, (cr+1e-4)/(nr+1e-3) AS p, (cc+1e-4)/(nc+1e-3) AS q FROM bins) GROUP BY 1"


@query("q2_psi_equal_width", build("", PSI1, pool=POOL, bins=_bins(10, "1e-10")))
def _(s, d):
    return edge(drift.psi_equal_width(_pool(s, d)))


PSI2 = f"""SELECT feature, {r('sum((q-p)*ln(q/p))')} AS psi FROM (SELECT feature, bin, greatest(count(*) FILTER (side=0)/any_value(nr)::DOUBLE,1e-10) AS p,
 greatest(count(*) FILTER (side=1)/any_value(nc)::DOUBLE,1e-10) AS q FROM (SELECT pool.*, nr, nc, len(list_filter(edges, lambda e: e<=v)) AS bin FROM pool JOIN (
 SELECT feature, count(*) FILTER (side=0) AS nr, count(*) FILTER (side=1) AS nc, list_distinct(list_slice(list_sort(list_distinct(quantile_cont(v,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) FILTER (side=0))),2,
 len(list_distinct(quantile_cont(v,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) FILTER (side=0)))-1)) AS edges FROM pool GROUP BY 1) c USING (feature)) GROUP BY 1,2) GROUP BY 1"""


@query("q3_psi_quantile", build("", PSI2, pool=POOL))
def _(s, d):
    return edge(drift.psi_quantile(_pool(s, d)))


CHI_COUNTS = f"SELECT event_type AS c, count(*) FILTER (ts<{HALF}) AS o0, count(*) FILTER (ts>={HALF}) AS o1 FROM events GROUP BY 1"
CHI = f"""SELECT 'event_type' AS feature, {r('sum(pow(o0-(o0+o1)*t0/(t0+t1)::DOUBLE,2)/((o0+o1)*t0/(t0+t1)::DOUBLE)+pow(o1-(o0+o1)*t1/(t0+t1)::DOUBLE,2)/((o0+o1)*t1/(t0+t1)::DOUBLE))')} AS chi2,
 (count(*)-1)::BIGINT AS dof FROM cnt, (SELECT sum(o0) AS t0, sum(o1) AS t1 FROM cnt)"""


@query("q4_chi_square", build("", CHI, cnt=CHI_COUNTS))
def _(s, d):
    return edge(drift.chi_square(*_halves(s, d), ["event_type"], with_p=False))


#: upper chi-square tail by the all-positive series of the lower incomplete gamma function
CHI_P = f"""SELECT feature, chi2, dof, {r('CASE WHEN dof=0 THEN 1 ELSE 1-list_sum(list_transform(range(0,1000), lambda k: exp((dof/2.0+k)*ln(greatest(chi2,1e-300)/2)-chi2/2-lgamma(dof/2.0+k+1)))) END')} AS p_value FROM chi"""


@query("q4_chi_square_p", build("", CHI_P, cnt=CHI_COUNTS, chi=CHI))
def _(s, d):
    return edge(drift.chi_square(*_halves(s, d), ["event_type"]))


JS = f"""SELECT feature, {r('sqrt(greatest(0,sum(CASE WHEN p>0 THEN p*ln(p/((p+q)/2)) ELSE 0 END+CASE WHEN q>0 THEN q*ln(q/((p+q)/2)) ELSE 0 END)/2))')} AS js
 FROM (SELECT feature, cr/nr::DOUBLE AS p, cc/nc::DOUBLE AS q FROM bins) GROUP BY 1"""


@query("q5_js_distance", build("", JS, pool=POOL, bins=_bins(50, "0")))
def _(s, d):
    return edge(drift.js_distance(_pool(s, d)))


SEV = """SELECT entity, CASE WHEN x<0.1 THEN 'none' WHEN x<0.2 THEN 'moderate' ELSE 'severe' END AS psi_band, CASE WHEN x<0.1 THEN 'none' WHEN x<0.3 THEN 'moderate' ELSE 'severe' END AS js_band,
 CASE WHEN x>0.1 THEN 'none' WHEN x>0.01 THEN 'moderate' ELSE 'severe' END AS p_band, CASE WHEN x<0.1 THEN 'stable' WHEN x<0.25 THEN 'warning' ELSE 'critical' END AS score_band FROM (SELECT entity, volatility/2 AS x FROM idx)"""


@query("q6_severity_bands", build("idx", SEV))
def _(s, d):
    x = F.col("volatility") / 2
    return b.indexed(s, d).select(
        "entity", drift.severity_psi(x).alias("psi_band"), drift.severity_js(x).alias("js_band"), drift.severity_p(x).alias("p_band"), drift.severity_psi_score(x).alias("score_band")
    )


@query("q7_monitor")
def _(s, d):
    return edge(drift.monitor(*_halves(s, d), FEATURES, ["event_type"]))


def _history(s, d):
    """Two runs appended to a history table below the shared folder."""
    from panelwise.session import scratch_path

    path = scratch_path(s, "drift-history")
    base, cur = _halves(s, d)
    for name, at, part in (("first", "2024-02-01 00:00:00", cur), ("second", "2024-02-02 00:00:00", cur.withColumn("value", F.col("value") * 2))):
        drift.append_history(drift.monitor(base, part, ["value"], ["event_type"]), path, name, at)
    return s.read.parquet(path)


@query("q8_history_report")
def _(s, d):
    return edge(_history(s, d).select("run", *drift.REPORT))


@query("q9_retrain_decision")
def _(s, d):
    return edge(drift.should_retrain(_history(s, d)))


POOLS = f"""SELECT 'first' AS run, feature, v, side FROM pool UNION ALL SELECT 'second', feature, CASE WHEN feature='value' AND side=1 THEN v*2 ELSE v END, side FROM pool"""
RUNS = PSI2.replace("SELECT feature, (CASE", "SELECT run, feature, (CASE", 1).replace("FROM pool JOIN", "FROM pools pool JOIN").replace("SELECT feature, bin,", "SELECT run, feature, bin,").replace(
    "SELECT feature, count(*) FILTER (side=0) AS nr", "SELECT run, feature, count(*) FILTER (side=0) AS nr"
).replace("FROM pool GROUP BY 1)", "FROM pools GROUP BY 1,2)").replace("USING (feature)) GROUP BY 1,2) GROUP BY 1", "USING (run,feature)) GROUP BY 1,2,3) GROUP BY 1,2")
RUN_ROWS = "SELECT run, feature, psi, psi>0.1 AS drift_detected, CASE WHEN psi<0.1 THEN 'none' WHEN psi<0.2 THEN 'moderate' ELSE 'severe' END AS severity FROM runs"


def _psi_history(s, d):
    """Two runs of the stability index alone, appended to a history table."""
    from panelwise.session import scratch_path

    path = scratch_path(s, "psi-history")
    base, cur = _halves(s, d)
    for name, at, part in (("first", "2024-02-01 00:00:00", cur), ("second", "2024-02-02 00:00:00", cur.withColumn("value", F.col("value") * 2))):
        psi = drift.psi_quantile(drift.pooled(base, part, FEATURES))
        report = psi.select("feature", "psi", (F.col("psi") > drift.PSI_LIMIT).alias("drift_detected"), drift.severity_psi(F.col("psi")).alias("severity"))
        drift.append_history(report, path, name, at)
    return s.read.parquet(path)


@query("q8_history_psi", build("", RUN_ROWS, pool=POOL, pools=POOLS, runs=RUNS))
def _(s, d):
    return edge(_psi_history(s, d), "run", "feature", "psi", "drift_detected", "severity")


@query(
    "q9_retrain_psi",
    build("", "SELECT 'second' AS run, 100*count(*) FILTER (drift_detected)/count(*)::DOUBLE AS drifted_pct, 100*count(*) FILTER (drift_detected)/count(*)>=20 AS retrain FROM rws WHERE run='second'", pool=POOL, pools=POOLS, runs=RUNS, rws=RUN_ROWS),
)
def _(s, d):
    return edge(drift.should_retrain(_psi_history(s, d)))


@query("q10_baseline_check")
def _(s, d):
    from panelwise.operators.anomaly import tail_score

    old = materialize(b.indexed(s, d))
    shifted = old.withColumn("maturity", F.least(F.lit(1.0), F.col("maturity") + 0.3))
    x, y = tail_score(old).withColumnRenamed("ecod_score", "ensemble_score"), tail_score(shifted).withColumnRenamed("ecod_score", "ensemble_score")
    return edge(drift.baseline_check(x, y, indices.INDICES))
