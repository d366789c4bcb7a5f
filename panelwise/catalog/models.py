"""Queries for outlier detection, clustering, attribution and pooled forecasting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelwise.catalog.registry import edge, query
from panelwise.catalog.sql import build, r, rs, ym
from panelwise.operators import anomaly, attribution, cluster, indices, pooled
from panelwise.operators.ordered import with_row
from panelwise.plans import bindings as b
from panelwise.session import materialize

# ---- outliers ----------------------------------------------------------------------------

CUSTF = ["orders", "cents", "urgent"]


def _tails(cols, src):
    parts = [
        f"greatest(l_{c}, r_{c}, CASE WHEN k_{c}<0 THEN l_{c} WHEN k_{c}>0 THEN r_{c} ELSE l_{c}+r_{c} END)" for c in cols
    ]
    ecdf = ", ".join(f"-ln(cume_dist() OVER (ORDER BY {c})) AS l_{c}, -ln(cume_dist() OVER (ORDER BY {c} DESC)) AS r_{c}" for c in cols)
    skew = ", ".join(f"sign(avg(pow({c}-m_{c},3))) AS k_{c}" for c in cols)
    mean = ", ".join(f"avg({c}) AS m_{c}" for c in cols)
    return f"SELECT entity, {'+'.join(parts)} AS raw FROM (SELECT entity, {ecdf} FROM {src}), (SELECT {skew} FROM {src}, (SELECT {mean} FROM {src}))"


SCALED = "CASE WHEN max(raw) OVER ()-min(raw) OVER () < 1e-10 THEN 0 ELSE (raw-min(raw) OVER ())/(max(raw) OVER ()-min(raw) OVER ()) END"
OUT = f"SELECT entity, {r('raw')} AS ecod_raw, {r(SCALED)} AS ecod_score, (raw>(SELECT quantile_cont(raw,0.9) FROM t))::BIGINT AS ecod_label FROM t"


@query("m17_tail_score", build("idx", OUT, t=_tails(indices.INDICES, "idx")))
def _(s, d):
    return edge(anomaly.tail_score(materialize(b.indexed(s, d))), "entity", "ecod_raw", "ecod_score", "ecod_label")


@query("m17_tail_score_customers", build("cust", OUT, t=_tails(CUSTF, "cust")))
def _(s, d):
    return edge(anomaly.tail_score(materialize(b.customer_profile(s, d)), CUSTF, small_rows=0), "entity", "ecod_raw", "ecod_score", "ecod_label")


def _ranktails(cols, src):
    rank = lambda c: f"((rank() OVER (ORDER BY {c})+(count(*) OVER (PARTITION BY {c})-1)/2::DOUBLE)/(count(*) OVER ()+1))"
    return f"SELECT entity, {'+'.join(f'greatest(-ln(u_{c}+1e-10), -ln(1-u_{c}+1e-10))' for c in cols)} AS raw FROM (SELECT entity, {', '.join(f'{rank(c)} AS u_{c}' for c in cols)} FROM {src})"


@query(
    "m18_rank_tail_score",
    build("cust", f"SELECT entity, {r('raw')} AS tail_raw, {r(SCALED)} AS tail_score, (raw>=(SELECT quantile_cont(raw,0.9) FROM t))::BIGINT AS tail_label FROM t", t=_ranktails(CUSTF, "cust")),
)
def _(s, d):
    return edge(anomaly.rank_tail_score(materialize(b.customer_profile(s, d)), CUSTF), "entity", "tail_raw", "tail_score", "tail_label")


@query("m16_isolation_forest")
def _(s, d):
    c = materialize(b.customer_profile(s, d))
    return edge(anomaly.forest_score(c, "entity", CUSTF), "entity", "forest_raw", "forest_score", "forest_label")


ENS = f"SELECT a.entity, 0.5*a.s+0.5*c.s AS e FROM (SELECT entity, {SCALED} AS s FROM t) a JOIN (SELECT entity, {SCALED} AS s FROM u) c ON a.entity=c.entity"


@query(
    "m19_ensemble",
    build(
        "cust",
        f"SELECT entity, {r('e')} AS ensemble_score, (round(e,9)>=round((SELECT quantile_cont(e,0.9) FROM ens),9))::BIGINT AS ensemble_flag, rank() OVER (ORDER BY round(e,9) DESC)::BIGINT AS severity_rank FROM ens",
        t=_tails(CUSTF, "cust"),
        u=_ranktails(CUSTF, "cust"),
        ens=ENS,
    ),
)
def _(s, d):
    c = materialize(b.customer_profile(s, d))
    both = anomaly.rank_tail_score(materialize(anomaly.tail_score(c, CUSTF)), CUSTF)
    both = both.withColumns({"ecod_score": F.round("ecod_score", 12), "tail_score": F.round("tail_score", 12)})
    return edge(anomaly.ensemble(materialize(both), "ecod_score", "tail_score"), "entity", "ensemble_score", "ensemble_flag", "severity_rank")


@query("m19_detect")
def _(s, d):
    out = anomaly.detect(materialize(b.indexed(s, d)))
    return edge(out, "entity", "forest_score", "ecod_score", "ensemble_score", "ensemble_flag", "severity_rank")


@query("i11_flags_with_ensemble")
def _(s, d):
    ix = materialize(b.indexed(s, d))
    return edge(indices.anomaly_flags(ix, anomaly.detect(ix)).orderBy(*indices.anomaly_order()), "entity", *indices.FLAGS, "ensemble_flag", "flag_count")


# ---- clustering -----------------------------------------------------------------------------


def _customer_indices(s, d):
    c = materialize(b.customer_profile(s, d))
    c = c.select(
        "entity", F.log1p("orders").alias("o"), F.log1p("cents").alias("v"), (F.col("urgent") / F.col("orders")).alias("u"), F.log1p(F.col("cents") / F.col("orders")).alias("p")
    )
    return indices.minmax(c, {"o": "maturity", "v": "pressure", "u": "volatility", "p": "predictability"}).select("entity", *indices.INDICES)


def _vectors(s, d):
    return cluster.assemble(_customer_indices(s, d), indices.INDICES)


CUSTOMERS = "SELECT count(DISTINCT o_custkey)::BIGINT AS n FROM orders"
PARAMETERS = "(k*15-1)"


@query("m10_order_selection")
def _(s, d):
    return edge(cluster.selection_table(cluster.select_and_fit(_vectors(s, d), indices.INDICES), s))


@query(
    "m10_order_penalties",
    f"""SELECT k::BIGINT AS k, {r(f'2*{PARAMETERS}')} AS aic_penalty, {r(f'{PARAMETERS}*ln(n)')} AS bic_penalty,
 {r(f'2*{PARAMETERS}+(2*{PARAMETERS}*{PARAMETERS}+2*{PARAMETERS})/(n-{PARAMETERS}-1)::DOUBLE')} AS aicc_penalty, true AS finite FROM ({CUSTOMERS}), (SELECT unnest(range(2,9)) AS k)""",
)
def _(s, d):
    """What each criterion adds to minus twice the likelihood."""
    found = cluster.selection_table(cluster.select_and_fit(_vectors(s, d), indices.INDICES), s)
    more = lambda c: (F.col(c) + 2 * F.col("log_likelihood")).alias(f"{c}_penalty")
    return edge(found.select("k", more("aic"), more("bic"), more("aicc"), (F.abs("log_likelihood") < float("inf")).alias("finite")))


@query("m11_anchored_labels")
def _(s, d):
    v = _vectors(s, d)
    out = cluster.assign(v, cluster.select_and_fit(v, indices.INDICES))
    return edge(out.select("entity", "cluster", "cluster_name", F.array_join(F.transform("probabilities", lambda p: F.format_number(p, 6)), " ").alias("probabilities")))


@query("m11_label_checks", "SELECT o_custkey AS entity, true AS sums_to_one, true AS most_likely, true AS anchored FROM orders GROUP BY 1")
def _(s, d):
    """Each label is the most likely one, and the anchor's means fall with the label."""
    v = _vectors(s, d)
    mix = cluster.select_and_fit(v, indices.INDICES)
    falls = bool((np.diff(mix.means[:, 0]) <= 0).all())
    total = F.aggregate("probabilities", F.lit(0.0), lambda acc, p: acc + p)
    own = F.get("probabilities", F.col("cluster"))
    return cluster.assign(v, mix).select("entity", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (own == F.array_max("probabilities")).alias("most_likely"), F.lit(falls).alias("anchored"))


MU = np.array([[0.5, 0.4, -0.2, 0.1], [-0.6, -0.3, 0.2, 0.0]])
COV = np.array([np.eye(4) * 0.8 + 0.1, np.eye(4) * 1.2 - 0.05])


def _dist_sql(k):
    inv = np.linalg.inv(COV[k] + np.eye(4) * 1e-6)
    z = [f"(z_{c}-({MU[k][i]}))" for i, c in enumerate(indices.INDICES)]
    return "sqrt(greatest(0," + "+".join(f"{z[i]}*({inv[i, j]!r})*{z[j]}" for i in range(4) for j in range(4)) + "))"


@query(
    "m12_mahalanobis",
    build(
        "idx",
        f"SELECT entity, {r(f'CASE WHEN z_maturity>=0 THEN {_dist_sql(0)} ELSE {_dist_sql(1)} END').replace('np.float64', '')} AS distance FROM z",
        z="SELECT entity, " + ", ".join(f"({c}-avg({c}) OVER ())/(stddev_pop({c}) OVER ()) AS z_{c}" for c in indices.INDICES) + " FROM idx",
    ),
)
def _(s, d):
    z = indices.zscore(b.indexed(s, d), {c: f"z_{c}" for c in indices.INDICES})
    k = F.when(F.col("z_maturity") >= 0, F.lit(0)).otherwise(F.lit(1))
    return edge(z.select("entity", cluster.mahalanobis(k, [f"z_{c}" for c in indices.INDICES], MU, COV).alias("distance")))


@query("m13_profile_names")
def _(s, d):
    v = _vectors(s, d)
    mix = cluster.select_and_fit(v, indices.INDICES)
    return edge(cluster.centroids(cluster.assign(v, mix), mix, _customer_indices(s, d)))


@query("m14_projection")
def _(s, d):
    return edge(cluster.project_2d(_vectors(s, d)), "entity", "x_1", "x_2")


@query("m15_cluster_run")
def _(s, d):
    out = cluster.run(_customer_indices(s, d))["clustered"]
    return edge(out, "entity", "cluster", "cluster_name", "mahalanobis", "x_1", "x_2")


@query("m15_cluster_summary")
def _(s, d):
    return edge(cluster.run(_customer_indices(s, d))["summary"])


@query("m15_cluster_outputs", f"SELECT n AS clustered, n AS in_summary, n AS in_centroids, 7::BIGINT AS orders_tried, true AS least_chosen FROM ({CUSTOMERS})")
def _(s, d):
    """Sizes of all outputs, and whether the order with the least AICc was taken."""
    out = cluster.run(_customer_indices(s, d))
    picked = out["selection"].agg(F.count(F.lit(1)).alias("orders_tried"), F.min_by("k", "aicc").alias("k"))
    parts = [out["clustered"].agg(F.count("cluster").alias("clustered")), out["summary"].agg(F.sum("size").alias("in_summary")), out["centroids"].agg(F.sum("size").alias("in_centroids"), F.count(F.lit(1)).alias("held"))]
    row = picked
    for part in parts:
        row = with_row(row, part)
    return row.select("clustered", "in_summary", "in_centroids", "orders_tried", (F.col("k") == F.col("held")).alias("least_chosen"))


@query(
    "a30_cluster_summary",
    build("idx", f"SELECT label, count(*)::BIGINT AS size, {r('quantile_cont(volatility,0.5)')} AS median FROM idx GROUP BY 1"),
)
def _(s, d):
    from panelwise.operators.ordered import group_quantiles

    ix = materialize(b.indexed(s, d))
    med = group_quantiles(ix, "volatility", "label", [0.5]).select("label", F.col("quantiles")[0].alias("median"))
    return edge(ix.groupBy("label").agg(F.count(F.lit(1)).alias("size")).join(med, "label"))


# ---- attribution ------------------------------------------------------------------------------


def _focus(s, d):
    return materialize(indices.focus_summary(indices.anomaly_flags(materialize(b.indexed(s, d)))))


@query("m20_surrogate_fit")
def _(s, d):
    model, used, x = attribution.fit_surrogate(_focus(s, d))
    return edge(model.transform(x), "entity", "label", "prediction")


@query("m21_attributions")
def _(s, d):
    fitted = attribution.fit_surrogate(_focus(s, d))
    out = attribution.attribute(fitted, s)
    return edge(out.select("entity", "base", "prediction", *[F.col("contributions")[i].alias(f"phi_{n}") for i, n in enumerate(fitted[1])]))


IMP = {n: round(1.0 / (i + 2), 6) for i, n in enumerate(attribution.FEATURES)}
PHI = "SELECT entity, " + ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER ()>0 THEN {v}*({c}-avg({c}) OVER ())/(stddev_pop({c}) OVER ()) ELSE 0 END AS phi_{c}" for c, v in IMP.items()
) + " FROM profile"
# active_periods may be nearly constant; all columns are kept in both engines


@query("m22_importance_attribution", build("profile", "SELECT entity, " + rs(*[f"phi_{c}" for c in IMP]) + " FROM phi", phi=PHI))
def _(s, d):
    out = attribution.attribute_by_importance(materialize(b.profile(s, d)), IMP)
    return edge(out.select("entity", *[F.col("contributions")[i].alias(f"phi_{c}") for i, c in enumerate(IMP)]))


LONG = " UNION ALL ".join(f"SELECT entity, '{c}' AS feature, phi_{c} AS v FROM phi" for c in IMP)


@query(
    "m23_global_importance",
    build("profile", f"SELECT feature, {r('m')} AS mean_abs, {r('100*m/(sum(m) OVER ()+1e-10)')} AS importance_pct FROM (SELECT feature, avg(abs(v)) AS m FROM long GROUP BY 1)", phi=PHI, long=LONG),
)
def _(s, d):
    out = attribution.attribute_by_importance(materialize(b.profile(s, d)), IMP)
    return edge(attribution.global_importance(out, list(IMP)))


TOP3 = "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(v) DESC) AS k FROM long"


@query(
    "t3_top_features",
    build(
        "profile",
        f"SELECT entity, {r('sum(v)')} AS contribution_sum, " + ", ".join(f"max(feature) FILTER (k={j}) AS top_{j}_feature, {r(f'max(v) FILTER (k={j})')} AS top_{j}_value" for j in (1, 2, 3)) + " FROM ranked GROUP BY 1",
        phi=PHI,
        long=LONG,
        ranked=TOP3,
    ),
)
def _(s, d):
    out = attribution.attribute_by_importance(materialize(b.profile(s, d)), IMP)
    return edge(attribution.top_features(out, list(IMP)))


@query("r5_attribution_job")
def _(s, d):
    return edge(attribution.run(_focus(s, d))["attribution"])


# ---- pooled forecasting --------------------------------------------------------------------------

FEAT_D = ("month_sin", "month_cos", "mean_3", "std_3", "mean_6", "std_6", "mean_12", "std_12", "period_mean", "period_gap", "entity_mean", "entity_gap")


@query(
    "m24_panel_features",
    build(
        "panel",
        f"""SELECT entity, {ym()} AS period, entity_code, month, quarter, year, trend, {rs(*FEAT_D)}, lag_1::DOUBLE AS lag_1, lag_12::DOUBLE AS lag_12 FROM (
 SELECT entity, period, (dense_rank() OVER (ORDER BY entity)-1)::BIGINT AS entity_code, month(period)::BIGINT AS month, quarter(period)::BIGINT AS quarter, year(period)::BIGINT AS year,
 sin(2*pi()*month(period)/12) AS month_sin, cos(2*pi()*month(period)/12) AS month_cos, (row_number() OVER w-1)::BIGINT AS trend, lag(b_total,1) OVER w AS lag_1, lag(b_total,12) OVER w AS lag_12,
 """
        + ", ".join(f"avg(b_total) OVER (PARTITION BY entity ORDER BY period ROWS {k - 1} PRECEDING) AS mean_{k}, stddev_samp(b_total) OVER (PARTITION BY entity ORDER BY period ROWS {k - 1} PRECEDING) AS std_{k}" for k in (3, 6, 12))
        + """, avg(b_total) OVER (PARTITION BY period) AS period_mean, b_total-avg(b_total) OVER (PARTITION BY period) AS period_gap, avg(b_total) OVER (PARTITION BY entity) AS entity_mean,
 b_total-avg(b_total) OVER (PARTITION BY entity) AS entity_gap FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period))""",
    ),
)
def _(s, d):
    p = materialize(b.panel(s, d).select("entity", "period", "b_total"))
    f = pooled.panel_features(p, "b_total").withColumns({c: F.col(c).cast("double") for c in ("lag_1", "lag_12")})
    return edge(f, "entity", "period", "entity_code", "month", "quarter", "year", "trend", *FEAT_D, "lag_1", "lag_12")


def _values(s, d):
    return materialize(b.panel(s, d).select("entity", "period", F.col("b_total").cast("double").alias("value")))


@query("m25_cross_validation")
def _(s, d):
    return edge(pooled.cross_validate(pooled.training_rows(_values(s, d))))


@query("m25_pooled_forecast")
def _(s, d):
    v = _values(s, d)
    return edge(pooled.forecast(v, pooled.fit(pooled.training_rows(v))))


@query(
    "m25_forecast_keys",
    build(
        "panel",
        """SELECT entity, strftime(period,'%Y-%m') AS period, true AS finite, true AS adds_up FROM (
 SELECT entity, (max(period)+to_months(step::INT))::DATE AS period FROM panel, (SELECT unnest(range(1,13)) AS step) GROUP BY entity, step
 UNION SELECT 'National', (last+to_months(step::INT))::DATE FROM (SELECT max(period) AS last FROM panel GROUP BY entity), (SELECT unnest(range(1,13)) AS step))""",
    ),
)
def _(s, d):
    """Every entity has all its months, and the total is the sum of its parts."""
    v = _values(s, d)
    out = materialize(pooled.forecast(v, pooled.fit(pooled.training_rows(v))))
    parts = out.where("entity <> 'National'").groupBy("period").agg(F.sum("forecast").alias("parts"))
    checked = out.join(parts, "period").withColumn("adds_up", (F.col("entity") != "National") | (F.abs(F.col("forecast") - F.col("parts")) < 1e-6 * (1 + F.abs("parts"))))
    return checked.select("entity", F.date_format("period", "yyyy-MM").alias("period"), (F.abs("forecast") < float("inf")).alias("finite"), "adds_up")


@query(
    "m25_fold_rows",
    build(
        "panel",
        """SELECT fold, count(*)::BIGINT AS rows, strftime(min(period),'%Y-%m') AS test_from, strftime(max(period),'%Y-%m') AS test_to FROM (
 SELECT *, 2-((n-1-pos)//(n//4)) AS fold FROM (
  SELECT period, dense_rank() OVER (ORDER BY period)-1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS k FROM panel) WHERE k>12),
  (SELECT count(DISTINCT period) AS n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS k FROM panel) WHERE k>12))
 WHERE fold>=0 GROUP BY 1""",
    ),
)
def _(s, d):
    found = pooled.cross_validate(pooled.training_rows(_values(s, d)))
    return edge(found.where("rmse >= mae AND trees >= 1").select("fold", "rows", "test_from", "test_to")).withColumns({c: F.substring(c, 1, 7) for c in ("test_from", "test_to")})


@query("m26_model_importance")
def _(s, d):
    v = _values(s, d)
    return edge(pooled.importance(pooled.fit(pooled.training_rows(v)), s))
