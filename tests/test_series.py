import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.operators import causal, forecast, pooled, stats, synthetic
from panelwise.session import materialize


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def series(spark, table):
    rows = [(e, month(i), float(v)) for e, values in table.items() for i, v in enumerate(values)]
    return materialize(spark.createDataFrame(rows, "entity string, period date, y double"))


def test_error_metrics(spark):
    rows = [("x", 100.0, 110.0), ("x", 200.0, 190.0), ("x", 300.0, 310.0), ("z", 0.0, 1.0), ("z", 0.0, 2.0), ("p", 5.0, 5.0), ("m", 0.0, 1.0), ("m", 10.0, 5.0)]
    got = stats.error_metrics(spark.createDataFrame(rows, "k string, a double, f double"), "a", "f", ["k"]).toPandas().set_index("k")
    assert got.loc["x", "mape"] == pytest.approx(100 * (0.1 + 0.05 + 1 / 30) / 3)
    assert np.isnan(got.loc["z", "mape"]) and got.loc["p", "mape"] == 0 and got.loc["m", "mape"] == 50
    assert got.loc["x", "rmse"] == 10 and got.loc["x", "mae"] == 10


def test_forecast_of_every_short_length(spark):
    table = {f"n{n:02d}": np.arange(1, n + 1) * 10.0 for n in range(1, 13)}
    fc, summary = forecast.run_trend(series(spark, table), "y", horizon=3)
    s = summary.toPandas().set_index("entity").sort_index()
    assert s["fitted"].tolist() == [n >= 4 for n in range(1, 13)]
    assert (s.loc[:"n03", "breach_step"] == -1).all()
    # exact lines are predicted exactly wherever a hold-out exists (n >= 5)
    assert s["backtest_rmse"].isna().tolist() == [n < 5 for n in range(1, 13)]
    assert np.allclose(s["backtest_rmse"].dropna(), 0, atol=1e-9)
    got = fc.where("entity = 'n12'").toPandas().sort_values("step")
    assert np.allclose(got["mean"], [130, 140, 150])
    sigma = np.std(np.arange(1, 13) * 10.0)
    assert np.allclose(got["upper_95"], got["mean"] + 1.96 * sigma * np.sqrt([1, 2, 3]))
    assert [p.isoformat() for p in got["period"]] == ["2001-01-01", "2001-02-01", "2001-03-01"]


def test_holdout_sizes(spark):
    table = {f"n{n:02d}": np.ones(n) * 7 for n in (4, 5, 6, 7, 10, 11, 20)}
    rows = forecast.holdout_rows(forecast.as_series(series(spark, table), "y")).groupBy("entity").count()
    got = {r["entity"]: r["count"] for r in rows.collect()}
    assert got == {"n05": 1, "n06": 1, "n07": 2, "n10": 2, "n11": 3, "n20": 3}


def test_constant_series_gets_unit_sigma(spark):
    fit = forecast.fit_trend(forecast.as_series(series(spark, {"c": [4.0] * 6}), "y")).first()
    assert fit["slope"] == 0 and fit["intercept"] == 4 and fit["sigma"] == 1.0 and fit["capacity"] == 5.0


def plain_cusum(y):
    n = len(y)
    k = max(n // 2, 3)
    b = np.polyfit(np.arange(k), y[:k], 1)
    res = y - np.polyval(b, np.arange(n))
    s = res[:k].std()
    path = np.cumsum(res[k:] / (s if s >= 1e-12 else 1.0))
    return np.abs(path).max(), int(np.abs(path).argmax()) + k, 1.358 * np.sqrt(n - k)


def test_cusum_matches_plain_formula(spark):
    rng = np.random.default_rng(0)
    table = {"shift": np.r_[rng.normal(10, 1, 20), rng.normal(30, 1, 20)], "calm": rng.normal(5, 1, 14), "five": np.arange(5.0), "three": np.arange(3.0)}
    got = causal.cusum_test(series(spark, table), "y").toPandas().set_index("entity")
    assert "three" not in got.index and np.isnan(got.loc["five", "cusum_max"]) and not got.loc["five", "break_detected"]
    for e in ("shift", "calm"):
        top, at, crit = plain_cusum(table[e])
        assert got.loc[e, "cusum_max"] == pytest.approx(top) and got.loc[e, "critical"] == pytest.approx(crit)
        assert got.loc[e, "break_detected"] == (top > crit)
        if top > crit:
            assert got.loc[e, "break_period"] == month(at)


def plain_granger(y, x, lag):
    t = len(y)
    target = y[lag:]
    own = [np.ones(t - lag)] + [y[lag - k : t - k] for k in range(1, lag + 1)]
    more = own + [x[lag - k : t - k] for k in range(1, lag + 1)]
    rss = [np.linalg.lstsq(np.column_stack(m), target, rcond=None)[1][0] for m in (own, more)]
    df2 = len(target) - 2 * lag - 1
    return ((rss[0] - rss[1]) / lag) / (rss[1] / df2)


def test_granger_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(100, 10, 60)
    y = np.r_[50.0, 0.8 * x[:-1]] + rng.normal(0, 2, 60)
    rows = [("e", month(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    panel = materialize(spark.createDataFrame(rows, "entity string, period date, a_total double, b_total double"))
    got = causal.granger(panel, [("a_total", "b_total")]).toPandas().set_index("lag").sort_index()
    assert (got["cause_diffs"] == 0).all() and (got["effect_diffs"] == 0).all()
    for lag in (1, 2, 3):
        assert got.loc[lag, "f_statistic"] == pytest.approx(plain_granger(y, x, lag), rel=1e-6)
    assert got.loc[1, "significant"] and got.loc[1, "p_value"] < 1e-10


def test_random_walk_is_differenced_once(spark):
    rng = np.random.default_rng(9)
    walk, noise = 500 + np.cumsum(rng.normal(0, 1, 120)), rng.normal(0, 1, 120)
    rows = [("e", month(i), float(a), float(b)) for i, (a, b) in enumerate(zip(walk, noise))]
    panel = spark.createDataFrame(rows, "entity string, period date, a_total double, b_total double")
    got = {r["measure"]: r["d"] for r in causal.differencing_order(panel, ["a_total", "b_total"]).collect()}
    assert got == {"a_total": 1, "b_total": 0}


def test_order_search_finds_the_autoregression(spark):
    rng = np.random.default_rng(2)
    y = [0.0]
    for e in rng.normal(0, 1, 200):
        y.append(0.85 * y[-1] + e)
    cand = forecast.search_orders(series(spark, {"ar": y, "short": y[:10]}), "y").toPandas()
    assert set(cand["entity"]) == {"ar"} and len(cand) == 144
    level = cand[(cand.d == 0) & (cand.sd == 0)].set_index(["p", "q", "sp", "sq"])["aic"]
    assert level[(1, 0, 0, 0)] < level[(0, 0, 0, 0)] - 0.5
    best = forecast.best_orders(series(spark, {"ar": y, "mid": y[:10], "tiny": y[:4]}), "y").toPandas().set_index("entity")
    assert best.loc["mid", "model_order"] == "(1, 1, 1)" and best.loc["tiny", "model_order"].startswith("Fallback")


@pytest.fixture(scope="module")
def donors(spark):
    rng = np.random.default_rng(4)
    d = {f"d{i}": 100 + 10 * rng.normal(size=30).cumsum() for i in range(6)}
    t = 0.3 * d["d1"] + 0.7 * d["d4"]
    t[20:] += 25
    return series(spark, d | {"t": t})


def fitted(df, treated, cut=20, **kw):
    rows = synthetic.fit(df, treated, "y", month(cut).isoformat(), **kw).collect()
    return {r.treated: (dict(zip(r.donors, r.weights)), r) for r in rows}


@pytest.mark.parametrize("taken,block", [(256, 1024), (2, 3)])
def test_simplex_weights_are_recovered_at_every_size(donors, taken, block):
    w, row = fitted(donors, ["t"], taken=taken, block=block)["t"]
    assert sum(w.values()) == pytest.approx(1) and min(w.values()) > 0 and row.converged and row.n_periods == 20
    assert w["d1"] == pytest.approx(0.3, abs=1e-9) and w["d4"] == pytest.approx(0.7, abs=1e-9)


def plain_simplex(x, y, rounds=60_000):
    """Projected gradient, far from the tested method."""
    w, step = np.full(x.shape[1], 1 / x.shape[1]), 1 / np.linalg.eigvalsh(x.T @ x)[-1]
    for _ in range(rounds):
        v = w - step * (x.T @ (x @ w - y))
        u = np.sort(v)[::-1]
        cum = np.cumsum(u) - 1
        k = np.flatnonzero(u - cum / np.arange(1, len(v) + 1) > 0)[-1]
        w = np.maximum(v - cum[k] / (k + 1), 0)
    return w


@pytest.mark.parametrize("taken,block", [(256, 1024), (4, 6)])
def test_every_entity_as_the_treated_one(spark, taken, block):
    rng = np.random.default_rng(9)
    values = {f"e{k:02d}": 50 + rng.normal(size=24) * 8 for k in range(14)}
    values["same"] = values["e03"].copy()
    df = series(spark, values)
    got = fitted(df, df.select("entity").distinct(), taken=taken, block=block)
    assert got.keys() == values.keys()
    for name, (w, row) in got.items():
        donors = [n for n in values if n != name]
        x, y = np.array([values[n][:20] for n in donors]).T, values[name][:20]
        own = np.array([w.get(n, 0.0) for n in donors])
        loss, best = ((x @ own - y) ** 2).sum(), ((x @ plain_simplex(x, y) - y) ** 2).sum()
        assert loss <= best + 1e-6 and own.sum() == pytest.approx(1) and row.converged


def test_active_set_meets_the_optimality_conditions():
    rng = np.random.default_rng(8)
    for trial in range(60):
        x, y = rng.normal(size=(rng.integers(1, 30), rng.integers(1, 30))), rng.normal(size=1)
        y = rng.normal(size=len(x))
        g, b = x.T @ x, x.T @ y
        w = synthetic.active_set(g, b)
        slope = g @ w - b
        assert w.sum() == pytest.approx(1) and (w >= 0).all() and w @ slope - slope.min() < 1e-8
        w = synthetic.active_set(g + 0.1 * np.eye(len(b)), b, affine=False)
        slope = g @ w + 0.1 * w - b
        assert (w >= 0).all() and slope.min() > -1e-8 and abs(w @ slope) < 1e-8


@pytest.mark.parametrize("taken,block", [(256, 1024), (2, 3)])
def test_short_excluded_entities_and_gaps(spark, taken, block):
    """An excluded short entity costs no periods; a treated one outside the pool uses the periods it has."""
    rng = np.random.default_rng(5)
    values = {f"d{k}": 20 + rng.normal(size=30).cumsum() for k in range(5)}
    values["t"] = 0.4 * values["d0"] + 0.6 * values["d2"]
    df = series(spark, values)
    short = df.where("NOT (entity = 't' AND month(period) = 3)").unionByName(df.where("entity = 'd1' AND month(period) = 5").withColumn("entity", F.lit("x")))
    w, row = fitted(short, ["t"], exclude=["x", "t"], taken=taken, block=block)["t"]
    gone = sum(month(k).month == 3 for k in range(20))
    assert row.n_periods == 20 - gone and w["d0"] == pytest.approx(0.4, abs=1e-9) and w["d2"] == pytest.approx(0.6, abs=1e-9)
    assert fitted(short, ["t", "none"], exclude=[], taken=taken, block=block)["t"][1].n_periods == sum(month(k).month == 5 for k in range(20))


def test_optimality_tells_good_weights_from_bad(spark, donors):
    cut = month(20).isoformat()
    good = synthetic.fit_weights(donors, ["t"], "y", cut)
    assert abs(synthetic.optimality(donors, good, "y", cut).first()["gap"]) < 1e-12
    bad = spark.createDataFrame([("t", "d1", 0.31), ("t", "d4", 0.69)], "treated string, donor string, weight double")
    assert synthetic.optimality(donors, bad, "y", cut).first()["gap"] > 1e-7
    ridge = synthetic.fit_weights(donors, ["t"], "y", cut, method="ridge")
    assert abs(synthetic.optimality(donors, ridge, "y", cut, alpha=synthetic.RIDGE).first()["gap"]) < 1e-10


def test_effect_and_placebo(donors):
    cut = month(20).isoformat()
    w = synthetic.fit_weights(donors, ["t"], "y", cut)
    eff = synthetic.effect_series(donors, w, "y", cut)
    got = synthetic.average_effect(eff).first()
    assert got["ate"] == pytest.approx(25, abs=1e-6) and got["n_periods"] == 10 and got["significant"]
    assert synthetic.fit_quality(eff).first()["pre_rmse"] < 1e-6
    rows = {r.treated: r for r in synthetic.placebo_effects(donors, "t", "y", cut).collect()}
    assert len(rows) == 7 and rows["t"].real and rows["t"].ate == pytest.approx(25, abs=1e-6) and all(r.converged for r in rows.values())
    alone = synthetic.fit_weights(donors, ["d2"], "y", cut, exclude=["t"])
    assert synthetic.average_effect(synthetic.effect_series(donors, alone, "y", cut)).first()["ate"] == pytest.approx(rows["d2"].ate)
    placebo = synthetic.placebo_test(donors, "t", "y", cut).first()
    assert placebo["n_placebos"] == 6 and placebo["n_without"] == 0
    assert placebo["p_value"] == pytest.approx(np.mean([abs(r.ate) >= 25 for r in rows.values() if not r.real]))


def test_ridge_weights(donors):
    for taken, block in ((256, 1024), (2, 3)):
        w, row = fitted(donors, ["t"], method="ridge", taken=taken, block=block)["t"]
        assert sum(w.values()) == pytest.approx(1) and min(w.values()) > 0 and row.converged
        assert w["d1"] == pytest.approx(0.3, abs=1e-2) and w["d4"] == pytest.approx(0.7, abs=1e-2)


def test_pooled_features_and_forecast(spark):
    t = np.arange(48)
    table = {e: base + 10 * np.sin(2 * np.pi * t / 12) for e, base in (("p", 100), ("q", 200), ("r", 300))}
    df = series(spark, table).withColumnRenamed("y", "value")
    f = pooled.panel_features(df).toPandas().sort_values(["entity", "period"])
    one = f[f.entity == "q"].reset_index(drop=True)
    assert np.allclose(one["lag_3"][3:], table["q"][:-3]) and one["entity_code"].unique().tolist() == [1]
    assert np.allclose(one["std_6"][1:], pd.Series(table["q"]).rolling(6, min_periods=1).std()[1:])
    rows = pooled.training_rows(df)
    assert rows.count() == 3 * 36
    model = pooled.fit(rows, trees=5)
    out = pooled.forecast(df, model, horizon=3).toPandas()
    assert len(out) == 3 * 4
    total = out[out.entity == "National"].set_index("period")["forecast"].sort_index()
    parts = out[out.entity != "National"].groupby("period")["forecast"].sum().sort_index()
    assert np.allclose(total, parts)


def test_short_histories_have_all_their_months(spark):
    t = np.arange(30)
    table = {"p": 100 + t, "q": 200 - t, "two": np.array([5.0, 7.0]), "one": np.array([3.0])}
    df = series(spark, table).withColumnRenamed("y", "value")
    df = df.unionByName(spark.createDataFrame([("none", month(4), None)], "entity string, period date, value double"))
    model = pooled.fit(pooled.training_rows(df), trees=2)
    out = pooled.forecast(df, model, horizon=12).toPandas()
    assert out.groupby("entity").size().drop("National").to_dict() == dict.fromkeys(["p", "q", "two", "one", "none"], 12)
    assert out["forecast"].notna().all()
    assert out[out.entity == "two"]["period"].min() == month(2) and out[out.entity == "none"]["period"].max() == month(16)
    x = spark.createDataFrame([([5.0, 7.0],), ([],), ([float(v) for v in range(12)],)], "past array<double>")
    got = x.select(*[c.alias(n) for n, c in pooled._history_features(F.col("past")).items()]).toPandas()
    assert got.loc[0, ["lag_1", "lag_2", "lag_3", "past_mean_3", "past_mean_12"]].tolist() == [7, 5, 0, 6, 6]
    assert got.loc[0, "past_std_6"] == pytest.approx(np.sqrt(2)) and (got.loc[1] == 0).all()
    assert got.loc[2, "lag_12"] == 0 and got.loc[2, "past_mean_6"] == 8.5 and got.loc[2, "past_std_12"] == pytest.approx(np.arange(12).std(ddof=1))


def test_validation_stops_adding_trees(spark):
    rng = np.random.default_rng(3)
    df = series(spark, {e: 100 + rng.normal(size=60) for e in ("p", "q", "r")}).withColumnRenamed("y", "value")
    found = pooled.cross_validate(pooled.training_rows(df), trees=8).toPandas()
    assert found["trees"].between(1, 8).all() and (found["trees"] < 8).any()  # noise: more trees don't help
    assert found["rows"].tolist() == [36, 36, 36] and (found["rmse"] >= found["mae"]).all()


def test_rows_are_consecutive_even_when_months_are_missing(spark):
    rows = [("e", dt.date(2025, m, 1), float(m)) for m in (1, 2, 5, 6)]
    df = spark.createDataFrame(rows, "entity string, period date, y double")
    got = stats.shifts(df, "y", lags=(1,)).orderBy("period").select("lag_1").toPandas()["lag_1"].tolist()
    assert np.isnan(got[0]) and got[1:] == [1.0, 2.0, 5.0]
    assert df.agg(F.count(F.lit(1))).first()[0] == 4


def test_granger_lags_beyond_three_equal_least_squares(spark):
    rng = np.random.default_rng(8)
    n, top = 90, 6
    a = rng.normal(size=n)
    b = np.zeros(n)
    for t in range(n):
        b[t] = 0.4 * b[t - 1] * (t > 0) + 0.8 * a[t - 5] * (t > 4) + rng.normal()
    months = pd.period_range("2015-01", periods=n, freq="M").to_timestamp()
    pdf = pd.DataFrame({"entity": "e", "period": months.date, "a_total": a, "b_total": b})
    diffs = spark.createDataFrame([("e", "a_total", 0), ("e", "b_total", 0)], "entity string, measure string, d int")
    got = causal.granger(spark.createDataFrame(pdf), [("a_total", "b_total")], max_lag=top, diffs=diffs).toPandas().set_index("lag")
    for p in range(1, top + 1):
        y = b[p:]
        own = np.column_stack([np.ones(n - p)] + [b[p - k : n - k] for k in range(1, p + 1)])
        both = np.column_stack([own] + [a[p - k : n - k] for k in range(1, p + 1)])
        rss = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
        f = ((rss(own) - rss(both)) / p) / (rss(both) / (n - p - 2 * p - 1))
        assert got.loc[p, "f_statistic"] == pytest.approx(f, rel=1e-6)
