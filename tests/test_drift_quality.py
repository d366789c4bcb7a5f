import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.operators import drift, quality


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def ks(spark, x, y, **kw):
    return drift.covariate_drift(drift.pooled(frame(spark, f=x), frame(spark, f=y), ["f"]), **kw).first()


def test_ks_cases(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 200)
    same = ks(spark, x[:100], x[:100])
    assert same["ks"] == 0 and same["p_value"] == 1 and same["severity"] == "stable"
    far = ks(spark, x, rng.normal(5, 1, 200))
    assert far["ks"] > 0.5 and far["p_value"] < 0.01 and far["severity"] == "critical"
    tiny = ks(spark, np.array([1.0]), x)
    assert tiny["severity"] == "insufficient_data" and tiny["ks"] is None and not tiny["drift_detected"]


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_ks_with_ties_and_nan(spark, small_rows):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 150).astype(float), rng.integers(2, 12, 90).astype(float)
    y[3] = np.nan
    got = ks(spark, x, y, small_rows=small_rows)
    grid, yy = np.unique(np.r_[x, y[~np.isnan(y)]]), y[~np.isnan(y)]
    want = max(abs((x <= g).mean() - (yy <= g).mean()) for g in grid)
    assert got["ks"] == pytest.approx(want) and got["n_cur"] == 89


def plain_psi_quantile(ref, cur, bins=10):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, bins + 1)))
    p = np.maximum(np.bincount(np.digitize(ref, edges[1:-1]), minlength=len(edges)) / len(ref), 1e-10)
    q = np.maximum(np.bincount(np.digitize(cur, edges[1:-1]), minlength=len(edges)) / len(cur), 1e-10)
    return ((q - p) * np.log(q / p)).sum()


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_psi_measures(spark, small_rows):
    rng = np.random.default_rng(2)
    ref, cur = rng.beta(2, 5, 300), rng.beta(5, 2, 200)
    pool = drift.pooled(frame(spark, f=ref), frame(spark, f=cur), ["f"])
    assert drift.psi_quantile(pool, small_rows=small_rows).first()["psi"] == pytest.approx(plain_psi_quantile(ref, cur))
    edges = np.linspace(min(ref.min(), cur.min()), max(ref.max(), cur.max()) + 1e-10, 11)
    p = (np.histogram(ref, edges)[0] + 1e-4) / (300 + 1e-3)
    q = (np.histogram(cur, edges)[0] + 1e-4) / (200 + 1e-3)
    assert drift.psi_equal_width(pool).first()["psi"] == pytest.approx(((q - p) * np.log(q / p)).sum())
    alike = drift.pooled(frame(spark, f=ref), frame(spark, f=ref), ["f"])
    assert drift.psi_equal_width(alike).first()["psi"] == pytest.approx(0) and drift.psi_quantile(alike).first()["psi"] == pytest.approx(0)


def test_psi_of_constant_reference_is_null(spark):
    pool = drift.pooled(frame(spark, f=np.ones(5)), frame(spark, f=np.arange(5.0)), ["f"])
    assert drift.psi_quantile(pool).first()["psi"] is None


def test_js_distance(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 400), rng.normal(0.5, 1, 300)
    edges = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), 51)
    p, q = np.histogram(x, edges)[0] / 400, np.histogram(y, edges)[0] / 300
    m = (p + q) / 2
    kl = lambda a: np.sum(a[a > 0] * np.log(a[a > 0] / m[a > 0]))
    got = drift.js_distance(drift.pooled(frame(spark, f=x), frame(spark, f=y), ["f"])).first()["js"]
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_chi_square_with_and_without_correction(spark):
    two = drift.chi_square(frame(spark, c=["a"] * 30 + ["b"] * 10), frame(spark, c=["a"] * 15 + ["b"] * 25), ["c"]).first()
    o = np.array([[30, 15], [10, 25]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert two["dof"] == 1 and two["chi2"] == pytest.approx((((np.abs(o - e) - 0.5) ** 2) / e).sum())
    three = drift.chi_square(frame(spark, c=["a"] * 5 + ["b"] * 5), frame(spark, c=["a"] * 4 + ["c"] * 6), ["c"]).first()
    o = np.array([[5, 4], [5, 0], [0, 6]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert three["dof"] == 2 and three["chi2"] == pytest.approx(((o - e) ** 2 / e).sum())


def test_baseline_check_and_missing_baseline(spark):
    rng = np.random.default_rng(4)
    base = frame(spark, maturity=rng.normal(0.5, 0.1, 36), pressure=rng.normal(0.5, 0.1, 36))
    moved = base.withColumn("maturity", F.col("maturity") + 0.5)
    got = drift.baseline_check(base, moved, ["maturity", "pressure", "absent"]).toPandas().set_index("feature")
    assert got.loc["maturity", "drift_detected"] and not got.loc["pressure", "drift_detected"]
    assert drift.baseline_check(None, moved, ["maturity"]).count() == 0


def test_monitor_history_and_retrain(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = frame(spark, x=rng.normal(size=200), c=rng.choice(list("ab"), 200))
    path = str(tmp_path / "history")
    drift.append_history(drift.monitor(base, base, ["x"], ["c"]), path, "r1", "2025-01-01 00:00:00")
    assert not drift.should_retrain(spark.read.parquet(path)).first()["retrain"]
    drift.append_history(drift.monitor(base, base.withColumn("x", F.col("x") + 3), ["x"], ["c"]), path, "r2", "2025-02-01 00:00:00")
    got = drift.should_retrain(spark.read.parquet(path)).first()
    assert got["run"] == "r2" and got["drifted_pct"] == 50 and got["retrain"]


def test_checks_in_one_pass(spark):
    rows = [("a", 1, dt.date(2020, 1, 1)), ("a", -2, dt.date(2005, 1, 1)), (None, 3, None), ("b", None, dt.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "entity string, v long, date date")
    checks = [quality.not_null("entity"), quality.in_range("v", 0), quality.unique(["entity"]), quality.unique(["entity", "date"]), quality.date_range("date")]
    out = quality.run_checks(df, "t", checks)
    got = {r["check_name"]: r["violations"] for r in out.collect()}
    assert got == {"entity_not_null": 1, "v_in_range": 1, "entity_unique": 1, "entity_date_unique": 0, "date_in_range": 1}
    rate = quality.success_rate(quality.as_report(out)).first()
    assert rate["checks"] == 5 and rate["passed"] == 1


def test_contract_splits_rows(spark):
    rows = [("2025-01-01", "A", "5"), ("2025-01-01", None, "5"), ("2025-01-01", "B", "-5"), ("2025-01-01", "C", "x")]
    df = spark.createDataFrame(rows, "date string, entity string, n string")
    rules = [quality.Rule("date", "date", False), quality.Rule("entity", "string", False), quality.Rule("n", "bigint", True, 0)]
    good, bad = quality.apply_contract(df, rules)
    assert [(r["entity"], r["n"]) for r in good.collect()] == [("A", 5)] and dict(good.dtypes)["n"] == "bigint"
    assert sorted(r["violations"][0] for r in bad.collect()) == ["entity: null", "n: below 0", "n: not bigint"]


def test_schema_report_lists_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "a long")
    got = {r["check_name"]: r["success"] for r in quality.schema_report(df, "t", {"a": "bigint", "b": "string"}).collect()}
    assert got == {"has_a": True, "a_is_bigint": True, "has_b": False}
