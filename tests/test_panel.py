import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwise.operators import indices, robust, rollup, scenario, stats
from panelwise.session import materialize


def facts(spark, rows, bands):
    return spark.createDataFrame(rows, "entity string, date date, " + ", ".join(f"{b} long" for b in bands))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = {f: [] for f in "abc"}
    for e in "PQRSTU":
        for m in range(1, 10):
            for f, k in (("a", 3), ("b", 2), ("c", 2)):
                for day in (1, 15):
                    rows[f].append((e, dt.date(2025, m, day), *[int(v) for v in rng.integers(0, 50 * (ord(e) - 79), k)]))
    a, b, c = (facts(spark, rows[f], rollup.BANDS_OF[f]) for f in "abc")
    return materialize(rollup.build_panel(a, b, c)), rows


def test_panel_sums_and_ratios(panel):
    got = panel[0].toPandas().set_index(["entity", "period"]).sort_index()
    a = pd.DataFrame(panel[1]["a"], columns=["entity", "date", "x", "y", "z"])
    a["period"] = pd.to_datetime(a["date"]).dt.to_period("M").dt.to_timestamp().dt.date
    want = a.groupby(["entity", "period"])[["x", "y", "z"]].sum()
    assert (got["a_total"] == want.sum(axis=1)).all()
    assert np.allclose(got["a1_share"], got["a_1"] / (got["a_total"] + 1e-6))
    assert (got["activity"] == got["a_total"] + got["b_total"] + got["c_total"]).all()


def test_profile_matches_pandas(panel):
    p = panel[0].toPandas().sort_values(["entity", "period"])
    got = rollup.entity_profile(panel[0]).toPandas().set_index("entity").sort_index()
    for e, g in p.groupby("entity"):
        assert got.loc[e, "ratio_cv"] == pytest.approx(g["update_ratio"].std() / (g["update_ratio"].mean() + 1e-6))
        assert got.loc[e, "lag1_corr"] == pytest.approx(g["a_2"].corr(g["c_2"].shift(-1)))
        assert got.loc[e, "lag2_corr"] == pytest.approx(g["a_2"].corr(g["c_2"].shift(-2)))
    assert (got["active_periods"] == 9).all()


def test_short_and_constant_entities(spark):
    rows = [("one", dt.date(2025, 1, 1), 5, 5, 5)] + [("flat", dt.date(2025, m, 1), 4, 4, 4) for m in (1, 2, 3)]
    a = facts(spark, rows, rollup.BANDS_OF["a"])
    b = facts(spark, [r[:4] for r in rows], rollup.BANDS_OF["b"])
    c = facts(spark, [r[:4] for r in rows], rollup.BANDS_OF["c"])
    out = indices.index_profile(rollup.entity_profile(rollup.build_panel(a, b, c))).toPandas().set_index("entity")
    assert out.loc["one", "lag1_corr"] is None or np.isnan(out.loc["one", "lag1_corr"])
    assert (out["volatility"] == 0).all() and (out["predictability"] == 0).all()


def test_indices_follow_their_formulas(panel):
    prof = rollup.entity_profile(panel[0]).toPandas().set_index("entity").sort_index()
    got = indices.index_profile(rollup.entity_profile(panel[0])).toPandas().set_index("entity").sort_index()

    def scale(s):
        span = s.max() - s.min()
        return s * 0 if span <= 1e-6 else (s - s.min()) / (span + 1e-6)

    ranks = sum(prof[f"{f}_total"].rank(ascending=False) for f in "abc")
    assert np.allclose(got["maturity"], 1 - scale(ranks))
    assert np.allclose(got["pressure"], scale(np.log1p(prof.b_total + prof.c_total) - np.log1p(prof.a_total)))
    assert np.allclose(got["volatility"], scale(prof.ratio_cv.fillna(0)))
    assert np.allclose(got["predictability"], scale(prof.lag1_corr.abs().fillna(0)))
    assert got[indices.INDICES].min().min() >= 0 and got[indices.INDICES].max().max() <= 1


def test_flags_do_not_change_when_tables_count_as_large(panel, monkeypatch):
    from panelwise.operators import ordered

    prof = materialize(indices.index_profile(rollup.entity_profile(panel[0])))
    cols = ["entity", *indices.FLAGS, "flag_count", "volatility_excess", "index_distance"]
    small = indices.anomaly_flags(prof).select(*cols).toPandas().sort_values("entity").reset_index(drop=True)
    monkeypatch.setattr(ordered, "SMALL_ROWS", 0)
    monkeypatch.setattr(indices, "SMALL_ROWS", 0)
    large = indices.anomaly_flags(prof).select(*cols).toPandas().sort_values("entity").reset_index(drop=True)
    pd.testing.assert_frame_equal(small, large)


@pytest.mark.parametrize(
    "m,p,v,t,label",
    [
        (0.8, 0.5, 0.2, 0.9, "Stable Mature System"),
        (0.5, 0.8, 0.8, 0.9, "High Maintenance Stress"),
        (0.3, 0.3, 0.5, 0.9, "Expansion Phase"),
        (0.5, 0.5, 0.5, 0.2, "Unpredictable - Needs Monitoring"),
        (0.5, 0.5, 0.5, 0.5, "Balanced / Transitional"),
    ],
)
def test_labels(spark, m, p, v, t, label):
    df = spark.createDataFrame([(m, p, v, t)], "maturity double, pressure double, volatility double, predictability double")
    assert df.select(indices.label_column()).first()[0] == label


def test_robust_score_of_constant_is_neutral(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "x double")
    assert {r[0] for r in indices.robust_score(df, {"x": "s"}).select("s").collect()} == {0.5}


def test_entropy_predictability_matches_numpy(panel):
    p = panel[0].toPandas()
    got = robust.entropy_predictability(panel[0]).toPandas().set_index("entity")
    for e, g in p.groupby("entity"):
        counts = np.histogram(g["activity"], bins=min(12, len(g)))[0]
        q = counts[counts > 0] / counts.sum()
        h = -(q * np.log2(q)).sum()
        assert got.loc[e, "entropy"] == pytest.approx(h)
        assert got.loc[e, "entropy_predictability"] == pytest.approx(1 - h / np.log2(len(counts)))


def test_histogram_matches_numpy_and_widens_flat_groups(spark):
    rows = [("a", float(v)) for v in (1, 2, 2, 3, 9, 10)] + [("b", 4.0)] * 3
    got = stats.histogram(spark.createDataFrame(rows, "g string, v double"), "v", F.lit(4), ["g"]).toPandas()
    for g in "ab":
        want = np.histogram([v for k, v in rows if k == g], bins=4)[0]
        assert got[got.g == g].sort_values("bin")["n"].tolist() == want.tolist()


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "x string")
    assert stats.mode_of(df, "x").first()[0] == "a"


def test_gap_statistics(spark):
    days = [1, 2, 3, 3, 20]
    df = spark.createDataFrame([("e", dt.date(2025, 1, d)) for d in days], "entity string, date date")
    got = stats.gap_statistics(df, "date", ["entity"]).first()
    diffs = np.diff(days)
    assert got["median_gap"] == np.median(diffs) and got["max_gap"] == 17
    assert got["duplicate_dates"] == 1 and not got["no_duplicates"] and got["large_gaps"]


def test_corr_matrix_is_symmetric_and_matches_pandas(panel):
    cols = ["a_total", "b_total", "update_ratio"]
    got = stats.corr_matrix(panel[0], cols).toPandas().set_index("metric").loc[cols, cols]
    assert np.allclose(got, panel[0].toPandas()[cols].corr())


def test_scoped_facts_must_not_be_empty(spark, panel):
    with pytest.raises(ValueError, match="no rows"):
        stats.require_rows(a=panel[0].where("1 = 0"), b=panel[0])


def test_scenario_scores_stay_in_bounds_and_zero_levers_change_nothing(spark):
    df = spark.createDataFrame([("e", 0.9, 0.1, 0.5, 0.2)], "entity string, maturity double, pressure double, volatility double, predictability double")
    got = scenario.score(scenario.with_scenarios(df, [("none", {}), ("all", dict.fromkeys(scenario.LEVERS, 100.0))])).toPandas().set_index("scenario")
    assert got.loc["none", "demand_multiplier"] == 1.0 and got.loc["none", "new_maturity"] == 0.9
    new = got.loc["all", [f"new_{i}" for i in indices.INDICES]].astype(float)
    assert new.between(0, 1).all() and got.loc["all", "delta_volatility"] < 0
    want = 0.12 * (1 - np.exp(-2.5)) * max(0.1, 1.2 - 0.9) + 0.04 * (1 - np.exp(-2.0)) * max(0.2, 1.3 - 0.1)
    assert got.loc["all", "delta_maturity"] == pytest.approx(round(want, 4))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(1, 12), st.integers(0, 1000)), min_size=10, max_size=60))
def test_rollup_preserves_totals_in_any_order(spark, rows):
    df = facts(spark, [(e, dt.date(2025, m, 1), v, 0, 1) for e, m, v in rows], rollup.BANDS_OF["a"])
    for parts in (1, 5):
        got = rollup.rollup(df.repartition(parts), "a").agg(F.sum("a_1"), F.sum("a_total"), F.count(F.lit(1))).first()
        assert tuple(got) == (sum(v for *_, v in rows), sum(v + 1 for *_, v in rows), len({r[:2] for r in rows}))
