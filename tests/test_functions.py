import datetime as dt
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.functions import columns as c
from panelwise.functions import tails
from panelwise.operators import clean


def one(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize("text", ["o'brien a-b 1st", "WEST  bengal", "", "nation_7x", "élan vital", "a&b c"])
def test_title_case_follows_letter_runs(spark, text):
    assert one(spark, [text]).select(c.title_case("x")).first()[0] == text.title()


def test_strip_all_blanks_keeps_inner_ones(spark):
    assert one(spark, ["\t  West  Bengal \n"]).select(clean.normalise_text("x")).first()[0] == "West  Bengal"


def test_day_first_dates(spark):
    got = [r[0] for r in one(spark, ["03-04-2025", "03/04/2025", "2025-04-03", "31-02-2025", None]).select(c.parse_day_first("x")).collect()]
    d = dt.date(2025, 4, 3)
    assert got == [d, d, d, None, None]


def test_corr_of_constant_or_single_row_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(c.safe_corr("a", "b")).first()[0] is None
    assert df.limit(1).agg(c.safe_corr("a", "b")).first()[0] is None


def test_corr_uses_complete_pairs(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 1.0), (5.0, 7.0), (None, 3.0)]
    got = spark.createDataFrame(rows, "a double, b double").agg(c.safe_corr("a", "b")).first()[0]
    full = np.array([r for r in rows if None not in r])
    assert got == pytest.approx(np.corrcoef(full.T)[0, 1])


def test_ratios(spark):
    df = spark.createDataFrame([(1, 0), (4, 2)], "a long, b long")
    assert [r[0] for r in df.select(c.ratio("a", "b")).collect()] == pytest.approx([1e6, 4 / 2.000001])
    assert [r[0] for r in df.select(c.open_ratio("a", "b")).collect()] == [None, 2.0]


def test_known_tail_values():
    assert tails.f_sf([3.0984], [3], [20])[0] == pytest.approx(0.05, abs=1e-5)
    assert tails.t_two_sided([2.086], [20])[0] == pytest.approx(0.05, abs=1e-5)
    assert tails.chi2_sf([3.841459, 18.307], [1, 10]) == pytest.approx([0.05, 0.05], abs=1e-5)
    assert tails.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-4)
    assert tails.adf_p([-2.86, -3.43]) == pytest.approx([0.05, 0.01], abs=1e-3)
    assert tails.normal_sf([1.959964])[0] == pytest.approx(0.025, abs=1e-7)


@pytest.mark.parametrize("n,m", [(3, 3), (4, 3), (5, 4)])
def test_exact_ks_equals_counting_all_orders(n, m):
    for h in range(1, n * m + 1):
        d, hits, total = h / (n * m), 0, 0
        for order in product([0, 1], repeat=n + m):
            if sum(order) != m:
                continue
            total += 1
            i = j = 0
            worst = 0.0
            for side in order:
                i, j = i + (side == 0), j + side
                worst = max(worst, abs(i / n - j / m))
            hits += worst >= d - 1e-9
        if any(abs(i * m - j * n) == h for i in range(n + 1) for j in range(m + 1)):
            assert tails.ks_two_sample_p(d, n, m) == pytest.approx(hits / total)


def test_aliases_compose(spark):
    got = [r[0] for r in one(spark, ["Westbengal", "Daman & Diu", "Dadra And Nagar Haveli", "Kerala"]).select(clean.canonical_name("x")).collect()]
    assert got == ["West Bengal", "Dadra And Nagar Haveli And Daman And Diu", "Dadra And Nagar Haveli And Daman And Diu", "Kerala"]


def test_negative_and_unknown_counts_fail_the_filter(spark):
    df = spark.createDataFrame([(1, 2), (-1, 2), (None, 3), (0, 0)], "a long, b long")
    assert df.where(clean.non_negative(["a", "b"])).count() == 2


def test_sentinel_rows_are_dropped(spark):
    assert [r[0] for r in clean.drop_sentinel(one(spark, ["100000", "A", None]), "x").collect()] == ["A"]


def test_duplicate_count(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "a")], "k long, v string")
    assert clean.duplicate_count(df).first().asDict() == {"rows": 4, "distinct_rows": 2, "duplicates": 2}


def test_fixed_alias_tables_are_not_circular():
    from panelwise.functions.fixed import ALIASES, MERGED

    once = clean.compose_aliases(ALIASES, MERGED)
    assert all(once.get(v, v) == v for v in once.values())


def test_moments_of_f_helper(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(c.nan_to_null("x")).collect()] == [0.5, None]
    assert df.select(F.sum(c.nan_to_null("x"))).first()[0] == 0.5


def test_tail_expressions_equal_the_numpy_laws(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(float(f), float(a), float(b)) for f, a, b in zip(10 ** rng.uniform(-4, 2.5, 150), rng.integers(1, 60, 150), rng.integers(1, 400, 150))]
    df = spark.createDataFrame(rows, "x double, a double, b double")
    got = df.select("x", "a", "b", tails.f_tail(F.col("x"), F.col("a"), F.col("b")).alias("f"), tails.t_tail(F.col("x"), F.col("a")).alias("t"), tails.chi2_tail(F.col("x"), F.col("a")).alias("c")).toPandas()
    for name, want in (("f", tails.f_sf(got.x, got.a, got.b)), ("t", tails.t_two_sided(got.x, got.a)), ("c", tails.chi2_sf(got.x, got.a))):
        assert np.allclose(got[name], want, rtol=1e-8, atol=1e-12), name
    ks = spark.createDataFrame([(float(v),) for v in [0.0, 0.05, 0.3, 0.8, 1.17, 1.18, 1.5, 3.0]], "x double").select("x", tails.kolmogorov_tail(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(tails.kolmogorov_sf(r.x), abs=1e-12) for r in ks)


def test_tails_of_missing_values_are_null(spark):
    df = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (1.0, 0.0), (float("inf"), 2.0)], "x double, n double")
    x, n = F.col("x"), F.col("n")
    assert [tuple(r) for r in df.select(tails.f_tail(x, n, n), tails.t_tail(x, n), tails.chi2_tail(x, n)).collect()] == [(None,) * 3] * 4


@pytest.mark.parametrize("method,want", [("auto", "exact"), ("exact", "exact"), ("asymptotic", "asymptotic")])
def test_ks_method_is_an_argument(spark, method, want):
    df = spark.createDataFrame([(0.25, 40, 60)], "d double, n long, m long")
    row = df.select(tails.ks_tail(F.col("d"), F.col("n"), F.col("m"), method).alias("p"), tails.ks_method(F.col("n"), F.col("m"), method).alias("how")).first()
    exact, far = tails.ks_two_sample_p(0.25, 40, 60), tails.kolmogorov_sf(0.25 * (40 * 60 / 100) ** 0.5)
    assert row.how == want and row.p == pytest.approx(exact if want == "exact" else far)
