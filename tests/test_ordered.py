import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.operators import ordered
from panelwise.session import materialize

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; some are missing."""
    x = np.round(RNG.lognormal(2, 1.5, 3000), 1)
    x[:1000] = 7.0
    pdf = pd.DataFrame({"k": np.arange(3000), "x": x})
    pdf.loc[::50, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return df.repartition(5).cache(), pdf


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_ranks_match_pandas(skewed, small_rows):
    df, pdf = skewed
    specs = [("x", "avg_d", "average", True), ("x", "min_d", "min", True), ("x", "frac", "fraction", False), ("x", "left", "cdf", False), ("x", "right", "cdf", True)]
    got = ordered.with_ranks(df, specs, small_rows=small_rows, buckets=16).toPandas().set_index("k").sort_index()
    x = pdf.set_index("k")["x"]
    n = x.notna().sum()
    assert np.allclose(got["avg_d"], x.rank(ascending=False), equal_nan=True)
    assert np.allclose(got["min_d"].astype(float), x.rank(ascending=False, method="min"), equal_nan=True)
    assert np.allclose(got["frac"], x.rank(pct=True), equal_nan=True)
    assert np.allclose(got["left"], x.rank(method="max") / n, equal_nan=True)
    assert np.allclose(got["right"], x.rank(method="max", ascending=False) / n, equal_nan=True)


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_quantiles_interpolate(skewed, small_rows):
    df, pdf = skewed
    probs = {f"q{i}": ("x", p) for i, p in enumerate((0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0))}
    got = ordered.quantile_row(df, probs, small_rows=small_rows, buckets=16).first()
    assert list(got) == pytest.approx([pdf["x"].quantile(p) for _, p in probs.values()])


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_running_positions_and_sums(spark, small_rows):
    pdf = pd.DataFrame({"k": np.arange(2000), "v": np.r_[np.full(700, 5), RNG.integers(0, 50, 1300)]})
    got = ordered.running(
        spark.createDataFrame(pdf).repartition(7), [("v", True), ("k", False)], {"cum": F.col("v")}, small_rows=small_rows, buckets=16
    ).toPandas().sort_values("position")
    want = pdf.sort_values(["v", "k"], ascending=[False, True])
    assert got["k"].tolist() == want["k"].tolist()
    assert got["position"].tolist() == list(range(1, 2001))
    assert got["cum"].tolist() == want["v"].cumsum().tolist()


def test_running_over_text_keys(spark):
    names = [f"n{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "entity string")
    got = ordered.running(df, [("entity", False)], small_rows=0, buckets=8).toPandas().sort_values("position")
    assert got["entity"].tolist() == names


@pytest.mark.parametrize("small_rows", [0, 10**6])
def test_grouped_ladder(spark, small_rows):
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 800), "v": np.r_[RNG.integers(0, 30, 800), RNG.integers(100, 900, 800)]})
    got = ordered.ladder(spark.createDataFrame(pdf), "v", None, ["g"], small_rows=small_rows, buckets=8).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got["g"] == g].sort_values("v")
        counts = part["v"].value_counts().sort_index()
        assert mine["v"].tolist() == counts.index.tolist()
        assert mine["cum_cnt"].tolist() == counts.cumsum().tolist()
        assert set(mine["total_cnt"]) == {800}


def test_bucket_placement_spreads_work(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("x"))
    plan = ordered.ladder(df, "x", small_rows=0)._jdf.queryExecution().toString()
    # the only unpartitioned window runs over the buckets, never over the values
    assert "_bucket" in plan and plan.count("rangepartitioning") == 0


def test_bucket_number_follows_the_rows_without_an_end(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    for rows, want in ((10, 4), (30 * ordered.ROWS_PER_BUCKET, 30)):
        assert ordered._in_buckets(df, [F.col("k")], rows, None).select(ordered._B).distinct().count() == want


def test_many_cuts_are_placed_in_two_levels(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    got = ordered.ladder(df, "x", small_rows=0, buckets=600).toPandas().sort_values("x")
    assert got["cum_cnt"].tolist() == list(range(1, 5001))


def test_results_do_not_depend_on_partitioning(skewed):
    df, _ = skewed
    spec = [("x", "r", "average", True)]
    a = ordered.with_ranks(df.repartition(1), spec, small_rows=0).toPandas().sort_values("k")["r"]
    b = ordered.with_ranks(df.repartition(9), spec, small_rows=0).toPandas().sort_values("k")["r"]
    assert np.array_equal(a.to_numpy(), b.to_numpy(), equal_nan=True)


def test_both_ways_agree_on_nan_infinities_nulls_and_a_frequent_value(spark):
    rng = np.random.default_rng(3)
    values = [1.5] * 300 + [float("nan")] * 40 + [None] * 40 + [float("inf")] * 5 + [float("-inf")] * 5 + rng.normal(size=600).tolist()
    df = materialize(spark.createDataFrame(list(enumerate(values)), "id long, x double"))
    shape = lambda out: sorted((r.id, str(r.r), str(r.m)) for r in out.collect())
    specs = [("x", "r", "average", False), ("x", "m", "min", True)]
    assert shape(ordered.with_ranks(df, specs)) == shape(ordered.with_ranks(df, specs, small_rows=0))
    q = {"a": ("x", 0.25), "b": ("x", 0.5), "c": ("x", 0.9)}
    assert ordered.quantile_row(df, q).collect() == ordered.quantile_row(df, q, small_rows=0).collect()
    known = sorted(v for v in values if v is not None and v == v)
    assert ordered.quantile_row(df, {"b": ("x", 0.5)}).first()["b"] == np.median(known)
    place = lambda out: sorted((r.id, r.position) for r in out.collect())
    order = [("x", False), ("id", False)]
    assert place(ordered.running(df, order)) == place(ordered.running(df, order, small_rows=0))
