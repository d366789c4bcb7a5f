from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.operators import anomaly, attribution, cluster, indices
from panelwise.session import materialize


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    x[0] = [9, -9, 9, -9]
    pdf = pd.DataFrame(x, columns=indices.INDICES)
    pdf.insert(0, "entity", [f"e{i:03d}" for i in range(300)])
    return materialize(spark.createDataFrame(pdf)), pdf


def test_isolation_forest_finds_the_outlier_and_repeats(cloud):
    one = anomaly.forest_score(cloud[0], "entity", indices.INDICES, trees=50).toPandas().set_index("entity")
    assert one["forest_score"].idxmax() == "e000" and one["forest_score"].between(0, 1).all()
    assert one["forest_label"].sum() == pytest.approx(30, abs=1)
    two = anomaly.forest_score(cloud[0].repartition(3), "entity", indices.INDICES, trees=50).toPandas().set_index("entity")
    assert np.allclose(one["forest_raw"].sort_index(), two["forest_raw"].sort_index())


@pytest.mark.parametrize("rows", [40, 300, 4000, 4097, 15_000, 60_000])
def test_every_tree_is_grown_from_the_full_sample(spark, monkeypatch, rows):
    def count(key, pdf):
        return pd.DataFrame([[int(key[0]), 0, -1, 0.0, -1, -1, float(pdf["_k"].nunique())]], columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    monkeypatch.setattr(anomaly, "_grow", count)
    df = materialize(spark.range(rows).select(F.col("id").alias("entity"), F.rand(1).alias("x"), F.rand(2).alias("y")))
    seen = anomaly.grow_forest(df, "entity", ["x", "y"]).toPandas()
    assert len(seen) == anomaly.TREES and set(seen["depth"]) == {min(rows, anomaly.SAMPLE)}


def test_tail_score_matches_numpy(cloud):
    got = anomaly.tail_score(cloud[0]).toPandas().set_index("entity").sort_index()
    total = 0
    for c in indices.INDICES:
        x = cloud[1][c]
        left, right = -np.log(x.rank(method="max") / 300), -np.log((-x).rank(method="max") / 300)
        skew = ((x - x.mean()) ** 3).mean()
        total = total + np.maximum(np.maximum(left, right), left if skew < 0 else right)
    assert np.allclose(got["ecod_raw"], total)
    assert got["ecod_label"].sum() == 30


def test_detect_ranks_by_severity(cloud):
    got = anomaly.detect(cloud[0]).toPandas().set_index("entity")
    assert got.loc["e000", "severity_rank"] == 1 and got.loc["e000", "ensemble_flag"] == 1


def test_attributions_add_up(spark, cloud):
    df = cloud[0].withColumn("priority", F.col("maturity") * 2 + F.abs("pressure") + F.col("volatility") * F.col("maturity"))
    fitted = attribution.fit_surrogate(df, features=indices.INDICES, trees=8)
    out = attribution.attribute(fitted, spark).toPandas()
    phi = np.stack(out["contributions"].to_numpy())
    assert np.abs(phi.sum(axis=1) + out["base"] - out["prediction"]).max() < 1e-6
    assert np.abs(phi).mean(axis=0)[3] < np.abs(phi).mean(axis=0)[0]


def test_shapley_equals_the_average_over_all_orders():
    # leaves of x0 <= 0 ? (x1 <= 1 ? 1 : 5) : 9 with covers 0.6/0.4 and 0.5/0.5
    inf = np.inf
    leaves = [
        (1.0, [(0, -inf, 0.0, 0.6), (1, -inf, 1.0, 0.5)]),
        (5.0, [(0, -inf, 0.0, 0.6), (1, 1.0, inf, 0.5)]),
        (9.0, [(0, 0.0, inf, 0.4)]),
    ]
    x = np.array([[-1.0, 2.0], [3.0, 0.0]])

    def expected(row, known):
        return sum(v * np.prod([(lo < row[f] <= hi) if f in known else z for f, lo, hi, z in path]) for v, path in leaves)

    got = attribution.shapley(x, leaves)
    for r, row in enumerate(x):
        want = np.zeros(2)
        for order in permutations(range(2)):
            known = set()
            for f in order:
                before = expected(row, known)
                known = known | {f}
                want[f] += (expected(row, known) - before) / factorial(2)
        assert np.allclose(got[r], want)
    assert attribution.base_value(leaves) == pytest.approx(0.6 * 3 + 0.4 * 9)


def test_too_few_features_give_typed_empty_outputs(spark):
    out = attribution.run(spark.createDataFrame([("e", 1.0, 2.0)], "entity string, a_total double, priority double"))
    assert out["attribution"].count() == 0 and "top_3_value" in out["attribution"].columns


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    x = np.r_[rng.normal(0.2, 0.03, (60, 4)), rng.normal(0.8, 0.03, (40, 4))]
    pdf = pd.DataFrame(x, columns=indices.INDICES)
    pdf.insert(0, "entity", [f"e{i:03d}" for i in range(100)])
    return spark.createDataFrame(pdf)


def test_mixture_run(blobs):
    out = cluster.run(blobs, k_range=(2, 3), seeds=(1, 2))
    sel = out["selection"].toPandas()
    assert sel["k"].tolist() == [2, 3] and np.isfinite(sel["aicc"]).all()
    got = out["clustered"].toPandas()
    probs = np.stack(got["probabilities"].to_numpy())
    assert np.allclose(probs.sum(axis=1), 1)
    cen = out["centroids"].toPandas().sort_values("cluster")
    assert cen["maturity"].is_monotonic_decreasing and cen["size"].sum() == 100
    assert abs(got["x_1"].corr(got["x_2"])) < 1e-6
    top = got.set_index("entity")["cluster"]
    assert top["e099"] == 0 and top["e000"] != 0


def test_small_tables_cap_k_and_infinite_criteria():
    assert cluster.criteria(25, 4, 2, -10.0)[2] == float("inf")
    aic, bic, aicc = cluster.criteria(500, 4, 2, -100.0)
    assert aic == pytest.approx(2 * 29 + 200) and aicc > aic and bic > aic


def test_profile_names_are_used_once():
    names = cluster.name_profiles(np.array([[0.9, 0.1, 0.0, 0.9], [0.1, 0.9, 0.9, 0.1], [0.9, 0.2, 0.1, 0.8]]), indices.INDICES)
    assert len(set(names)) == 3


def plain_density(x, w, mu, cov):
    """Weighted densities by the textbook formula."""
    out = []
    for a, m, c in zip(w, mu, cov):
        z = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
        out.append(a * np.exp(-z / 2) / np.sqrt((2 * np.pi) ** x.shape[1] * np.linalg.det(c)))
    return np.array(out).T


def test_one_pass_serves_all_mixtures(spark, blobs):
    vectors = cluster.assemble(blobs, indices.INDICES)
    x = np.array(vectors.select(*[f"z_{f}" for f in indices.INDICES]).collect())
    fits = cluster.fit_all(vectors, indices.INDICES, [(2, 1), (3, 2), (2, 5)], max_iter=3, tol=0.0)
    sums = cluster._pass(vectors, indices.INDICES, fits)
    for fit, got in zip(fits, sums):
        p = plain_density(x, fit.weights, fit.means, fit.covariances)
        share = p / p.sum(1, keepdims=True)
        want = np.r_[np.log(p.sum(1)).sum(), share.sum(0), (share.T @ x).ravel(), np.einsum("nk,ni,nj->kij", share, x, x).ravel()]
        assert np.allclose(got, want) and fit.log_likelihood == pytest.approx(want[0])


def test_mixtures_do_not_depend_on_partitions_and_gain_likelihood(blobs):
    a, b = ([cluster.fit_all(cluster.assemble(blobs, indices.INDICES).repartition(n), indices.INDICES, [(2, 1), (3, 1)], max_iter=m) for n, m in ((3, 100), (1, 100))])
    for f, g in zip(a, b):
        assert f.converged and f.log_likelihood == pytest.approx(g.log_likelihood) and np.allclose(f.means, g.means)
    early = cluster.fit_all(cluster.assemble(blobs, indices.INDICES), indices.INDICES, [(2, 1), (3, 1)], max_iter=1, tol=0.0)
    assert all(e.log_likelihood <= f.log_likelihood + 1e-6 and not e.converged for e, f in zip(early, a))


def test_assignment_is_the_textbook_one(blobs):
    vectors = cluster.assemble(blobs, indices.INDICES)
    mix = cluster.select_and_fit(vectors, indices.INDICES, (2, 3))
    rows = cluster.assign(vectors, mix).toPandas()
    p = plain_density(rows[[f"z_{f}" for f in indices.INDICES]].to_numpy(), mix.weights, mix.means, mix.covariances)
    assert np.allclose(np.stack(rows.probabilities.to_numpy()), p / p.sum(1, keepdims=True)) and (rows.cluster == p.argmax(1)).all()
    assert rows.loc[rows.entity == "e099", "cluster"].item() == 0
