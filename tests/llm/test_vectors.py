import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.llm import vectors as v
from panelwise.llm.queries import QUERIES


def brute(rows, chosen, k=5):
    ok = [(i, np.array(x, float)) for i, x in dict.fromkeys((i, tuple(x)) for i, x in rows if i is not None and x and None not in x) if np.isfinite(np.array(x, float)).all() and any(x)]
    out = {}
    for i, a in ok:
        if chosen(i):
            near = sorted((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), j) for j, b in ok if j != i and len(a) == len(b))
            out[i] = [(j, round(-s, 9)) for s, j in near[:k]]
    return out


def found(df, chosen):
    out = {}
    for r in v.nearest(df, chosen).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def test_odd_vectors_and_a_frequent_one(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(0, 120)]  # one vector, many rows
    rows += [(k, rng.standard_normal(3).round(2).tolist()) for k in range(120, 160)]
    rows += [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 2.0]), (350, [float("nan"), 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0]), (450, []), (None, [1.0, 1.0, 1.0])]
    rows += [(500, [1.0, 1.0]), (501, [2.0, 1.0]), (150, rows[150][1])]
    df = spark.createDataFrame([(i, x, 0, 1.0) for i, x in rows], "vec_id long, embedding array<float>, shard int, score double")
    want = brute([(i, np.array(x, np.float32).tolist() if x and None not in x else x) for i, x in rows], lambda i: i % 50 == 0)
    assert found(df, F.col("id") % 50 == 0) == want
    assert want[500] == [(501, round(3 / np.sqrt(10), 9))]
    assert v.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_recall_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(v, "SHARD_ROWS", (400, 400))
    monkeypatch.setattr(v, "BLOCK", 24 * 30)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    points = centres[rng.integers(0, 40, 2500)] + 0.5 * rng.standard_normal((2500, 24))
    rows = [(k, p.astype(np.float32).tolist()) for k, p in enumerate(points)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0)
    want = brute(rows, lambda i: i % 50 == 0)
    assert got.keys() == want.keys()
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want]) >= 0.95


@pytest.mark.parametrize("n", [1, 2, 20, 300])
def test_graph_shape(n):
    points = np.random.default_rng(3).standard_normal((n, 8)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    edges, entry = v.build_graph(points)
    assert edges.shape == (n, v.DEGREE) and 0 <= entry < n
    for k in range(n):
        own = edges[k][edges[k] >= 0]
        assert len(set(own.tolist())) == len(own) and k not in own


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([(r[0], r[1]) for r in e], lambda i: i % 50 == 0)
    got = QUERIES["op6_nearest"](spark, sf).toPandas()
    hits = sum(len(set(got[got.query_id == q].vec_id) & {j for j, _ in w}) for q, w in want.items())
    assert hits >= 0.95 * 5 * len(want)
