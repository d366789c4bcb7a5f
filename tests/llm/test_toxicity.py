import random

import pytest

from panelwise.llm import toxicity as tox
from panelwise.llm.queries import QUERIES


def plain_segments(scores):
    """All maximal segments by their definition: the best segment, then the same to its left and right."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    shift = lambda found, by: [(s, x + by, y + by) for s, x, y in found]
    return plain_segments(scores[:a]) + [(best[0], a, b)] + shift(plain_segments(scores[b:]), b)


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, -1, 1, 2, 4]) + rng.randint(1, 9) / 997 for _ in range(rng.randint(0, 14))]
        want = [(round(s, 9), a, b) for s, a, b in plain_segments(scores)]
        assert [(round(s, 9), a, b) for s, a, b in tox.segments(scores)] == want
    assert len(tox.segments([1.0, -2.0] * 100_000)) == 100_000


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        bad = k % 4 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vilest", "vileness", "rotten", "foulish"]) for _ in range(4)]
        rows.append((k, " ".join(words), None))
        labels.append((k, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, found string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(labelled):
    df, labels = labelled
    model = tox.fit(df, labels)
    got = tox.scored(df, model).toPandas()
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == (held.id % 4 == 0)).mean() > 0.97
    kept = tox.keep_clean(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(got[got.predicted == 0].id)


def test_odd_rows(spark, labelled):
    df, labels = labelled
    model = tox.fit(df, labels)
    rows = spark.createDataFrame([(None, "vilest rotten vilest rotten", "a"), (1, None, "b"), (1, None, "b"), (2, "", "c"), (3, "word1 " * 50_000 + "vilest rotten vileness foulish", "d")], "doc_id long, text string, score string")
    got = tox.scored(rows, model).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: (r.id is not None, r.id or 0))] == [1, 0, 0, 0, 1]
    assert all(0 <= r.score <= 1 for r in got) and tox.scored(rows.limit(0), model).count() == 0
    for none in (labels.where("toxic = 0"), labels.limit(0), labels.selectExpr("cast(null as long) doc_id", "toxic"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        assert {r.score for r in tox.scored(rows, tox.fit(df, none)).collect()} == {0.0}


def test_training_rows_are_bounded(labelled):
    _, labels = labelled
    named = labels.withColumnRenamed("doc_id", "id")
    few = tox.training_rows(named.union(named), 20).groupBy("toxic").count().collect()
    assert all(3 <= r["count"] <= 45 for r in few) and len(few) == 2


def test_query_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_toxicity"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
