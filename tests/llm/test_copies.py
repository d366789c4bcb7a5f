import random

import corpus_pipeline
from panelwise.llm import copies, simhash


def jaccard(a, b):
    x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_the_stage_drops_edited_copies_and_keeps_clean_documents(spark):
    rng = random.Random(8)
    clean = [[f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 300))] for _ in range(150)]
    copies, far = [], []
    for t in clean:
        for edits in range(1, 6):
            new = list(t)
            for at in rng.sample(range(len(t)), edits):
                new[at] = f"edit{rng.randrange(10**6)}"
            # of a borderline copy neither is asked for: it may be near another copy
            (copies if jaccard(t, new) >= 0.8 else far).append(new)
    rows = [(k, " ".join(t)) for k, t in enumerate(clean + copies)] + [(None, "only here and nowhere else at all"), (None, "another text without any id here"), (9000, "a b"), (9001, "A  b"), (9002, "c d")]
    rows += [rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_copies(spark, df, "").collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 9000]
    assert sorted(i for i in ids if i < len(clean)) == list(range(len(clean)))
    assert len(copies) > 300 and len(ids) - len(clean) <= 0.03 * len(copies)
    assert sorted(r.doc_id for r in kept if (r.doc_id or 0) >= 9000) == [9000, 9002]
    assert sum(r.doc_id is None for r in kept) == 2


def test_candidates_come_from_simhash_prints(spark, monkeypatch):
    """Without buckets of prints nothing but equal words is a copy."""
    text = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "more"])), (3, "  ".join(text))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in copies.keep_one(df).collect()] == [1]
    monkeypatch.setattr(copies, "wide_buckets", lambda prints, least: simhash.wide_buckets(prints.limit(0), least))
    assert sorted(r.doc_id for r in copies.keep_one(df).collect()) == [1, 2]
