import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from panelwise.llm import language_model as lm

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def small_shape(n=300, seed=0):
    rng = np.random.default_rng(seed)
    return lm.shape_of(rng.integers(0, 100, n), 50, rng.random(n) < 0.4)


def test_every_token_is_scored_once():
    rng = np.random.default_rng(1)
    seq = [rng.integers(0, 300, k) for k in (0, 1, 5, 31, 32, 33, 55, 56, 57, 200)]
    inputs, targets, fresh, text = lm.windows(seq, 300)
    for k, s in enumerate(seq):
        assert targets[text == k][fresh[text == k]].tolist() == [*s.tolist(), 300]
        assert inputs[text == k][fresh[text == k]].tolist() == [300, *s.tolist()]
    # all but a text's first window see the overlap before their first scored place
    later = np.concatenate([[False], text[1:] == text[:-1]])
    assert (fresh[later].argmax(axis=1) == lm.WINDOW - lm.STRIDE).all()


def test_gradient():
    shape, rng = small_shape(), np.random.default_rng(2)
    seq = [rng.integers(0, 300, rng.integers(0, 80)) for _ in range(5)]
    inputs, targets, fresh, _ = lm.windows(seq, 300)
    w = {k: v.astype(np.float64) for k, v in lm.blank(shape).items()}
    rows, last, goal, on = shape.row[inputs], shape.cls[inputs].ravel(), shape.cls[targets].ravel(), fresh.ravel().astype(float)

    def loss():
        logits, _ = lm._forward(w, rows, last)
        return -(lm._log_probs(logits, goal) * on).sum() / on.sum()

    g = lm._gradient(w, rows, last, goal, on)
    for name in w:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        down = loss()
        w[name][at] += 1e-5
        assert np.isclose((up - down) / 2e-5, g[name][at], rtol=1e-3, atol=1e-8), name


def test_ids_are_probabilities_and_classes_are_pure():
    shape = small_shape()
    total = np.bincount(shape.cls, np.exp(shape.inside))
    assert np.allclose(total, 1)
    rng = np.random.default_rng(0)
    rng.integers(0, 100, 300)
    begins = rng.random(300) < 0.4
    assert ((shape.cls[:-1] >= shape.begins) == begins).all() and shape.cls[-1] >= shape.begins


def test_training_lowers_the_loss():
    shape, rng = small_shape(), np.random.default_rng(3)
    seq = [np.tile(rng.integers(0, 300, 6), 20) for _ in range(30)]
    pieces = [np.ones(len(s), int) for s in seq]
    shares = [np.full(len(s) + 1, 1e-9) for s in seq]
    trainer = lm.Trainer(shape, lm.blank(shape))
    before = lm.text_scores(shape, trainer.w, seq, pieces, shares).sum()
    for _ in range(20):
        trainer.learn(seq)
    assert lm.text_scores(shape, trainer.w, seq, pieces, shares).sum() > 0.8 * before


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.8)) % 3000}" for _ in range(3000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120))), k) for k in range(200)]
    rows += [(200, None, 1), (201, "", 1), (202, "x" * 30_000 + " ÉCOLE é W1\x0bW1\u00a0w1", 1), (None, "w1 w2", 1), (3, rows[3][1], 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, row int")


@pytest.mark.parametrize("top", [lm.TOP, 5, 0])
def test_counts_and_base_scores(spark, case, top):
    rows, df = case
    words = [(i, (t or "").encode().lower().split() + [b""]) for i, t, _ in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in words if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm.scored(df.selectExpr("doc_id id", "text"), lm.fit(df.selectExpr("doc_id id", "text"), PATH), top).toPandas()
    assert len(got) == len(rows)
    want = sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)
    names = [str(None) if np.isnan(i) else str(int(i)) for i in got.id]
    assert sorted(zip(names, got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score.round(6))) == want
    assert (got.score < 0).all() and np.isfinite(got.score).all()


def test_scores_do_not_depend_on_the_number_of_broadcast_words(spark, case):
    rows = case[1].where("doc_id IS NOT NULL").selectExpr("row", "doc_id id", "text")
    model = lm.fit(rows.select("id", "text"), PATH)
    found = {}
    for top in (lm.TOP, 50, 1, 0):
        got = lm.scored(rows.select("id", "text"), model, top).collect()
        found[top] = sorted((r.id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert found[50] == found[1] == found[0] == found[lm.TOP]


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_training_is_one_pass_over_all_training_texts(spark, case, rounds):
    rows, df = case
    train = [lm.words_of(t) for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    subwords = lm.Subwords(open(PATH, "rb").read())
    ids = sum(len(s) + 1 for s in subwords.encode_all(train)[0])
    assert lm.fit(df.selectExpr("doc_id id", "text"), PATH, rounds).trained == ids


def test_empty_tables(spark, case):
    _, df = case
    assert lm.scores(df.limit(0), PATH).count() == 0
    held = df.where("doc_id = 201")  # may be the only row, with or without a training row
    assert lm.scores(held, PATH).count() == 1


def plain_word_logs(shape, w, seq, pieces):
    """Log-probabilities of a text's words and end, one place at a time."""
    w, end = {k: v.astype(np.float64) for k, v in w.items()}, len(shape.cls) - 1
    targets, before = [*seq, end], [end, *seq]
    log_id, log_begin = [], []
    for t, goal in enumerate(targets):
        start = 0 if t < lm.WINDOW else -(-(t - lm.WINDOW + 1) // lm.STRIDE) * lm.STRIDE
        x = w["embed"][shape.row[before[start : t + 1]]]
        q, k, v = (x @ w["qkv"][:, i * lm.WIDTH : (i + 1) * lm.WIDTH] for i in range(3))
        a = np.exp(k @ q[-1] / np.sqrt(lm.WIDTH) + w["near"][: len(x)][::-1])
        h = x[-1] + (a / a.sum()) @ v @ w["out"]
        z = h + np.maximum(h @ w["up"] + w["up_b"], 0) @ w["down"]
        p = np.exp(z @ w["head"] + w["head_b"] + w["pair"][shape.cls[before[t]]])
        log_id.append(np.log(p[shape.cls[goal]] / p.sum()) + shape.inside[goal])
        log_begin.append(np.log(p[shape.begins :].sum() / p.sum()))
    out, at = [], 0
    for n in [*pieces, 1]:
        more = log_begin[at + n] if at + n < len(targets) else 0.0
        out.append(sum(log_id[at : at + n]) - log_begin[at] + more)
        at += n
    return np.array(out)


def test_scores_equal_a_plain_version_from_the_weights(spark, case):
    rows = [r for r in case[0] if r[0] is not None and r[0] != 202]
    df = case[1].where("doc_id <> 202").selectExpr("row", "doc_id id", "text")
    model = lm.fit(df.select("id", "text"), PATH)
    shape, w = model.fitted.value
    count = {bytes(r.word): r.n for r in model.words.collect()}
    subwords, want = lm.Subwords(open(PATH, "rb").read()), []
    for i, text, _ in rows:
        words = lm.words_of(text)
        ids, pieces = subwords.encode_all([words])
        own = np.exp(plain_word_logs(shape, w, ids[0].tolist(), pieces[0].tolist()))
        share = np.array([(count.get(x, 0) + 1) / (model.tokens + model.different + 1) for x in [*words, b""]])
        want.append((i, float(np.log10(lm.UNIGRAM * share + (1 - lm.UNIGRAM) * own).sum())))
    for top in (lm.TOP, 20):
        got = sorted((r.id, r.score) for r in lm.scored(df.select("id", "text"), model, top).collect())
        assert [i for i, _ in got] == sorted(i for i, _ in want)
        assert np.allclose([x for _, x in got], [x for _, x in sorted(want)], rtol=1e-4, atol=1e-3)


def test_unseen_texts_score_above_the_word_shares(spark):
    rng = random.Random(8)
    parts = ["th", "on", "er", "in", "re", "an", "ti", "es", "or", "at"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    follow = {w: rng.choice(words) for w in words}

    def text():
        out = [rng.choice(words)]
        while len(out) < 80:
            new = "".join(rng.choice(parts) for _ in range(4))  # mostly a word that no other text has
            known = follow[out[-1]] if out[-1] in follow and rng.random() < 0.8 else rng.choice(words)
            out.append(new if rng.random() < 0.05 else known)
        return " ".join(out)

    df = spark.createDataFrame([(k, text()) for k in range(2500)], "doc_id long, text string")
    got = lm.scores(df, PATH).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert got[0] > got[1], got


def test_packed_windows_hold_every_id_once():
    seq = [np.arange(5), np.arange(0), np.arange(100, 170)]
    inputs, targets, on = lm.packed(seq, 300)
    flat = [*range(5), 300, 300, *range(100, 170), 300]
    assert targets[on].tolist() == flat and inputs[on].tolist() == [300, *flat[:-1]] and (~on).sum() < lm.WINDOW


def test_a_step_equals_plain_adam_and_makes_no_new_weights():
    shape, rng = small_shape(), np.random.default_rng(4)
    want = {k: v.astype(np.float64) for k, v in lm.blank(shape).items()}  # in single precision Adam magnifies rounding
    trainer = lm.Trainer(shape, want)
    m, v = ({k: np.zeros_like(x) for k, x in want.items()} for _ in range(2))
    for step in range(1, 4):
        seq = [rng.integers(0, 300, n) for n in (0, 70, 300)]  # fewer windows than a batch holds
        inputs, targets, on = lm.packed(seq, 300)
        rate = lm.RATE * min(1.0, step / 20) / (1 + step / 400)
        g = lm._gradient(want, shape.row[inputs], shape.cls[inputs].ravel(), shape.cls[targets].ravel(), on.ravel().astype(float))
        for k, d in g.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.98 * v[k] + 0.02 * d * d
            want[k] = want[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-8)
        trainer.learn(seq)
        assert all(np.shares_memory(x, trainer.flat) for x in trainer.w.values())
    for k in want:
        assert np.allclose(trainer.w[k], want[k], atol=1e-5), k


@pytest.mark.parametrize("batch", [1, 7, 256])
def test_scores_are_the_same_for_any_batch(monkeypatch, batch):
    shape, rng = small_shape(), np.random.default_rng(5)
    w = lm.blank(shape)
    w["pair"] += rng.standard_normal(w["pair"].shape).astype(np.float32)
    seq = [rng.integers(0, 300, n) for n in (0, 1, 40, 500)]
    pieces = [np.ones(len(s), int) for s in seq]
    before = lm.word_logs(shape, w, seq, pieces)
    monkeypatch.setattr(lm, "SCORE_BATCH", batch)
    assert np.allclose(lm.word_logs(shape, w, seq, pieces), before, atol=1e-4)
    plain = np.concatenate([plain_word_logs(shape, w, s.tolist(), p) for s, p in zip(seq, pieces)])
    assert np.allclose(before, plain, atol=1e-4)
