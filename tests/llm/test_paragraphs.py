import random

import numpy as np
import pytest

from panelwise.llm import paragraphs as pg
from panelwise.llm.queries import QUERIES


def text_of(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_cuts_depend_on_their_surroundings_only():
    rng = random.Random(1)
    passage = text_of(rng, 70)
    inner = None
    for _ in range(20):
        a, b = text_of(rng, rng.randint(0, 60)), text_of(rng, rng.randint(0, 60))
        cut = pg.Cut(" ".join(a + passage + b))
        own = {(s - len(a), e - len(a), c) for s, e, c in zip(cut.starts, cut.ends, cut.contents()) if s - len(a) >= pg.REACH and e - len(a) <= 70 - pg.REACH}
        inner = own if inner is None else inner
        assert own == inner and own


def test_lines_and_odd_texts():
    for text in (None, "", " \n\n ", "one", "a b c\nd e f g h i j k l m n o p", "same " * 5000):
        cut = pg.Cut(text)
        n = len((text or "").split())
        assert sum(cut.ends - cut.starts) == n
        if n:
            assert cut.starts[0] == 0 and cut.bands(cut.shingles()).shape == (len(cut.starts), pg.BANDS)
    first, second = pg.Cut("x y\n" + " ".join(f"w{k}" for k in range(40))), pg.Cut(" ".join(f"w{k}" for k in range(40)))
    assert first.contents()[1:].tolist() == second.contents().tolist()


def jaccard(a, b):
    x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def as_paragraph(k, words):
    """A row of the paragraph table whose only paragraph is the whole text."""
    cut = pg.Cut(" ".join(words))
    cut.starts, cut.ends = np.array([0]), np.array([len(words)])
    s = cut.shingles()
    packed = (s[: len(words) - 4] >> np.uint64(32)).astype("<u4").tobytes()
    return k, int(cut.contents().view(np.int64)[0]), 0, len(words), cut.bands(s).view(np.int64)[0].tolist(), packed


@pytest.mark.parametrize("pairwise", [8, 2, 1000])
def test_links_equal_all_pairs_of_groups_of_near_copies(spark, monkeypatch, pairwise):
    monkeypatch.setattr(pg, "PAIRWISE", pairwise)
    rng = random.Random(4)
    words = []
    for g in range(3):
        base = text_of(rng, 90)
        for k in range(50):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(90)] = f"edit{g}x{k}x{rng.randrange(9)}"
            words.append(t)
    words += [text_of(rng, 60) for _ in range(20)]
    rows = [as_paragraph(k, t) for k, t in enumerate(words)]
    of = {r[1]: words[r[0]] for r in rows}
    root = {c: c for c in of}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(of)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if jaccard(of[a], of[b]) >= pg.SIMILARITY:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {c: find(c) for c in names if sum(find(o) == find(c) for o in names) > 1}
    parts = spark.createDataFrame(rows, "id long, content long, start int, end int, keys array<long>, shingles binary")
    got = {r.node: r.root for r in pg.linked(parts).collect()}
    # banding is probabilistic: nothing but true links, and nearly all of them
    assert all(find(c) == find(r) for c, r in got.items())
    assert len(want) > 30 and len(got) >= 0.97 * len(want)


def test_planted_passages_are_found_and_the_first_stays(spark):
    rng = random.Random(5)
    passages = [text_of(rng, rng.randint(52, 120)) for _ in range(10)]
    rows, holders = [], {k: [] for k in range(10)}
    for k in range(60):
        own = text_of(rng, rng.randint(30, 200))
        if k < 40:
            at = rng.randrange(len(own))
            own[at:at] = passages[k % 10]
            holders[k % 10].append(k)
        rows.append((k, " ".join(own) + "\nAll rights reserved. One two three four five six.", "x"))
    rows += [(None, rows[0][1], "x"), (70, None, "y"), (71, "", "y"), (3, rows[3][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = {r.id: r for r in pg.repeated(df).collect()}
    assert sum(set(h) <= set(got) for h in holders.values()) >= 9
    assert not [i for i in got if i >= 40]
    for h in holders.values():
        if set(h) <= set(got):
            assert got[h[0]].n_removed == 0 and all(got[i].n_removed > 0 for i in h[1:])
    assert pg.repeated(df.limit(0)).count() == 0


def test_the_join_beyond_the_filter_gives_the_same(spark, monkeypatch, data_dir):
    shape = lambda: sorted(map(tuple, QUERIES["op5_paragraphs"](spark, data_dir).collect()))
    small = shape()
    monkeypatch.setattr(pg, "SENT", 0)
    assert shape() == small and small
