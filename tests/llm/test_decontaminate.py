import random
from collections import Counter

import pytest

from panelwise.llm import decontaminate as d
from panelwise.llm.queries import QUERIES


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    items = {k: words(rng, n) for k, n in enumerate((30, 12, 50, 5, 3, 30))}
    texts = {}
    for k in range(60):
        own = words(rng, rng.randint(20, 200))
        if k % 3 == 0:
            item = list(items[k // 3 % 6])
            if k % 2 and len(item) > 20:
                item[10] = "changed"
            at = rng.randrange(len(own))
            own[at:at] = item
        texts[k] = " ".join(own)
    texts[100], texts[101], texts[102] = None, "", " ".join(items[0]).upper().replace(" ", ",  ")
    texts[103] = " ".join(items[2][:46])  # shorter than the item
    return items, texts


def weighted(a, b, width):
    def bag(w):
        return Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))

    weight = lambda s: sum(map(len, s))
    x, y = bag(a), bag(b)
    inter = sum(min(x[s], y[s]) * weight(s) for s in x)
    return inter / (sum(c * weight(s) for s, c in x.items()) + sum(c * weight(s) for s, c in y.items()) - inter)


def brute(items, texts, least=0.8):
    out = {}
    for t, text in texts.items():
        w = d.words_of(text)
        for i, item in items.items():
            item = [x.encode() for x in item]
            width = min(5, len(item))
            size = min(len(item), len(w))
            if size < width:
                continue
            best = max((weighted(w[k : k + size], item, width) for k in range(len(w) - size + 1)), default=0)
            if best >= least:
                out[t, i] = round(best, 9)
    return out


def frames(spark, case):
    items, texts = case
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(None, "x y z"), (9, None), (10, " ,")], "item_id long, text string")
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench


def test_equals_brute_force(spark, case, monkeypatch):
    docs, bench = frames(spark, case)
    want = brute(*case)
    assert len(want) > 15
    for chars in (d.BLOCK_CHARS, 200):  # one block, then several
        monkeypatch.setattr(d, "BLOCK_CHARS", chars)
        got = {(r.id, r.item): round(r.similarity, 9) for r in d.contaminated(docs, bench).collect()}
        assert got == want
        assert {r.doc_id for r in d.keep_clean(docs, bench).collect()} == set(case[1]) - {t for t, _ in want}


def test_empty_tables_and_repeated_rows(spark, case):
    docs, bench = frames(spark, case)
    twice = docs.where("doc_id = 0").union(docs.where("doc_id = 0"))
    assert d.contaminated(twice, bench.union(bench)).count() == 2
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).count() == 0
    assert d.keep_clean(docs, bench.limit(0)).count() == docs.count()


def test_index_finds_every_print_within_the_radius():
    rng = random.Random(6)
    near = lambda a, b: any((a >> 8 * k & 255 ^ b >> 8 * k & 255).bit_count() <= d.RADIUS // d.BLOCKS for k in range(d.BLOCKS))
    for _ in range(500):
        a = rng.getrandbits(64)
        assert near(a, a ^ sum(1 << b for b in rng.sample(range(64), d.RADIUS)))


def test_query_finds_planted_items(spark, data_dir):
    got = QUERIES["op3_decontamination"](spark, data_dir).toPandas()
    docs = dict(spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect())
    bench = dict(spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect())
    flat = lambda t: b" ".join(d.words_of(t))
    shown = {(i, k) for k, b in bench.items() for i, t in docs.items() if flat(b) in flat(t)}
    assert shown and shown <= set(zip(got.doc_id, got.item_id))
