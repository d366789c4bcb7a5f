import random
from itertools import combinations

import numpy as np
import xxhash

from panelwise.llm import simhash
from panelwise.llm.components import components
from panelwise.llm.queries import QUERIES


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints, radius=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    group = {}
    for k in range(len(ids)):
        group.setdefault(find(k), []).append(ids[k])
    return {ids[k]: min(group[find(k)]) for k in range(len(ids))}


def test_query_equals_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").toPandas()
    got = QUERIES["op7_simhash"](spark, data_dir).toPandas().set_index("doc_id")
    prints = [plain_print(t) for t in docs.text]
    assert [int(got.loc[i].fingerprint, 16) for i in docs.doc_id] == prints
    want = plain_components(docs.doc_id.tolist(), prints)
    assert {i: got.loc[i].component_id for i in docs.doc_id} == want


def test_every_pair_within_the_radius_shares_a_key():
    for radius, segments in ((2, 8), (3, 8), (1, 4)):
        masks = [m for _, m in simhash.chain_masks(radius, segments)]
        rng = random.Random(1)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(diff & m == 0 for m in masks)
            assert simhash._ring_ok(np.array([diff], np.uint64), radius, segments)[0]


def prints_of(spark, values):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    return spark.createDataFrame(list(enumerate(signed)), "id long, fp long")


def test_classes_of_crowded_prints(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(50)})
    want = plain_components(list(range(len(values))), values)
    found = simhash.classes(prints_of(spark, values), 2, 8).collect()
    assert {values.index(r.fp & (1 << 64) - 1): r.component_id for r in found} == want


def test_small_and_large_buckets_link_alike(monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fp = np.array(sorted({base ^ rng.getrandbits(9) ^ rng.getrandbits(4) << 20 for _ in range(120)}), np.uint64)
    size = np.full(len(fp), len(fp))
    roots = []
    for limit in (1000, 2):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        roots.append(simhash._roots(len(fp), *simhash._bucket_links(fp, size, 2, 8)).tolist())
    assert roots[0] == roots[1]
    want = plain_components(list(range(len(fp))), [int(x) for x in fp])
    assert roots[0] == [want[k] for k in range(len(fp))]


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, "one two three four", 1), (5, None, 2), (4, "", 3), (3, "one two three four", 4), (3, "one two three four", 5), (9, "other words entirely here now", 6)], "doc_id long, text string, fp int")
    got = sorted(((r.id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 3), (5, 4), (4, 4), (3, 3), (3, 3), (9, 9)], key=str)
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 9]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert simhash.keep_one(nulls).count() == 1


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar_sets(rng, size, number, similarity=0.8):
    """Pairs of sets of ``size`` hashes of that similarity or a little more."""
    common = -int(-2 * size * similarity // (1 + similarity))
    drawn = [rng.integers(0, 1 << 32, 2 * size - common, dtype=np.uint64) for _ in range(number)]
    return [(d[:size], d[size - common :]) for d in drawn]


def as_bytes(sets):
    return np.frombuffer(b"".join(map(simhash.wide_print, sets)), np.uint8).reshape(len(sets), -1)


def test_chains_of_wide_prints_find_similar_sets_and_few_others():
    rng = np.random.default_rng(4)
    for size in (12, 80, 300):
        a, b = (simhash.chains(as_bytes(x)) for x in zip(*similar_sets(rng, size, 600)))

        def met(x, y):
            near = np.bitwise_count(x[1] ^ y[1]).astype(int)
            far = np.bitwise_count(x[2] ^ y[2])
            return ((x[0] == y[0]) & (near <= simhash.NEAR) & (near + far <= simhash.FAR)).any(0)

        assert met(a, b).mean() >= 0.98
        assert met(a, [np.roll(part, 1, 1) for part in b]).sum() == 0


def test_wide_buckets_hold_all_pairs_whose_chains_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    core = rng.integers(0, 1 << 32, 200, dtype=np.uint64)
    crowd = [np.concatenate([core, rng.integers(0, 1 << 32, rng.integers(1, 8), dtype=np.uint64)]) for _ in range(60)]
    sets = [s for pair in similar_sets(rng, 60, 40) for s in pair] + crowd + [rng.integers(0, 1 << 32, 40, dtype=np.uint64) for _ in range(40)]
    prints = as_bytes(sets)
    rows = spark.createDataFrame([(k, len(s), bytes(p)) for k, (s, p) in enumerate(zip(sets, prints.copy()))], "node long, size int, print binary")
    held = {}
    for r in simhash.wide_buckets(rows, 0.8).collect():
        held.setdefault(r.key, set()).add(r.content)
    key, near, far = simhash.chains(prints)
    for a, b in combinations(range(len(sets)), 2):
        near_bits = np.bitwise_count(near[:, a] ^ near[:, b]).astype(int)
        ok = (key[:, a] == key[:, b]) & (near_bits <= simhash.NEAR) & (near_bits + np.bitwise_count(far[:, a] ^ far[:, b]) <= simhash.FAR)
        if ok.any() and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
            assert any({a, b} <= b_ for b_ in held.values())
    assert {0, 1} <= set().union(*held.values()) and len(held) < len(sets)

    # links contracted on the way give the same rows, a crowded bucket goes on whole
    one = np.flatnonzero(key[0] == np.bincount(key[0]).argmax())
    one = one[np.argsort([len(sets[k]) for k in one], kind="stable")]
    args = key[0][one], np.array([len(sets[k]) for k in one]), near[0][one], far[0][one], 0.8
    roots = simhash._chain_roots(*args)
    monkeypatch.setattr(simhash, "HELD", 1)
    assert (simhash._chain_roots(*args) == roots).all()
    monkeypatch.setattr(simhash, "CROWDED", 2)
    assert (simhash._chain_roots(*args) == 0).all()
