import random
import re
from collections import Counter, defaultdict

import pytest

from panelwise.llm import divergence
from panelwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, min_docs=10, ranks=10):
    """The contract's rows from dense tables in Python integers."""
    docs, lang_n, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        docs[lang].update(set(terms))
        lang_n[lang].update(terms)
        own[lang, source].update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(lang_n[lang])
        sources = [s for g, s in groups if g == lang]
        p = {s: shares(own[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def got(df, **kw):
    found = [tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_query_equals_plain_version(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    found = QUERIES["op13_divergence"](spark, data_dir)
    assert {tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_audit(rows)


def corpus(n, words, sources, seed=0):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", " ", "-"]).join(rng.choice(words) + rng.choice([" ", ".", "_", "9", "\x00"]) for _ in range(rng.randrange(12)))
    return [(k, rng.choice([None, "", text(), text(), text()]), rng.choice([None, "", "en", "de", "één"]), rng.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("entries", [1, 1 << 17])
def test_nulls_ties_repeats_and_small_memory(spark, monkeypatch, entries):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rows = corpus(300, ["The", "the", "ÄB", "äb", "naïve", "x", "KK", "漢字", "😀b", "zz", "Zz", "q", "\x7fr", "\x80s"], [None, "", "a", "b", "ä", "B"])
    rows += rows[:60]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain_audit(rows)
    assert got(spark.createDataFrame(rows, SCHEMA), min_docs=1, ranks=3) == plain_audit(rows, 1, 3)


def test_many_equal_values_hot_source_and_rare_language(spark):
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    rows = [(k, " ".join(words), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(60)] + [(99, " ".join(words[:50]), "en", "last"), (100, "rare words only", "xx", "one"), (101, None, "xx", "two")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain_audit(rows)


def test_very_long_text_in_pieces(spark, monkeypatch):
    assert sum(map(len, divergence._terms("Ab cé " * 400_000))) == 800_000
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for part in divergence._terms("abcdefghijkl mn,OPé q") for t in part] == ["abcdefghijkl".encode(), b"mn", "opé".encode(), b"q"]


def test_empty_table_and_clashing_names(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = corpus(80, ["a", "b", "c"], ["x", "y"])
    names = ["term", "n", "total", "terms", "value", "item", "rank", "part", "p", "q", "s1", "size"]
    odd = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    assert got(odd) == plain_audit(rows)


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(9_000_000_000_000), divergence.F.lit(50_000_000_000_000), divergence.F.lit(7)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * 9_000_000_000_002 // 50_000_000_000_014
