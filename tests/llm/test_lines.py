import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from panelwise.llm import lines
from panelwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
BLANK = r"[\x20\x09-\x0D]+"


def plain_key(line):
    line = re.sub(rf"\A{BLANK}|{BLANK}\Z", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def plain_dedup(rows, least=10, min_docs=2):
    """Multiset of (id, n_lines, n_dropped, kept)."""
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(plain_key(line)) >= least:
                held[plain_key(line)].add(i)
    keep = {k: min((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = Counter()
    for i, text in rows:
        own = (text or "").split("\n")
        left = [line for line in own if plain_key(line) not in keep or keep[plain_key(line)] == i]
        out[i, len(own), len(own) - len(left), "\n".join(left)] += 1
    return out


def got(df, **kw):
    return Counter((r.id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup(df, **kw).collect())


def test_query_equals_plain_version(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_dedup(rows))
    found = QUERIES["op12_lines"](spark, data_dir).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == want
    assert any(r.n_dropped for r in found)


ODD = [
    (3, "A shared line here\nown line of three\nshort"), (1, "\x0b a SHARED line here \t\r\nshort\n\n"), (2, "a shared line here\nA shared line here"),
    (1, "a shared line here\nsecond text of one"), (None, "a shared line here\nnull line 123"), (None, "null line 123\nnull line 123"), (4, None), (5, ""), (5, ""),
    (6, "\n\n"), (7, "ÄÖÜ line äöü x\n\xa0a shared line here"), (8, "äöü line äöü x\nÄÖÜ LINE äöü X"), (9, "123456789\n1234567890"), (10, "123456789\n1234567890"),
    (11, "二十二十二十二十二十"), (12, "二十二十二十二十二十\nx"), (13, "only null and thirteen"), (None, "only null and thirteen"),
]


@pytest.mark.parametrize("hot", [0, 1, 3, 2000])
def test_nulls_ties_repeats_and_both_joins(spark, hot):
    assert got(spark.createDataFrame(ODD * 2, SCHEMA), hot=hot) == plain_dedup(ODD * 2)


@pytest.mark.parametrize("least,min_docs", [(1, 2), (10, 3), (0, 5)])
def test_other_limits(spark, least, min_docs):
    assert got(spark.createDataFrame(ODD, SCHEMA), least=least, min_docs=min_docs) == plain_dedup(ODD, least, min_docs)


def test_hot_line_and_very_long_text(spark):
    rng = random.Random(5)
    rows = [(k, "the line of them all\n" * rng.randrange(3) + f"line number {rng.randrange(50)}\nown line {k:08d}") for k in range(600)]
    rows.append((-1, "\n".join(f"line number {k % 100_000}" for k in range(200_000))))
    rows.append((601, "word " * 200_000 + "\n" + "word " * 200_000))
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain_dedup(rows)


def test_empty_table_and_clashing_names(spark):
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    names = ["id", "pa", "ka", "pos", "keep", "drops", "lines", "hot", "i"]
    odd = spark.createDataFrame([(*r, *names) for r in ODD], SCHEMA + "".join(f", {n} string" for n in names))
    assert got(odd) == plain_dedup(ODD)
