import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelwise.llm import repair
from panelwise.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
LETTER = {0: "s", 1: "u", 2: "a", 3: "x"}


def plain_solve(rows):
    """(cost, audit, kept) over all edits, at most two insertions at a place; ``rows`` are (initial, must go, truncated)."""
    best = None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u"), ("u", "u"), ("a", "a")]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        if sum(map(len, inserts)) > 3:
            continue
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, roles = 0, "", ""
            for k, ins in enumerate(inserts):
                cost, audit, roles = cost + 2 * len(ins), audit + "I" * len(ins), roles + "".join(ins)
                if k == len(rows):
                    continue
                initial, gone, cut = rows[k]
                e = edits[k]
                if e == "D":
                    cost, audit = cost + 3, audit + "D"
                elif gone:
                    break
                else:
                    cost, audit = cost + (0 if e == "K" else 2) + cut, audit + ("K" if e == "K" else "R")
                    roles += initial if e == "K" else e
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def symbols(rows):
    return bytes("suax".index(i) | (4 if gone else 0) | (8 if cut else 0) for i, gone, cut in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_least_integer_is_the_cheapest_and_least_audit(n):
    rng = random.Random(n)
    kinds = [(i, g, c) for i in "suax" for g, c in ((0, 0), (1, 0), (0, 1))]
    cases = itertools.product(kinds, repeat=n) if n < 2 else [[rng.choice(kinds) for _ in range(n)] for _ in range(40 if n == 3 else 100)]
    for rows in cases:
        rows = list(rows)
        for chunk in (1, 2, 64):
            assert repair.solve(symbols(rows), chunk) == plain_solve(rows), (rows, chunk)


def test_chunks_do_not_change_long_audits():
    rng = random.Random(1)
    for n in (63, 64, 65, 500):
        line = bytes(rng.choice((0, 1, 1, 2, 2, 3)) | rng.choice((0, 0, 0, 4, 8)) for _ in range(n))
        assert len({repair.solve(line, chunk) for chunk in (1, 7, 64, n)}) == 1


def plain_check(rows):
    """Contract columns by conversation, in plain Python."""
    show = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = show(role), show(text)
            hit = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, marks, n = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t"
            seen.add((role, text))
            if fault:
                n[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            marks.append((initial, fault in ("b", "d") and bool(fault), fault == "t"))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = repair.solve(symbols(marks), 10_000)
        kept, todo, last = [], iter(own), ""
        for e in audit:
            row = None if e == "I" else next(todo)
            if e == "D":
                continue
            last = row[1] if e == "K" else "assistant" if last[:1] == "u" else "user"
            kept.append((last, "" if e == "I" else row[2]))
        assert next(todo, None) is None and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, digest, kept)
    return out


def assert_same(spark, rows, df=None):
    df = spark.createDataFrame(rows, SCHEMA) if df is None else df
    want = plain_check(rows)
    damaged, found = repair.check(df)
    got = found.join(repair.digests(damaged, found).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id][:8], r
    texts = {}
    for r in sorted(repair.repaired(damaged, found).collect(), key=lambda r: r.position):
        texts.setdefault(r.conv_id, []).append((r.role, r.text))
    assert texts == {c: w[8] for c, w in want.items() if w[8]}


def test_query_equals_plain_version(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_check(rows)
    got = {r.conv_id: r for r in QUERIES["op11_repair"](spark, data_dir).collect()}
    assert got.keys() == want.keys()
    for c, r in got.items():
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[c][:8]


def test_nulls_ties_repeats_blanks_and_foreign_roles(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\x0b", "Yes.", "Yes", "No!\n ", "ü? ", "é漢.x", "\x85.", "a\nb."]
    roles = [None, "", "user", "assistant", "system", "sys", "tool", "User", "ü"]
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(250)]
    rows += rows[:40] + [(77, None, None, None)] * 3
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "gone."))
    assert plain_check(rows)[dropped][:8] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert_same(spark, rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(1, rng.randrange(4000), rng.choice(["user", "assistant"]), rng.choice(["ok.", "ok", f"text {k}."])) for k in range(5000)]
    rows += [(2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "y." + " " * 100_000)]
    assert_same(spark, rows)


def test_empty_table_and_clashing_names(spark):
    damaged, found = repair.check(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and repair.digests(damaged, found).count() == 0 and repair.repaired(damaged, found).count() == 0
    rows = [(1, 2, "user", "Hi."), (1, 3, "assistant", "Ho."), (None, None, "user", "Hi.")]
    odd = spark.createDataFrame([(*r, 9, "z", "z", 5, True) for r in rows], SCHEMA + ", copies long, print string, audit string, hit int, first boolean")
    assert_same(spark, rows, odd)
