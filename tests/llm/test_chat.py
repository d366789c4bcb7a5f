import duckdb
import pytest

from check import normal
from panelwise.llm import chat
from panelwise.llm.queries import QUERIES, SQL

TURNS = "conv_id long, turn long, role string, text string, pair_id int, chosen string"


def plain(turns, pairs):
    own = {}
    for c, t, r, x in {row[:4] for row in turns}:
        own.setdefault(c, []).append((t, r, x))
    show = lambda t: f"<|{t[1] or ''}|>\n{(t[2] or '').replace('<|', '< |')}\n"
    out = []
    for p, a, b in pairs:
        low = lambda v: (v is not None, v if v is not None else 0 if not isinstance(v, str) else "")
        key = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
        x, y = sorted(own.get(a, []), key=key), sorted(own.get(b, []), key=key)
        n = 0
        while n < min(len(x), len(y)) and x[n][1:] == y[n][1:]:
            n += 1
        row = [p, a, b, n, "".join(map(show, x[:n]))]
        masks = []
        for side in (x[n:], y[n:]):
            row.append("".join(map(show, side)))
            at, spans = 0, []
            for t in side:
                if t[1] == "assistant":
                    spans.append(f"{at + 14}:{at + len(show(t))}")
                at += len(show(t))
            masks.append(",".join(spans))
        out.append(tuple(row + masks))
    return sorted(out)


def test_edge_cases_equal_a_plain_version(spark):
    turns = [
        (0, 0, "user", "hi", 7, "x"), (0, 1, "assistant", "hello <|user|>", 7, "x"), (0, 2, "user", None, 7, "x"), (0, 3, "assistant", "déjà 漢", 7, "x"),
        (1, 0, "user", "hi", 7, "x"), (1, 1, "assistant", "hello <|user|>", 7, "x"), (1, 2, "user", "more", 7, "x"),
        (2, 0, "user", "same", 1, "x"), (3, 0, "user", "same", 1, "x"), (3, 0, "user", "same", 2, "y"),  # equal, with a repeated turn
        (4, None, None, None, 1, "x"), (5, 0, "assistant", "", 1, "x"), (None, 0, "user", "lost", 1, "x"), (9, 0, "user", "alone", 1, "x"),
    ]
    df = spark.createDataFrame(turns, TURNS)
    pairs = [(0, 0, 1), (1, 2, 3), (2, 5, 4), (7, 0, 77)]
    got = chat.preferences(df, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long"))
    assert sorted(tuple(r) for r in got.collect()) == plain(turns, pairs)
    found = sorted((r.pair_id, r.chosen_id, r.rejected_id) for r in chat.neighbours(df).collect())
    assert found == [(0, 0, 1), (1, 2, 3), (2, 4, 5)]
    assert chat.preferences(df.limit(0), chat.neighbours(df.limit(0))).count() == 0


@pytest.mark.parametrize("key", ["op8_preferences", "op9_url_reputation"])
def test_queries_equal_their_sql(spark, data_dir, key):
    con = duckdb.connect()
    for t in ("conversations", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    assert normal(QUERIES[key](spark, data_dir).toPandas()) == normal(con.execute(SQL[key]).df())
