import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from panelwise.llm import bpe, decontaminate, toxicity
from test_decontaminate import brute
from test_secrets import plain_base
from test_simhash import plain_components, plain_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "byte_bpe"]


@pytest.fixture(scope="module")
def rows(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


def plain_stay(text):
    """Smallest id of each class of documents of equal words or five-word Jaccard similarity of 0.8 or more."""
    words = {i: tuple((t or "").lower().encode().split()) for i, t in text.items()}
    sets = {i: {w[k : k + 5] for k in range(len(w) - 4)} for i, w in words.items()}
    root = {i: i for i in text}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in text:
        for b in text:
            if a < b and (words[a] == words[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(i for i in text if root[i] == i)


def test_each_stage_equals_a_plain_version_on_its_own_input(spark, data_dir, rows):
    docs = rows.toPandas()
    text = dict(zip(docs.doc_id, docs.text))
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["toxicity"](spark, rows, data_dir)
    assert kept.columns == COLUMNS
    model = toxicity.fit(rows, spark.read.parquet(f"{data_dir}/labels.parquet"))
    scored = toxicity.scored(rows, model).toPandas()
    assert {r.doc_id for r in kept.collect()} == set(scored[scored.predicted == 0].id)

    kept = stage["near_duplicates"](spark, rows, data_dir)
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == plain_stay(text)

    bench = {r.item_id: [w.decode() for w in decontaminate.words_of(r.text)] for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()}
    some = rows.where("doc_id < 60 AND n_chars < 3000")
    kept = stage["decontamination"](spark, some, data_dir)
    short = {r.doc_id: r.text for r in some.collect()}
    assert {r.doc_id for r in kept.collect()} == set(short) - {d for d, _ in brute(bench, short)}

    masked = stage["secrets"](spark, rows, data_dir)
    assert masked.columns == COLUMNS
    got = {r.doc_id: r for r in masked.collect()}
    assert got.keys() == text.keys()
    for i, t in text.items():
        assert got[i].n_chars == len(got[i].text)
        if got[i].text == t:
            assert plain_base(t) == ""
        else:
            # what is left of the text is unchanged and holds no secret
            assert re.fullmatch("(?s)" + ".+".join(map(re.escape, got[i].text.split("[SECRET]"))), t) and plain_base(got[i].text) == ""

    tokens = {r.doc_id: r for r in stage["byte_bpe"](spark, rows, data_dir).collect()}
    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in text.items():
        assert bytes(tokens[i].ids) == np.array(plain.encode_ordinary(t), "<u4").tobytes() and tokens[i].round_trip


def test_run_applies_all_stages(spark, data_dir, rows):
    docs = rows
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir)
    got = corpus_pipeline.run(spark, data_dir)
    shape = lambda df: sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in df.collect())
    assert shape(got) == shape(docs) and 0 < got.count() < rows.count()


def test_odd_rows_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, found string, id int, rows int"
    odd = [(None, None, None, None, None, "x", 1, 1), (1, "", "en", "s", 0, "x", 1, 1), (1, "", "en", "s", 0, "x", 1, 1), (2, "long " * 30_000, "en", "s", 150_000, "x", 1, 1)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert name == "byte_bpe" or docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        assert docs.count() == (3 if data else 0) - (1 if data else 0)


def test_columns_named_like_the_operators_own_stay(spark, tmp_path):
    names = [u + n for n in ("print", "stay_id", "stay_print", "i", "p", "toxic_found", "own_fp") for u in ("", "_")] + ["_spans", "spans", "PRINT_"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    texts = ["one text of several words that holds password=hunter2222 and more", "another text with nothing in it at all here", "another text with nothing in it at all here"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), *names) for k, t in enumerate(texts)], schema)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "benchmark words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    got = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == {0, 1} and "[SECRET]" in got[0].text and all(r[n] == n for r in got.values() for n in names)
