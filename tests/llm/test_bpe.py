import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelwise.llm import bpe
from panelwise.llm.queries import QUERIES, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.merges.ranks, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_random_texts_equal_the_library(codec, reference):
    rng = random.Random(3)
    parts = ["ab", "abcdefghij eno", "\x00\x1c é漢字😀", "  \n\t", "aaaa", "etsin", "1234", "<|endoftext|>", "'s 'll"]
    texts = ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    assert codec.encode_all(texts) == [packed(reference.encode_ordinary(t)) for t in texts]
    assert [codec.decode(i) for i in codec.encode_all(texts)] == [t.encode() for t in texts]


@pytest.mark.parametrize("piece", ["a" * 30_000, "ab" * 10_000, "etaoin" * 3000])
def test_very_long_pretokens(codec, reference, piece):
    assert codec.encode_all([piece])[0] == packed(reference.encode_ordinary(piece))


def test_lockstep_equals_the_queue(codec):
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"aeinorst \xc3\xa9") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [b"", b"aaaa", b""]
    for x, y in zip(codec.merges.merge(pieces), codec.merges.lockstep(pieces)):
        assert (x == y).all()


def test_ranks_out_of_order_still_go_lowest_first():
    # merging "bc" makes a pair of lower rank: positions must go one by one
    ranks = {bytes([b]): b for b in range(256)} | {b"bcb": 256, b"bc": 257, b"bcbc": 258}
    merges = bpe.Merges(ranks)
    plain = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    for text in ("bcbc", "bcbcbc", "abcbcbcb", "bcb" * 7):
        assert merges.merge([text.encode()])[0].tolist() == plain.encode_ordinary(text)


def test_memory_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Codec(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for k in range(30):
        own.encode_all([" ".join(f"w{k}x{j}" for j in range(20))])
        assert len(own.known) <= 60


def test_query_digests_and_null_texts(spark, data_dir, reference):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").toPandas()
    got = QUERIES["op1_byte_bpe"](spark, data_dir).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        ids = reference.encode_ordinary(text or "")
        want = len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert tuple(got.loc[i][["n_tokens", "ids_sha256", "decoded_sha256"]]) == want
    tokenizer = vocabulary(spark)
    rows = spark.createDataFrame([(1, None), (2, ""), (2, "one two"), (2, "one two")], "doc_id long, text string")
    ids = rows.select("doc_id", tokenizer.encode("text").alias("ids")).select("doc_id", bpe.n_tokens("ids").alias("n"), bpe.unpack("ids").alias("a"))
    assert sorted((r.doc_id, r.n, len(r.a)) for r in ids.collect()) == [(1, 0, 0), (2, 0, 0), (2, 2, 2), (2, 2, 2)]
    assert rows.limit(0).select(tokenizer.encode(F.col("text"))).count() == 0


def test_merging_holds_few_bytes_a_byte(codec, reference):
    rng = random.Random(9)
    pieces = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(20_000)]
    raw = [p.encode() for p in pieces]
    tracemalloc.start()
    ids, bounds = codec.merges.merge(raw)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 80 * sum(map(len, raw))  # 112 with 64-bit places and lists of Python numbers
    assert [ids[a:b].tolist() for a, b in zip(bounds[:200], bounds[1:201])] == [reference._encode_single_piece(p) for p in raw[:200]]


def test_a_worker_holds_the_results_of_one_chunk(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    texts = ["one two three " * k for k in range(9)] + [None, "", "four"]
    parts = list(bpe._both(codec, pa.array(texts)))
    assert len(parts) > 3 and max(map(len, parts)) < len(texts)
    want = [packed(reference.encode_ordinary(t or "")) for t in texts]
    assert [x["ids"] for part in parts for x in part.to_pylist()] == want
    assert [x["decoded"] for part in parts for x in part.to_pylist()] == [(t or "").encode() for t in texts]
    assert list(bpe._both(codec, pa.array([], pa.string()))) == []


def test_round_trip_keeps_every_row(spark, reference):
    rows = [(k, None if k % 7 == 0 else f"text {k} " * (k % 11)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = df.select("doc_id", vocabulary(spark).round_trip("text").alias("both")).selectExpr("doc_id", "both.*").collect()
    want = {k: (packed(reference.encode_ordinary(t or "")), (t or "").encode()) for k, t in rows}
    assert {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in got} == want
