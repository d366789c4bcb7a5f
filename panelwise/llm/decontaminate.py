"""Benchmark passages in texts: SimHash windows, multi-index Hamming lookup, exact verification.

For every distinct item size (in word shingles) a window of that size slides over the text.
A window's fingerprint is the sign of the weighted sum of its shingles' bit vectors, taken from
running sums. Item fingerprints are indexed by ``BLOCKS`` bytes: if two fingerprints differ in at
most ``RADIUS`` bits, at least one byte differs in at most ``RADIUS // BLOCKS`` bits, so the
union of the bytes' neighbourhoods holds every item within the radius. What is left after the full Hamming
check is verified by exact weighted-shingle similarity (weighted Jaccard of the two
multisets; a shingle weighs as many bytes as its words have).

A window that shares no shingle with an item of its size has similarity zero, so
only windows around shared shingles are fingerprinted. The benchmark is read in blocks of a bounded
number of characters; each block is broadcast and meets every text, so results don't depend on
the number of blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import HASHES, pick, release

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 8_000_000

#: What separates words, beside ASCII white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WIDE_MARKS = "«»“”„‘’¡¿…–—\u00a0"
_SPACES = bytes.maketrans(MARKS.encode(), b" " * len(MARKS))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
HIT = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("start_word", T.IntegerType()),
        T.StructField("end_word", T.IntegerType()),
        T.StructField("distance", T.IntegerType()),
    ]
)
HIT_ARROW = pa.list_(pa.struct([("item", pa.string()), ("similarity", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("distance", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words (UTF-8) between white space and marks."""
    low = (text or "").lower()
    for mark in WIDE_MARKS:
        if mark in low:
            low = low.replace(mark, " ")
    return low.encode().translate(_SPACES).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, from the worker's bounded memory."""
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every shingle of ``width`` words, from the words' hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = h[:n] * _ODD[0]
    h = h ^ (h >> np.uint64(29))
    for k in range(1, width):
        mixed += h[k : n + k] * _ODD[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _ODD[2]
    mixed ^= mixed >> np.uint64(29)
    return mixed


def weights(words: list[bytes], width: int) -> np.ndarray:
    """Bytes of the words of every shingle."""
    sums = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return (sums[width:] - sums[:-width]).astype(np.int32)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _signed_bits(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * weight[:, None]


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class _Size:
    """Items of one size: ``m`` shingles of ``width`` words."""

    def __init__(self, width: int, m: int, items: list[tuple[str, np.ndarray, np.ndarray]], radius: int):
        self.width, self.m, self.radius = width, m, radius
        self.names = [name for name, _, _ in items]
        self.counts = [Counter(h.tolist()) for _, h, _ in items]
        self.weights = [dict(zip(h.tolist(), w.tolist())) for _, h, w in items]
        self.prints = np.concatenate([_pack(_signed_bits(h, w).sum(axis=0, keepdims=True)) for _, h, w in items])
        self.known = np.unique(np.concatenate([h for _, h, _ in items]))
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= radius // BLOCKS
        bytes_of = self.prints.view(np.uint8).reshape(-1, 8)
        self.lookup = [near[:, bytes_of[:, b]] for b in range(BLOCKS)]  # byte value x item

    def similarity(self, item: int, h: np.ndarray, w: np.ndarray) -> float:
        mine, own = Counter(h.tolist()), self.counts[item]
        weight = self.weights[item] | dict(zip(h.tolist(), w.tolist()))
        shared = sum(min(c, own[s]) * weight[s] for s, c in mine.items() if s in own)
        whole = sum(c * weight[s] for s, c in mine.items()) + sum(c * weight[s] for s, c in own.items()) - shared
        return shared / whole if whole else 0.0

    def search(self, h: np.ndarray, w: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, similarity, first shingle, past the last, distance) of windows around positions ``at``."""
        n, m = len(h), min(self.m, len(h))
        edge = np.zeros(n - m + 2, np.int64)
        np.add.at(edge, np.maximum(at - m + 1, 0), 1)
        np.add.at(edge, np.minimum(at, n - m) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1):
            for k in range(0, len(part), 4096):
                s = part[k : k + 4096]
                lo, hi = int(s[0]), int(s[-1]) + m
                run = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_signed_bits(h[lo:hi], w[lo:hi]), axis=0, dtype=np.int64)])
                fp = _pack(run[s - lo + m] - run[s - lo])
                bytes_of = fp.view(np.uint8).reshape(-1, 8)
                near = self.lookup[0][bytes_of[:, 0]]
                for b in range(1, BLOCKS):
                    near |= self.lookup[b][bytes_of[:, b]]
                window, item = np.nonzero(near)
                distance = np.bitwise_count(fp[window] ^ self.prints[item])
                for i in np.flatnonzero(distance <= self.radius):
                    a = int(s[window[i]])
                    if (x := self.similarity(int(item[i]), h[a : a + m], w[a : a + m])) >= least:
                        yield int(item[i]), x, a, a + m, int(distance[i])


class Index:
    """The items of one block."""

    def __init__(self, items: list[tuple[str, str]], least: float, radius: int):
        self.least = least
        grouped: dict[tuple[int, int], list] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(SHINGLE, len(words))
            h, w = shingles(hashes(words), width), weights(words, width)
            grouped.setdefault((width, len(h)), []).append((name, h, w))
        self.sizes = [_Size(width, m, own, radius) for (width, m), own in sorted(grouped.items(), key=lambda x: x[0])]
        self.widths = sorted({s.width for s in self.sizes})
        self.known, self.gate = {}, {}
        for width in self.widths:
            known = np.unique(np.concatenate([s.known for s in self.sizes if s.width == width]))
            gate = np.zeros(1 << 20, bool)
            gate[known >> np.uint64(44)] = True
            self.known[width], self.gate[width] = known, gate

    def find(self, text: str | None) -> list[dict]:
        words = words_of(text)
        each = hashes(words)
        best: dict[str, dict] = {}
        for width in self.widths:
            h = shingles(each, width)
            if not len(h):
                continue
            at = np.flatnonzero(self.gate[width][h >> np.uint64(44)])
            at = at[_among(h[at], self.known[width])]
            if not len(at):
                continue
            w = weights(words, width)
            for size in self.sizes:
                if size.width != width:
                    continue
                own = at[_among(h[at], size.known)]
                if not len(own):
                    continue
                for item, x, a, b, d in size.search(h, w, own, self.least):
                    name = size.names[item]
                    if name not in best or x > best[name]["similarity"]:
                        best[name] = {"item": name, "similarity": x, "start_word": a, "end_word": b + width - 1, "distance": d}
        return sorted(best.values(), key=lambda r: r["item"])


_BUILT: dict[int, tuple[object, Index]] = {}


def _built(shared, least: float, radius: int) -> Index:
    """The block's index, built once for each worker; the last block only is kept."""
    items = shared.value
    if _BUILT.get(0, (None,))[0] is not items:
        _BUILT[0] = (items, Index(items, least, radius))
    return _BUILT[0][1]


def _finder(shared, least: float, radius: int):
    @F.arrow_udf(T.ArrayType(HIT))
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _built(shared, least, radius)
        for part in texts:
            yield pa.array([index.find(t.as_py()) for t in part], HIT_ARROW)
        release()

    return find


def finders(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> list:
    """One column function for each block of the benchmark; it gives the hits of a text.

    Blocks are chosen by the item's hash, so that each has about ``BLOCK_CHARS`` characters; one
    block at a time is on the driver. Repeated items count once. Items without words match nothing.
    """
    items = pick(benchmark, item=item_col, text=text_col).select(F.col("item").cast("string"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    out = []
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted({(r["item"], r["text"]) for r in block.collect()})
        out.append(_finder(benchmark.sparkSession.sparkContext.broadcast(rows), least, radius))
    return out


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, item, similarity, start_word, end_word, distance): the best window of each text and item.

    Null and empty texts hold nothing; repeated rows give repeated results; ids may be null. A
    text shorter than an item is compared as one window. Other columns don't matter.
    """
    rows = pick(df, id=id_col, text=text_col)
    kind = dict(benchmark.dtypes)[item_col]
    parts = [rows.select("id", F.explode(find("text")).alias("hit")) for find in finders(benchmark, item_col, item_text, least)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("id", F.col("hit.item").cast(kind).alias("item"), *[f"hit.{c}" for c in ("similarity", "start_word", "end_word", "distance")])


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Rows of ``df`` whose text holds no benchmark passage, with their columns as they came."""
    for find in finders(benchmark, item_col, item_text, least):
        df = df.where(F.size(find(F.col(text_col))) == 0)
    return df
