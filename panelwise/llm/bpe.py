"""Byte-level BPE with a hierarchical-bitmap rank queue.

All pre-tokens of a chunk of texts share one linked list of tokens (a separator between two
pre-tokens pairs with nothing). Buckets, one per merge rank, hold positions of the list. A
bitmap over the ranks in three levels (64 ranks a leaf, 64 leaves a node, one word of nodes on
top) gives the smallest occupied rank by find-first-set. A position whose pair has
changed since it was filed is stale and skipped. The valid positions of a bucket merge together, the leftmost
first where they overlap, so a pre-token of a million bytes costs no more per byte than a word.

Merging a whole bucket at once equals merging one position at a time if no merge of this
rank can make a pair of lower rank. Ranks for which the vocabulary doesn't rule that out merge only
the leftmost position of each pre-token and file the rest again.

Token ids travel as packed little-endian unsigned 32-bit integers: a third of the size of
an array column and ready to be digested or written. ``unpack`` gives the array.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import release

#: Pre-tokens of at most LONG characters are remembered, up to REMEMBERED of them for each worker.
LONG = 48
REMEMBERED = 1 << 16
#: Characters of text that are cut and merged at a time. Of a chunk, each different pre-token is held once; its places are numbers.
CHUNK = 1 << 22


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with one ``base64-token rank`` per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def distinct(a: np.ndarray) -> np.ndarray:
    """The different values of ``a``, ascending; sorts ``a`` in place (quicker on a few values than NumPy's own)."""
    a.sort()
    keep = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]


class RankQueue:
    """Buckets of positions by rank; the lowest occupied rank comes first."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaves: dict[int, int] = {}
        self.nodes: dict[int, int] = {}
        self.top = 0

    def file(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """File ``positions``, which ascend."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        bounds = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()]
        buckets = self.buckets
        for rank, lo, hi in zip(ranks[bounds].tolist(), bounds, [*bounds[1:], len(ranks)]):
            if rank in buckets:
                buckets[rank].append(positions[lo:hi])
            else:
                buckets[rank] = [positions[lo:hi]]
                leaf, node = rank >> 6, rank >> 12
                self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 63)
                self.nodes[node] = self.nodes.get(node, 0) | 1 << (leaf & 63)
                self.top |= 1 << node

    def take(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its whole bucket, each position once and from left to right."""
        node = (self.top & -self.top).bit_length() - 1
        word = self.nodes[node]
        leaf = node << 6 | (word & -word).bit_length() - 1
        word = self.leaves[leaf]
        rank = leaf << 6 | (word & -word).bit_length() - 1
        self.leaves[leaf] = word & word - 1
        if not self.leaves[leaf]:
            self.nodes[node] &= self.nodes[node] - 1
            if not self.nodes[node]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else distinct(np.concatenate(bucket))


class Merges:
    """Pair table of a vocabulary and the merging of many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.size = max(ranks.values()) + 1
        pairs: dict[int, int] = {}
        self.lowers = np.zeros(self.size, bool)  # a merge of this rank can make a pair of lower rank
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
                    for part in (a, b):
                        if part >= rank:
                            self.lowers[part] = True
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.results = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge; -1 as an id pairs with nothing."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.results[at], -1)

    def _leftmost(self, rank, at, keep, token, after, before, owner) -> tuple[np.ndarray, np.ndarray]:
        """Only the leftmost position of each pre-token in which a merge would make a pair of lower rank."""
        made = np.full(len(at), rank)
        sides = [self.rank_of(token[before[at]], made), self.rank_of(made, token[after[after[at]]]), self.rank_of(made, made)]
        low = np.any([(x >= 0) & (x < rank) for x in sides], axis=0)
        if not low.any():
            return keep, at[:0]
        piece = owner[at]
        careful = np.isin(piece, piece[low])
        first = np.concatenate([[True], piece[1:] != piece[:-1]])
        return np.where(careful, first, keep), at[careful & ~first]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``pieces`` in a row, and the bounds of each piece's ids."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"\0".join(pieces), np.uint8)
        n = len(raw) + 2  # a separator before, between and after
        place = np.int32 if n < 1 << 31 else np.int64
        first = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
        token = np.full(n, -1, place)
        token[1:-1] = self.of_byte[raw]
        token[first[1:] - 1] = -1
        spread = np.append(sizes + 1, n - 1 - (sizes + 1).sum())
        spread[0] += 1  # the separator before
        owner = np.repeat(np.arange(len(pieces) + 1, dtype=place), spread)
        after, before = np.arange(1, n + 1, dtype=place), np.arange(-1, n - 1, dtype=place)
        after[-1] = n - 1
        filed = np.full(n, -1, place)
        filed[:-1] = self.rank_of(token[:-1], token[1:])
        alive = token >= 0
        queue = RankQueue()
        start = np.flatnonzero(filed >= 0).astype(place)
        queue.file(filed[start], start)
        while queue.top:
            rank, at = queue.take()
            at = at[filed[at] == rank]  # the rest is stale
            if not len(at):
                continue
            if len(at) > 1:
                step = np.arange(len(at))
                fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
                keep = (step - np.maximum.accumulate(np.where(fresh, step, 0))) % 2 == 0
                if self.lowers[rank]:
                    keep, again = self._leftmost(rank, at, keep, token, after, before, owner)
                    queue.file(np.full(len(again), rank), again)
                at = at[keep]
            gone = after[at]
            beyond = after[gone]
            token[at] = rank
            after[at] = beyond
            before[beyond] = at
            filed[gone] = -1
            alive[gone] = False
            touched = distinct(np.concatenate([at, before[at]]))
            touched = touched[token[touched] >= 0]
            new = self.rank_of(token[touched], token[after[touched]])
            filed[touched] = new
            some = new >= 0
            queue.file(new[some], touched[some])
        counts = np.concatenate([[0], np.cumsum(alive)])
        return token[alive], counts[np.append(first[:-1], n - 1)]

    def lockstep(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``merge`` for many short pieces: each step merges the lowest pair of every piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece, none = np.arange(len(pieces)), np.iinfo(np.int64).max
        out_piece, out_size, out_token = [piece[sizes == 0]], [sizes[sizes == 0]], []
        piece, sizes = piece[sizes > 0], sizes[sizes > 0]
        pair = self.rank_of(token, np.append(token[1:], -1))
        pair[pair < 0] = none
        pair[np.cumsum(sizes) - 1] = none
        while len(piece):
            least = np.minimum.reduceat(pair, np.cumsum(sizes) - sizes)
            ended = least == none
            if ended.any():
                over = np.repeat(ended, sizes)
                out_piece.append(piece[ended])
                out_size.append(sizes[ended])
                out_token.append(token[over])
                piece, least, sizes, token, pair = piece[~ended], least[~ended], sizes[~ended], token[~over], pair[~over]
                continue
            owner = np.repeat(np.arange(len(piece)), sizes)
            at = np.flatnonzero(pair == least[owner])
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            token[at] = least
            left = np.ones(len(token), bool)
            left[at + 1] = False
            token, pair, owner = token[left], pair[left], owner[left]
            sizes = sizes - 1
            at -= np.arange(len(at))  # one place gone in each piece before
            for k in (at, at[at > 0] - 1):
                beyond = np.minimum(k + 1, len(token) - 1)
                new = self.rank_of(token[k], token[beyond])
                pair[k] = np.where((owner[k] == owner[beyond]) & (beyond > k) & (new >= 0), new, none)
        order = np.concatenate(out_piece)
        size = np.concatenate(out_size)
        flat = np.concatenate([*out_token, np.zeros(0, np.int64)])
        begin, back = np.cumsum(size) - size, np.argsort(order)
        counts = size[back]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        take = np.repeat(begin[back] - bounds[:-1], counts) + np.arange(bounds[-1])
        return flat[take], bounds


class Numbers(dict):
    """Numbers different pre-tokens in the order they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded memory of pre-tokens."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.merges = Merges(parse_ranks(raw))
        self.pieces: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.tokens: list[bytes] = [b""] * self.merges.size
        for token, rank in self.merges.ranks.items():
            self.tokens[rank] = token

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens; one that is a token as a whole isn't merged."""
        raw = [p.encode() for p in fresh]
        whole = list(map(self.merges.ranks.get, raw))
        out = {p: rank.to_bytes(4, "little") for p, rank in zip(fresh, whole) if rank is not None}
        rest = [k for k, rank in enumerate(whole) if rank is None]
        if rest:
            ids, bounds = self.merges.merge([raw[k] for k in rest])
            packed, ends = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            out.update((fresh[k], packed[a:b]) for k, a, b in zip(rest, ends[:-1], ends[1:]))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        number = Numbers()
        cut = [np.fromiter(map(number.__getitem__, self.pieces(t)), np.uint32) for t in texts]
        used = list(number)
        del number
        fresh = [p for p in used if p not in self.known]
        if fresh:
            self.known.update(self._learn(fresh))
        packed = list(map(self.known.__getitem__, used))
        if len(self.known) > REMEMBERED:  # go on with what this chunk has used, the first met first
            self.known = dict(islice(((p, self.known[p]) for p in used if len(p) <= LONG), REMEMBERED))
        else:
            for p in fresh:
                if len(p) > LONG:
                    del self.known[p]
        return [b"".join(map(packed.__getitem__, c.tolist())) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each worker and vocabulary."""
    return Codec(raw, pattern)


def _in_chunks(codec: Codec, texts: pa.Array) -> Iterator[list[bytes]]:
    """Packed ids of the texts, a list for each chunk: a worker holds the results of one chunk, not of a whole batch."""
    chunk: list[str] = []
    size = 0
    for t in texts:
        chunk.append(t.as_py() or "")
        size += len(chunk[-1])
        if size >= CHUNK:
            yield codec.encode_all(chunk)
            chunk, size = [], 0
    if chunk:
        yield codec.encode_all(chunk)


def _both(codec: Codec, texts: pa.Array) -> Iterator[pa.Array]:
    """Packed ids and what they decode to, an array for each chunk of the texts."""
    for ids in _in_chunks(codec, texts):
        decoded = pa.array(map(codec.decode, ids), pa.binary())
        yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), decoded], ["ids", "decoded"])


BOTH = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])


class Tokenizer:
    """Columns that encode and decode with the ranks in ``path`` (read by Spark on the driver).

    The vocabulary file (under a megabyte, of fixed size) goes to the executors as a broadcast.
    A null text counts as empty and has no ids. Text is encoded whole and without special tokens:
    their spelling in a text is ordinary text.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self._raw = spark.sparkContext.broadcast(f.read())
        raw, self.pattern = self._raw, pattern

        @F.arrow_udf(T.BinaryType())
        def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(raw.value, pattern)
            for part in texts:
                for ids in _in_chunks(codec, part):
                    yield pa.array(ids, pa.binary())
            release()

        @F.arrow_udf(T.BinaryType())
        def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(raw.value, pattern)
            for part in ids:
                yield pa.array((codec.decode(i.as_py() or b"") for i in part), pa.binary())
            release()

        @F.arrow_udf(BOTH)
        def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(raw.value, pattern)
            for part in texts:
                yield from _both(codec, part)
            release()

        self._encode, self._decode, self._both = encode, decode, both

    def round_trip(self, text: str | Column) -> Column:
        """Packed ids of a text column and the bytes that they decode to, in one pass over the rows."""
        return self._both(text)

    def encode(self, text: str | Column) -> Column:
        """Packed ids of a text column."""
        return self._encode(text)

    def decode(self, ids: str | Column) -> Column:
        """Bytes of a column of packed ids."""
        return self._decode(ids)


def n_tokens(ids: str | Column) -> Column:
    return (F.length(ids) / 4).cast("long")


@F.arrow_udf(T.ArrayType(T.LongType()))
def unpack(ids: pa.Array) -> pa.Array:
    """Packed ids as an array column."""
    return pa.array([np.frombuffer(i.as_py() or b"", "<u4").astype(np.int64) for i in ids], pa.list_(pa.int64()))
