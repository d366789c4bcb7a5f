"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into a ring of ``segments``. If two fingerprints differ in at most
``radius`` bits, some start on the ring exists from which every run of consecutive
segments stays within its proportional budget: the first ``l`` segments differ in at
most ``l * radius / segments`` bits. The index therefore holds, for each start, the whole
chain of ``segments - 1`` consecutive segments, once for each placing of the segments
that the budgets allow to differ; two fingerprints within the radius share one of these keys.
Candidates of a key then pass the running budgets bit by bit before the full Hamming check.

A key leaves ``radius`` segments open, so its bucket holds at most ``2 ** open bits``
different fingerprints however many documents there are: copies are merged before. Each
bucket yields at most one link per fingerprint (to the smallest one connected to it inside
the bucket), never all its pairs.

Wide prints serve a similarity instead of a radius: 256 bits voted by a set of shingles. Sets of Jaccard
similarity 0.8 differ in 15 % of the bits, so budgets that hold every such pair would leave a tenth of all pairs in every index. Here the
ring has 42 segments of 6 bits, each start's chain begins with two segments that agree, and then stays within running budgets for the
next 64 and 128 bits. With so many starts a pair of similarity 0.8 has such a chain with probability 0.99, more similar ones
nearly always; of unrelated pairs one in a hundred shares a key and one in ten million passes. An exact comparison has to follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import fresh_names, pick, store
from panelwise.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENTS = 8
#: Buckets up to this size compare all pairs; larger ones look their neighbours up. Same links.
PAIRWISE = 48
#: Shingles of one text unpacked at a time.
CHUNK = 1 << 16
#: Wide prints: 64-bit words, bits of a segment, segments on the ring, and of a key.
WORDS, WIDE_SEGMENT, WIDE_SEGMENTS, KEY_SEGMENTS = 4, 6, 42, 2
#: Differing bits that a chain may have in the first 64 and in all 128 bits after its key; similarity 0.8 makes 10 and 19 on average.
NEAR, FAR = 20, 33
#: A bucket whose rows have more rows of possible size than this goes on whole.
CROWDED = 1 << 13
#: Links kept before they are contracted.
HELD = 1 << 20


def fingerprint_of(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of one text: A-Z lowered, words between ASCII white space, word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    flat, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s + len(w) for s, w in zip(starts, words)][min(width, len(words)) - 1 :]
    set_bits = np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        part = zip(starts[lo : min(n, lo + CHUNK)], ends[lo : lo + CHUNK])
        h = np.array([xxh64_intdigest(flat[s:e], seed) for s, e in part], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t.as_py()) for t in texts], pa.int64())


def fingerprint(text: str | Column) -> Column:
    """SimHash column; a null or blank text has fingerprint 0."""
    return _fingerprints(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def chain_masks(radius: int = RADIUS, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(start, mask of the segments that must agree) for every permitted placing of differences.

    Only placings whose running count of differing segments stays within the budget of
    each prefix are listed; equal masks of two starts are listed once.
    """
    if BITS % segments or not 0 < radius < segments:
        raise ValueError("segments must divide 64 and exceed the radius")
    width, seen, out = BITS // segments, set(), []
    budget = [(l * radius) // segments for l in range(segments)]
    for start in range(segments):
        for odd in combinations(range(1, segments), budget[segments - 1]):
            if any(sum(j < l for j in odd) > budget[l] for l in range(segments)):
                continue
            kept = {(start + j) % segments for j in range(segments - 1)} - {(start + j) % segments for j in odd}
            mask = sum(((1 << width) - 1) << (s * width) for s in kept)
            if mask not in seen:
                seen.add(mask)
                out.append((start, mask))
    return out


def _ring_ok(diff: np.ndarray, radius: int, segments: int) -> np.ndarray:
    """Does some start keep every run of segments of ``diff`` within its budget?"""
    width = BITS // segments
    part = np.stack([np.bitwise_count((diff >> np.uint64(s * width)) & np.uint64((1 << width) - 1)) for s in range(segments)], 1).astype(np.int16)
    budget = np.array([(l * radius) // segments for l in range(1, segments + 1)], np.int16)
    ok = np.zeros(len(diff), bool)
    for s in range(segments):
        ok |= (np.cumsum(np.roll(part, -s, axis=1), axis=1) <= budget).all(axis=1)
    return ok


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of ``n`` rows by the links a-b."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    return root


def _bucket_links(fp: np.ndarray, size: np.ndarray, radius: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by bucket; ``size`` is the bucket size of every row."""
    n = len(fp)
    first = np.concatenate([[True], np.zeros(n - 1, bool)])
    starts = [0]
    while starts[-1] < n:
        starts.append(starts[-1] + int(size[starts[-1]]))
    bounds = np.array(starts[:-1])
    owner = np.repeat(np.arange(len(bounds)), size[bounds])
    first[bounds] = True
    a_all, b_all = [], []
    small = size <= PAIRWISE
    for gap in range(1, int(size[small].max(initial=1))):
        i = np.flatnonzero(small[:-gap] & (owner[:-gap] == owner[gap:]))
        diff = fp[i] ^ fp[i + gap]
        hit = np.flatnonzero(_ring_ok(diff, radius, segments))
        hit = hit[np.bitwise_count(diff[hit]) <= radius]
        a_all.append(i[hit])
        b_all.append(i[hit] + gap)
    for lo in bounds[size[bounds] > PAIRWISE]:
        part = fp[lo : lo + size[lo]]
        order = np.argsort(part)
        part = part[order]
        free = int(np.bitwise_or.reduce(part ^ part[0]))
        bits = [np.uint64(1 << k) for k in range(BITS) if free >> k & 1]
        flips = [np.bitwise_or.reduce(np.array(c, np.uint64)) for r in range(1, radius + 1) for c in combinations(bits, r)]
        for flip in flips:
            at = np.minimum(np.searchsorted(part, part ^ flip), len(part) - 1)
            i = np.flatnonzero(part[at] == part ^ flip)
            i = i[_ring_ok(part[i] ^ part[at[i]], radius, segments)]
            a_all.append(lo + order[i])
            b_all.append(lo + order[at[i]])
    return np.concatenate(a_all or [np.zeros(0, int)]), np.concatenate(b_all or [np.zeros(0, int)])


def _link_partition(radius: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solve(rows: pa.Table) -> pa.RecordBatch:
            which, key, fp = (rows.column(c).to_numpy() for c in ("which", "key", "fp"))
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])])
            at = np.flatnonzero(new)
            size = np.repeat(np.diff(np.append(at, len(fp))), np.diff(np.append(at, len(fp))))
            many = size > 1
            fp, size = fp[many].view(np.uint64), size[many]
            if not len(fp):
                return pa.RecordBatch.from_pydict({"fp": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
            a, b = _bucket_links(fp, size, radius, segments)
            root = _roots(len(fp), a, b)
            moved = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_pydict({"fp": fp[moved].view(np.int64), "other": fp[root[moved]].view(np.int64)})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            which, key = rows.column("which").to_numpy(), rows.column("key").to_numpy()
            same = (which == which[-1]) & (key == key[-1])
            cut = int(np.argmax(same))  # the last bucket may go on in the next batch
            rest = rows.slice(cut)
            if cut:
                yield solve(rows.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(fp, other): enough links to connect all distinct fingerprints within the radius."""
    masks = chain_masks(radius, segments)
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, (_, m) in enumerate(masks)])).alias("k")
    ).select("k.which", "k.key", "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "which", "key").sortWithinPartitions("which", "key", "fp").mapInArrow(_link_partition(radius, segments), "fp long, other long")


def classes(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``prints`` (id, fp).

    ``component_id`` is the smallest id of all rows whose fingerprints are connected; null
    ids never win unless a class has no other.
    """
    distinct = store(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    linked = components(links(distinct.select("fp"), radius, segments)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """One row per input row: (id, fp, component_id).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows keep
    their number. Columns other than the two named are ignored, whatever their names.
    An empty table gives an empty result.
    """
    rows = pick(df, id=id_col, text=text_col).select("id", fingerprint("text").alias("fp"))
    prints = store(rows, "prints")
    return prints.join(classes(prints, radius, segments), "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """``df`` with one row of each class: the one with the smallest id.

    Of repeated rows with that id one stays, and of a class with null ids only, one row.
    Columns are returned as they came.
    """
    prints = store(pick(df, id=id_col, text=text_col).select("id", fingerprint("text").alias("fp")), "prints")
    stay = prints.join(classes(prints, radius, segments), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    stay = stay.groupBy("id", "component_id").agg(F.min("fp").alias("fp"))
    own, stay_id, stay_fp = fresh_names(df, "own_fp", "stay_id", "stay_fp")
    stay = store(stay.select(F.col("id").alias(stay_id), F.col("fp").alias(stay_fp)), "stay")
    out = df.withColumn(own, fingerprint(F.col(text_col)))
    out = out.join(stay, F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_fp)), "left_semi")
    return out.dropDuplicates([id_col, own]).drop(own)


# ---- wide prints -----------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEPS = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_print(shingles: np.ndarray) -> bytes:
    """SimHash of ``WORDS`` * 64 bits of a set of shingles, given by their hashes."""
    n, votes = len(shingles), np.zeros(BITS * WORDS, np.int64)
    for lo in range(0, n, 255):  # as many rows as a byte counts
        drawn = _mix(_mix(shingles[lo : lo + 255].astype(np.uint64))[:, None] + _STEPS)
        votes += np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > n, bitorder="little").tobytes()


def chains(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first 64 bits after it, next 64) of the chain from every start, start x print; ``prints`` has a print's bytes in each row."""
    size, wide = WIDE_SEGMENT * KEY_SEGMENTS, WIDE_SEGMENT * WIDE_SEGMENTS
    ring = np.unpackbits(prints, axis=1, bitorder="little")[:, :wide]
    ring = np.concatenate([ring, ring[:, : size + 2 * BITS]], 1)
    key = np.empty((WIDE_SEGMENTS, len(prints)), np.int32)
    after = np.empty((2, WIDE_SEGMENTS, len(prints)), np.uint64)
    for k in range(WIDE_SEGMENTS):
        at = k * WIDE_SEGMENT
        key[k] = (k << size) + ring[:, at : at + size] @ (1 << np.arange(size))
        packed = np.packbits(ring[:, at + size : at + size + 2 * BITS], axis=1, bitorder="little")
        after[:, k] = packed.view(np.uint64).T
    return key, after[0], after[1]


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, size, near, far, node) for every start of every print."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
            key, near, far = chains(prints)
            repeat = lambda c: np.tile(part.column(c).to_numpy(), WIDE_SEGMENTS)
            arrays = [key.ravel(), repeat("size"), near.ravel().view(np.int64), far.ravel().view(np.int64), repeat("node")]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "size", "near", "far", "node"])


def _chain_roots(key: np.ndarray, size: np.ndarray, near: np.ndarray, far: np.ndarray, least: float) -> np.ndarray:
    """First row that each row is connected to inside its bucket; rows are sorted by key and size.

    Sets of similarity ``least`` have sizes in that ratio at least. The rows of a crowded bucket count as connected.
    """
    n = len(key)
    root = np.arange(n)
    place = (key.astype(np.int64) << 32) + size
    end = np.searchsorted(place, (key.astype(np.int64) << 32) + np.minimum(size / least + 1e-6, (1 << 32) - 1).astype(np.int64), side="right")
    crowded = np.isin(key, np.unique(key[end - root > CROWDED]))
    root[crowded] = np.searchsorted(key, key[crowded])
    held: list[tuple[np.ndarray, np.ndarray]] = []
    number, gap, i = 0, 1, np.flatnonzero(~crowded)

    def contract() -> np.ndarray:
        return _roots(n, np.concatenate([np.arange(n), *[a for a, _ in held]]), np.concatenate([root, *[b for _, b in held]]))

    while len(i := i[i + gap < end[i]]):
        a = i[np.bitwise_count(near[i] ^ near[i + gap]) <= NEAR]
        b = a + gap
        near_bits, far_bits = np.bitwise_count(near[a] ^ near[b]).astype(np.int64), np.bitwise_count(far[a] ^ far[b])
        ok = (near_bits + far_bits <= FAR) & (root[a] != root[b])
        if ok.any():
            held.append((a[ok], b[ok]))
            number += int(ok.sum())
        if number > HELD:
            root, held, number = contract(), [], 0
        gap += 1
    return contract() if held else root


def _chain_buckets(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of one bucket, but for the last batch

        def solve(rows: pa.Table) -> pa.RecordBatch:
            key, size, near, far, node = (rows.column(c).to_numpy() for c in ("key", "size", "near", "far", "node"))
            root = _chain_roots(key, size, near.view(np.uint64), far.view(np.uint64), least)
            several = np.bincount(root, minlength=len(root))[root] > 1
            return pa.RecordBatch.from_pydict({"key": node[root[several]], "content": node[several]})

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut or (rest and rest[-1].column("key")[-1].as_py() != key[-1]):
                yield solve(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks())
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield solve(pa.Table.from_batches(rest).combine_chunks())

    return run


def wide_buckets(prints: DataFrame, least: float) -> DataFrame:
    """(key, content): nodes of ``prints`` (node long, size int, print binary) whose chains meet share a key.

    ``size`` is that of the shingle set, ``least`` the similarity asked for. A key is the smallest set of its bucket.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.mapInArrow(_chain_rows, "key int, size int, near long, far long, node long")
    return rows.repartition(n, "key").sortWithinPartitions("key", "size", "node").mapInArrow(_chain_buckets(least), "key long, content long").distinct()
