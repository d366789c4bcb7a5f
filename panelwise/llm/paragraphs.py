"""Repeated paragraphs: MinHash banding, exact verification, components, removals.

Paragraphs. A line is cut where the hash of two neighbouring words is the smallest of the ``REACH``
positions to either side. A cut depends on the words around it only, so a passage that
is pasted into the middle of other text yields the same inner paragraphs as elsewhere. A paragraph takes
part if it has at least ``LEAST_WORDS`` words.

Banding. ``BANDS`` bands of ``ROWS`` MinHash values over five-word shingles. Two paragraphs of similarity s share a band with
probability 1 - (1 - s ** ROWS) ** BANDS: 0.983 at 0.8, 0.999 at 0.9; equal paragraphs always do. Equal
paragraphs are one content before banding, so copies cost one row a task.

Verification. In a bucket of up to ``PAIRWISE`` contents all pairs are verified by exact Jaccard
similarity. In a larger one every content meets the smallest one first. Where a bucket still holds several components,
its contents are filed under their rarest shingles, as every pair of that similarity shares one (prefix filtering), and
meet, under each, the one that has fewest rarer shingles. What is still apart after that is compared with the contents of other components
under the same shingle, if sizes and positions let the pair reach the similarity; the component that holds most of a shingle meets only the
rest, so that a group of copies costs its size. A pair inside a
component is never compared, as it could add nothing, and no linked pair of different components is left out.

Removals. A class of paragraphs that occurs in at least two documents is repeated. Its first occurrence (smallest
document, then position) stays, the others go, if the run of repeated
paragraphs that they belong to has at least ``LEAST_RUN`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import HASHES, pick, store
from panelwise.llm.components import components
from panelwise.llm.decontaminate import shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 4, 2
REACH = 7
LEAST_WORDS = 8
LEAST_RUN = 20
PAIRWISE = 8
#: Contents (8 bytes each) that are broadcast as a filter; beyond that an exchange does the same.
SENT = 1_000_000

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A[0]
    x = (x ^ (x >> np.uint64(29))) * _A[1]
    return x ^ (x >> np.uint64(32))


#: Multipliers and offsets of the MinHash functions, derived from a counter.
_HASHES = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _A[2]).reshape(2, -1) | np.uint64(1)


def _least_of(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` neighbours, from runs of doubled length."""
    run = 1
    while run * 2 <= size:
        x, run = np.minimum(x[:-run], x[run:]), run * 2
    return np.minimum(x[: len(x) - (size - run)], x[size - run :]) if size > run else x


class Cut:
    """The paragraphs of one text: ``starts`` and ``ends`` in words, content hash, shingles."""

    def __init__(self, text: str | None):
        lines = [line.split() for line in (text or "").lower().encode().split(b"\n")]
        sizes = np.array([len(line) for line in lines if line], np.int64)
        n = int(sizes.sum())
        self.h = h = np.fromiter((x for line in lines for x in map(HASHES.__getitem__, line)), np.uint64, n)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            return
        ends = np.cumsum(sizes)
        at = np.arange(n)
        pair = h * _A[0] + np.append(h[1:], h[:1]) * _A[3]
        pair ^= pair >> np.uint64(32)
        pair[ends - 1] = _MAX  # a pair doesn't cross lines
        # lines are set apart by REACH empty places, so that no line sees another
        place = at + REACH * (1 + np.repeat(np.arange(len(sizes)), sizes))
        wide = np.full(int(place[-1]) + REACH + 1, _MAX)
        wide[place] = pair
        least = _least_of(wide, REACH)
        cut = (pair < least[place - REACH]) & (pair <= least[place + 1])
        cut &= (at - np.repeat(ends - sizes, sizes) >= REACH) & (np.repeat(ends, sizes) - at > REACH)
        cut[ends - sizes] = True
        self.starts = np.flatnonzero(cut)
        self.ends = np.append(self.starts[1:], n)

    def contents(self) -> np.ndarray:
        """64-bit hash of each paragraph's words in order."""
        offset = np.arange(len(self.h)) - np.repeat(self.starts, self.ends - self.starts)
        return np.add.reduceat(_mixed(self.h + offset.astype(np.uint64) * _A[3]), self.starts)

    def shingles(self) -> np.ndarray:
        """Hash of the shingle that begins at each word; _MAX where it would leave its paragraph."""
        n = len(self.h)
        out = np.full(n, _MAX)
        whole = shingles(self.h, SHINGLE)
        out[: len(whole)] = whole
        out[np.arange(n) + SHINGLE > np.repeat(self.ends, self.ends - self.starts)] = _MAX
        return out

    def bands(self, s: np.ndarray) -> np.ndarray:
        """Paragraph x band keys from the shingles ``s``."""
        none = s == _MAX
        keys = []
        for b in range(BANDS):
            key = np.full(len(self.starts), b + 1, np.uint64)
            for r in range(b * ROWS, (b + 1) * ROWS):
                value = s * _HASHES[0, r] + _HASHES[1, r]
                value[none] = _MAX
                key = _mixed(key * _A[2] + np.minimum.reduceat(value, self.starts))
            keys.append(key)
        return np.stack(keys, 1)


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, content, start, end, keys, shingles) of every paragraph that takes part.

    ``keys`` and ``shingles`` (a set of 32-bit hashes) are given once for a content that comes again in the same task.
    """
    seen: set[int] = set()
    for batch in batches:
        rows, parts, keys, sets = [], [], [], []
        for row, text in enumerate(batch.column("text")):
            cut = Cut(text.as_py())
            own = np.flatnonzero(cut.ends - cut.starts >= LEAST_WORDS)
            if not len(own):
                continue
            content = cut.contents()[own].view(np.int64)
            rows.append(np.full(len(own), row))
            parts.append(np.stack([content, cut.starts[own], cut.ends[own]], 1))
            names = content.tolist()
            if seen.issuperset(names):
                keys.extend([None] * len(own))
                sets.extend([None] * len(own))
                continue
            s = cut.shingles()
            band = cut.bands(s)[own].view(np.int64)
            small = (s >> np.uint64(32)).astype("<u4")
            for k, name, a, b in zip(range(len(own)), names, cut.starts[own].tolist(), (cut.ends[own] - SHINGLE + 1).tolist()):
                fresh = name not in seen
                seen.add(name)
                keys.append(band[k] if fresh else None)
                sets.append(small[a:b].tobytes() if fresh else None)
        if len(seen) > 500_000:
            seen.clear()
        if rows:
            content, start, end = np.concatenate(parts).T
            ids = batch.column("id").take(pa.array(np.concatenate(rows)))
            arrays = [ids, pa.array(content), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "content", "start", "end", "keys", "shingles"])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _set(packed: pa.Array) -> pa.Array:
    """Different shingles of a paragraph."""
    return pa.array([np.unique(np.frombuffer(p.as_py(), "<i4")) for p in packed], pa.list_(pa.int32()))


def paragraphs(rows: DataFrame) -> DataFrame:
    """The paragraphs of (id, text), stored."""
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, content long, start int, end int, keys array<long>, shingles binary"
    return store(rows.select("id", "text").mapInArrow(_paragraphs, schema), "paragraphs")


def shingle_sets(parts: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, shingles), one row for each of ``contents``; a broadcast of bounded size filters the paragraphs first."""
    first = parts.where("shingles IS NOT NULL").select("content", "shingles")
    small = contents.count() <= SENT
    first = first.join(F.broadcast(contents) if small else contents, "content", "left_semi")
    return store(first.dropDuplicates(["content"]).select("content", _set("shingles").alias("shingles")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity reaches ``least``."""
    left = sets.select(F.col("content").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("content").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return met.where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b")


def linked(parts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, root) of all contents of ``paragraphs`` that are linked to another one."""
    return joined(parts.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "content"), parts, least)


def joined(keyed: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(node, root) of the contents that are linked to another one with which they share a key of (key, content)."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartition(n, "key").dropDuplicates(["key", "content"])
    ranked = keyed.withColumn("lead", F.expr("min(content) OVER (PARTITION BY key)")).withColumn("size", F.expr("count(1) OVER (PARTITION BY key)"))
    buckets = store(ranked.where("size > 1"), "buckets")
    sets = shingle_sets(parts, store(buckets.select("content").distinct(), "contents"))

    small = buckets.where(F.col("size") <= PAIRWISE).select("key", "content")
    other = small.select("key", F.col("content").alias("b"))
    pairs = small.withColumnRenamed("content", "a").join(other, "key").where("a < b").select("a", "b")
    large = buckets.where(F.col("size") > PAIRWISE).select("key", "content", "lead")
    star = large.where("content > lead").select(F.col("lead").alias("a"), F.col("content").alias("b"))
    edges = store(verified(pairs.union(star), sets, least), "links")

    root = components(edges)
    if not large.limit(1).count():
        return root
    prefix = store(_prefixes(sets.join(_mixed_members(large, root), "content"), least), "prefixes")
    # every shingle's plainest content first: what it links is one component after that
    lead = prefix.groupBy("shingle").agg(F.min(F.struct("k", "n", "content", "root")).alias("lead"))
    led = prefix.join(lead, "shingle").where((F.col("root") != F.col("lead.root")) & _may_reach(least, "k", "n", "lead.k", "lead.n"))
    edges = store(edges.union(verified(led.select(F.col("lead.content").alias("a"), F.col("content").alias("b")), sets, least)), "links")
    root = components(edges)
    now = prefix.drop("root").join(root, prefix["content"] == root["node"], "left").select("shingle", "content", "k", "n", F.coalesce("root", "content").alias("root"))
    now = store(now, "prefixes")
    # of two contents in different components, one at least is outside the component that holds most of a shingle
    each = now.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("held"))
    most = each.groupBy("shingle").agg(F.max(F.struct("held", "root")).alias("most"), F.count(F.lit(1)).alias("number")).where("number > 1")
    x = now.join(most, "shingle").where("root != most.root").select("shingle", F.col("content").alias("a"), F.col("k").alias("i"), F.col("n").alias("m"), F.col("root").alias("other"))
    met = now.join(x, "shingle").where((F.col("root") != F.col("other")) & _may_reach(least, "k", "n", "i", "m"))
    more = store(verified(met.select(F.least("a", "content").alias("a"), F.greatest("a", "content").alias("b")), sets, least), "links")
    return components(edges.union(more)) if more.limit(1).count() else root


def _mixed_members(large: DataFrame, root: DataFrame) -> DataFrame:
    """(content, root) of the buckets that hold more than one component."""
    own = large.join(root, large["content"] == root["node"], "left").select("key", "content", F.coalesce("root", "content").alias("root"))
    several = own.groupBy("key").agg((F.min("root") != F.max("root")).alias("several")).where("several")
    return own.join(several, "key", "left_semi").select("content", "root").distinct()


def _may_reach(least: float, k: str, n: str, i: str, m: str) -> Column:
    """Whether two sets of sizes ``n`` and ``m`` whose first common shingle is their ``k``-th and ``i``-th can be similar enough."""
    common = F.least(F.col(n) - F.col(k), F.col(m) - F.col(i)) + 1
    return common * (1 + least) >= least * (F.col(n) + F.col(m)) - 1e-9


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(content, root, n, k, shingle) of the rarest shingles of each set, the ``k``-th of its ``n``.

    Two sets of similarity ``least`` or more share one of the ``n - ceil(least * n) + 1`` first of their
    shingles under any one order of all shingles; from rare to frequent, few others share those.
    """
    each = sets.select("content", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "shingle").withColumn("k", F.expr("row_number() OVER (PARTITION BY content ORDER BY often, shingle)"))
    # a little below the product, so that rounding never shortens a prefix
    return ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("content", "root", "n", "k", "shingle")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, least_run: int = LEAST_RUN) -> DataFrame:
    """(id, n_repeated, n_removed, repeated, removed) of each document that holds a repeated passage.

    ``repeated`` and ``removed`` are arrays of (start, end, class_id) in words of the whole text, in
    order; class_id is the content hash of the class's representative. Null and empty texts hold
    nothing; rows with a null id take no part. Rows that repeat an id count as the same document. Columns
    other than the two named don't matter.
    """
    rows = pick(df, id=id_col, text=text_col).where("id IS NOT NULL")
    parts = paragraphs(rows)
    places = parts.select("id", "content", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    root = linked(parts, least)
    once = places.groupBy("content").agg(F.min(F.struct("id", "start")).alias("first"), F.max("id").alias("top"))
    once = once.join(root, once["content"] == root["node"], "left").select("content", "first", "top", F.coalesce("root", "content").alias("class_id"))
    group = once.groupBy("class_id").agg(F.min("first").alias("stays"), F.max("top").alias("top")).where(F.col("stays.id") < F.col("top")).select("class_id", "stays")
    copied = once.select("content", "class_id").join(group, "class_id")
    held = places.join(copied, "content").dropDuplicates(["id", "start", "end", "content"])
    # runs of adjoining repeated paragraphs, by one exchange on the document
    held = held.withColumn("fresh", F.expr("start != coalesce(lag(end) OVER (PARTITION BY id ORDER BY start), -1)").cast("int"))
    held = held.withColumn("run", F.expr("sum(fresh) OVER (PARTITION BY id ORDER BY start)"))
    held = held.withColumn("words", F.expr("sum(end - start) OVER (PARTITION BY id, run)")).where(F.col("words") >= least_run)
    span = F.struct("start", "end", "class_id")
    stays = (F.col("id") == F.col("stays.id")) & (F.col("start") == F.col("stays.start"))
    return held.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_repeated"),
        F.count_if(~stays).alias("n_removed"),
        F.array_sort(F.collect_list(span)).alias("repeated"),
        F.array_sort(F.collect_list(F.when(~stays, span))).alias("removed"),
    )
