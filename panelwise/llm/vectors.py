"""Approximate nearest neighbours on robust-pruned directed graphs.

Equal vectors are one node that keeps the smallest few of its ids, so a vector shared by a third of all rows costs one
node. Nodes are dealt by hash to shards of a bounded size. In each shard a directed graph is
built: greedy beam searches from the node nearest to the mean propose neighbours, relaxed distance pruning
keeps an edge only if no kept neighbour is ``ALPHA`` times nearer to its end, and reverse edges are pruned likewise.
Queries, in blocks of a bounded size, are broadcast to the stored shards; each shard is
beam-searched, its best nodes get the exact cosine in double precision, and the shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import pick, store

DEGREE = 24
BEAM = 48
SEARCH_BEAM = 64
ALPHA = 1.2
#: Nodes of a shard: a share of all, within these bounds.
SHARDS, SHARD_ROWS = 64, (1024, 65_536)
#: Numbers (queries times dimensions) in a block of queries.
BLOCK = 4_000_000
#: Nodes that are searched or pruned together, and beam nodes expanded in one step.
BATCH, STEP = 256, 4

INDEX = "shard long, dim int, ids array<array<long>>, vectors binary, edges binary, entry int"


def _distances(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine between rows ``a`` (batch x dim) and nodes ``b`` (batch x m); -1 nodes are infinitely far."""
    d = 1.0 - np.einsum("bd,bmd->bm", a, points[b])
    return np.where(b >= 0, d, np.inf)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances), nearest first, of the beam of each query; -1 pads."""
    b, n = len(queries), len(points)
    nodes = np.full((b, width), -1)
    nodes[:, 0] = entry
    far = np.full((b, width), np.inf, np.float32)
    far[:, 0] = _distances(points, queries, nodes[:, :1])[:, 0]
    done = np.ones((b, width), bool)
    done[:, 0] = False
    seen = np.zeros((b, n), bool)
    seen[:, entry] = True
    row = np.arange(b)[:, None]
    while not done.all():
        open_ = np.where(done, np.inf, far)
        pick_ = np.argpartition(open_, min(STEP, width - 1), axis=1)[:, :STEP]
        live = ~done[row, pick_]
        done[row, pick_] = True
        near = np.where(live[:, :, None], edges[np.where(live, nodes[row, pick_], 0)], -1).reshape(b, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[row, near] & (near >= 0)] = -1
        got = near >= 0
        seen[np.broadcast_to(row, near.shape)[got], near[got]] = True
        d = _distances(points, queries, near).astype(np.float32)
        nodes, far, done = np.concatenate([nodes, near], 1), np.concatenate([far, d], 1), np.concatenate([done, ~got], 1)
        best = np.argsort(far, axis=1, kind="stable")[:, :width]
        nodes, far, done = nodes[row, best], far[row, best], done[row, best]
    return nodes, far


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node ``of`` among its candidates (-1 pads)."""
    candidates = np.where(candidates == of[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    d = _distances(points, points[of], candidates)
    order = np.argsort(d, axis=1, kind="stable")
    row = np.arange(len(of))[:, None]
    candidates, d = candidates[row, order], d[row, order]
    used = max(1, int((candidates >= 0).sum(axis=1).max(initial=1)))
    candidates, d = candidates[:, :used], d[:, :used]
    own = points[candidates]
    between = 1.0 - np.einsum("bmd,bkd->bmk", own, own)
    # distances are squared lengths up to a factor, hence the squared relaxation
    gone = candidates < 0
    kept = np.zeros_like(gone)
    for c in range(used):
        take = ~gone[:, c] & (kept.sum(axis=1) < degree)
        kept[:, c] = take
        gone |= take[:, None] & (alpha * alpha * between[:, c, :] <= d)
    out = np.full((len(of), degree), -1)
    at = np.cumsum(kept, axis=1) - 1
    r, c = np.nonzero(kept)
    out[r, at[r, c]] = candidates[r, c]
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges: node x degree with -1 pads, entry node) over unit vectors."""
    n = len(points)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    rng = np.random.default_rng(7)
    if n <= degree + 1:
        every = np.tile(np.arange(n), (n, 1))
        edges = np.full((n, degree), -1)
        edges[:, : n - 1] = every[every != np.arange(n)[:, None]].reshape(n, n - 1)
        return edges, entry
    edges = rng.integers(0, n - 1, (n, degree))
    edges += edges >= np.arange(n)[:, None]
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            of = order[lo : lo + BATCH]
            found, _ = beam_search(points, edges, entry, points[of], beam)
            edges[of] = robust_prune(points, of, np.concatenate([found, edges[of]], 1), degree, relax)
            source = np.repeat(of, degree)
            target = edges[of].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            ends, first, count = np.unique(target, return_index=True, return_counts=True)
            rank = np.arange(len(target)) - np.repeat(first, count)
            for part in np.array_split(np.arange(len(ends)), max(1, len(ends) // BATCH)):
                wide = int(count[part].max(initial=0))
                back = np.full((len(ends), wide), -1) if wide else None
                if back is None:
                    continue
                mine = np.isin(target, ends[part])
                back[np.searchsorted(ends, target[mine]), rank[mine]] = source[mine]
                edges[ends[part]] = robust_prune(points, ends[part], np.concatenate([edges[ends[part]], back[part]], 1), degree, relax)
    return edges, entry


def _index_shard(key: tuple, rows: pa.Table) -> pa.Table:
    vectors = np.array(rows.column("vector").to_pylist(), np.float64)
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    edges, entry = build_graph(unit)
    return pa.Table.from_pydict(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "dim": pa.array([vectors.shape[1]], pa.int32()),
            "ids": pa.array([rows.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "edges": pa.array([edges.astype(np.int32).tobytes()], pa.binary()),
            "entry": pa.array([entry], pa.int32()),
        }
    )


def valid(vector: str) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nodes(df: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): the different valid vectors, each with its ``keep`` smallest ids in order.

    The limit is applied before the exchange too, so a frequent vector sends few rows a task.
    """
    rows = df.where(valid("vector")).where("id IS NOT NULL").select("id", F.transform("vector", lambda x: x.cast("double") + 0.0).alias("vector"))
    ranked = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY vector ORDER BY id)")).where(f"rank <= {keep}")
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = 6) -> DataFrame:
    """One row per shard of the different valid vectors: vectors, their smallest ids, graph and entry node."""
    points = store(nodes(pick(df, id=id_col, vector=vector_col), keep), "nodes")
    n = points.count()
    rows = min(max(n // SHARDS, SHARD_ROWS[0]), SHARD_ROWS[1])
    shard = F.pmod(F.xxhash64("vector"), F.lit(max(1, -(-n // rows)))) * 10_000 + F.size("vector")
    return store(points.withColumn("shard", shard).groupBy("shard").applyInArrow(_index_shard, INDEX), "index")


def _search(shared, best: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, keys, raw = shared.value
        asked = np.frombuffer(raw, np.float64).reshape(-1, dim)
        length = np.linalg.norm(asked, axis=1)
        unit = (asked / length[:, None]).astype(np.float32)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] != dim:
                    continue
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(vectors), -1).astype(np.int64)
                norm = np.linalg.norm(vectors, axis=1)
                points = (vectors / norm[:, None]).astype(np.float32)
                for lo in range(0, len(asked), BATCH):
                    found, _ = beam_search(points, edges, row["entry"], unit[lo : lo + BATCH], beam)
                    q, at = np.nonzero(found >= 0)
                    v = found[q, at]
                    score = np.einsum("ij,ij->i", asked[lo + q], vectors[v]) / (length[lo + q] * norm[v])
                    first = np.array([row["ids"][k][0] for k in v.tolist()])
                    order = np.lexsort((first, -score, q))
                    q, v, score = q[order], v[order], score[order]
                    start = np.searchsorted(q, q)
                    top = np.arange(len(q)) - start < best
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query": pa.array([keys[lo + k] for k in q[top].tolist()], pa.int64()),
                            "ids": pa.array([row["ids"][k] for k in v[top].tolist()], pa.list_(pa.int64())),
                            "score": pa.array(score[top], pa.float64()),
                        }
                    )

    return run


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``queries`` selects.

    Nearness is the cosine in double precision of the original vectors; equal scores go to the
    smaller id; a row never finds itself. Vectors that are null, zero, or hold a null or non-finite
    component take no part, nor do null ids; vectors of another length are never compared. A row that is
    repeated with its id counts once. Other columns don't matter.
    """
    spark = df.sparkSession
    rows = pick(df, id=id_col, vector=vector_col).distinct()
    index = build_index(rows, "id", "vector", k + 1)
    chosen = rows.where(queries).where(valid("vector")).where("id IS NOT NULL").select("id", F.transform("vector", lambda x: x.cast("double") + 0.0).alias("vector"))
    chosen = store(chosen, "queries")
    asked = store(chosen.groupBy("vector").agg(F.min("id").alias("query")).withColumn("dim", F.size("vector")), "asked")
    parts = []
    for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        blocks = max(1, -(-r["n"] * r["dim"] // BLOCK))
        for b in range(blocks):
            own = asked.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("vector"), F.lit(blocks)) == b)).orderBy("query").select("query", "vector").toArrow()
            raw = np.array(own.column("vector").combine_chunks().flatten(), np.float64).tobytes()
            shared = spark.sparkContext.broadcast((r["dim"], own.column("query").to_pylist(), raw))
            spread = index.repartition(max(1, index.count()), "shard")
            parts.append(store(spread.mapInArrow(_search(shared, k + 1, beam), "query long, ids array<long>, score double"), "found"))
    if not parts:
        schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    # the best k + 1 nodes of each asked vector hold the best k rows of every query with it
    found = found.withColumn("r", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, ids[0])")).where(F.col("r") <= k + 1)
    who = chosen.join(asked.select("vector", "query"), "vector").select(F.col("id").alias("query_id"), "query")
    flat = who.join(found, "query").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    ranked = flat.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)").cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
