"""Connected components of an undirected edge list, by alternating star contraction.

Each round hangs every node on the smallest node it touches (large stars) and then every
node's smaller neighbours on the smallest of them (small stars). Components contract
to stars in about log(size) rounds, so long chains need no long loops. Rounds exchange edges
only. A hub's edges meet one join key, which adaptive execution may split: the side with
the smallest neighbours has one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelwise.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of one orderable type).

    ``root`` is the smallest node of the component. Self loops and null ends are
    ignored; repeated edges and either direction count once. An empty edge list gives an
    empty result.
    """
    a, b = edges.columns[:2]
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("l"), F.col(b).isNotNull().alias("r"))
        .where(F.col("l") & F.col("r") & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct()
    )
    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges in files, with their number and the sum of their hashes."""
        watch = Observation()
        out = store(df, "edges", watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return out, (watch.get["n"], watch.get["h"])

    now, state = stored(now)
    while state[0]:
        before = state
        now, state = stored(_small_star(_large_star(now).distinct()).distinct())
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
