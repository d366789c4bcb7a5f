"""Lines that several documents share, dropped everywhere but in the smallest document.

Every text is split at line ends; the normalised lines (ends stripped of ASCII white space, A-Z
lower-cased) travel as 128-bit hashes with the place they come from, never as text. One aggregate
counts the different documents of each hash; what lies over the threshold goes back to the places,
and each text is put together again from the positions that stay.

A line that a large share of all documents holds is one row of the count, combined on the map side.
On the way back such lines meet a broadcast table instead of a shuffle: a line is *hot* if it has
``1 / HOT`` or more of all (repeated line, document) pairs, so there are at most ``HOT`` of them whatever
the corpus. The others go through a join on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelwise.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
HOT = 2000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _digest(value: Column, prefix: str) -> list[Column]:
    """128 bits: XXH64 under two seeds."""
    return [F.xxhash64(value).alias(f"{prefix}a"), F.xxhash64(F.lit("second"), value).alias(f"{prefix}b")]


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def repeated_lines(places: DataFrame, min_docs: int = 2) -> DataFrame:
    """(ka, kb, docs, keep) of the keys that at least ``min_docs`` documents hold.

    ``places`` has (id, ka, kb). ``keep`` is the smallest id; all rows with one id are one document, a null
    id is a document like any other and comes after the numbered ones.
    """
    docs = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
    return places.groupBy("ka", "kb").agg(docs.cast("long").alias("docs"), F.min("id").alias("keep")).where(F.col("docs") >= min_docs)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, min_docs: int = 2, hot: int = HOT) -> DataFrame:
    """(id, n_lines, n_dropped, kept) for every row of ``df``; ``kept`` is the text that is left.

    A null text counts as empty, and an empty text is one empty line. Keys below ``least`` code points are
    never dropped. A document whose lines all go keeps the empty text. Rows with the same id and text get the
    same result; rows with one id and other texts are one document, of which either all or no
    lines of a key stay. Other columns of ``df``, whatever their names, don't matter; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", *_digest(F.col("text"), "p"))

    keys = F.transform(F.split("text", "\n", -1), line_key)
    keys = F.transform(keys, lambda k: F.when(F.length(k) >= least, F.struct(*_digest(k, "k"))))
    places = store(rows.select("id", "pa", "pb", F.posexplode(keys).alias("pos", "k")).where("k IS NOT NULL").select("id", "pa", "pb", "pos", "k.ka", "k.kb"), "lines")

    seen = Observation()
    found = store(repeated_lines(places, min_docs), "repeated", seen, F.coalesce(F.sum("docs"), F.lit(0)).alias("pairs"))
    is_hot = F.col("docs") * hot >= F.lit(seen.get["pairs"])
    few = F.broadcast(found.where(is_hot).select("ka", "kb", F.col("keep").alias("hot_keep"), F.lit(True).alias("hot")))
    marked = places.join(few, ["ka", "kb"], "left")
    cold = marked.where("hot IS NULL").join(found.where(~is_hot).select("ka", "kb", "keep"), ["ka", "kb"]).where(~_same("id", "keep"))
    drops = marked.where("hot").where(~_same("id", "hot_keep")).select("id", "pa", "pb", "pos").union(cold.select("id", "pa", "pb", "pos"))
    drops = drops.groupBy(F.col("id").alias("i"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.collect_set("pos").alias("drops"))

    joined = rows.join(drops, _same("id", "i") & (F.col("pa") == F.col("a")) & (F.col("pb") == F.col("b")), "left")
    cut = joined.select("id", "text", "drops", F.split("text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return cut.select(
        "id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )
