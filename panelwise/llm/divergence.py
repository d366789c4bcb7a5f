"""How far the sources of a language are from each other and from the language, in exact integers.

Terms are counted inside the tasks and meet once, dealt by (lang, term). Everything after that works on
*cells*: terms of a group that have the same counts have the same value, so the value is evaluated once
a cell and carries the cell's number of terms.

* Terms of a group against its language: cells of (group count, language count). Cells of equal value
  merge, the values are ranked by their cumulative number of terms, and only the cells
  that reach into the first ranks are expanded into terms, in UTF-8 order.
* Sources against each other: cells of (count here, count there). Only terms that both hold are paired, by a
  join on the term; those of one side or neither follow from each source's own cells, because
  the count of the other side is 0 there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import store

SCALE = 1_000_000_000
MIN_DOCS = 10
RANKS = 10
ENTRIES = 1 << 17
PIECE = 1 << 20

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
#: in UTF-8, runs of A-Z, a-z and all code points from 0x80 on
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_OTHER = re.compile(rb"[^A-Za-z\x80-\xff]")


def _terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased, in lists of bounded length (``bytes.lower`` changes A-Z only)."""
    raw, at = text.encode().lower(), 0
    while at < len(raw):
        cut = _OTHER.search(raw, at + PIECE)
        end = cut.end() if cut else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by (lang, source, term), summed as far as ``ENTRIES`` entries hold."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                 pa.array([t.decode() for t in n], pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            lang, source, text = (v.as_py() for v in row)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            own: set[bytes] = set()
            for terms in _terms(text):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n)
            if size > ENTRIES:
                yield from emptied()
                size = 0
    yield from emptied()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); the product needs more than 64 bits."""
    big = lambda c: c.cast("decimal(20,0)")
    top, low = big(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), big(total + 2 * terms)
    return F.call_function("div", top, F.nullif(low, F.lit(0))) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, lead): counts of the terms that ``min_docs`` documents of the language hold.

    One shuffle by (lang, term) serves the sums and both windows. ``lead`` is 1 on one row a (lang, term).
    """
    counts = rows.mapInArrow(_count, _COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    full = counts.select("*", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), F.min("source").over(term).alias("first"))
    return full.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("first")).cast("int").alias("lead"))


def _sizes(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms): one row for every occurring group, with or without terms."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("lead").alias("terms"))
    return rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)


def term_ranks(kept: DataFrame, sizes: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, source, item, value, rank): the terms of each group that stand out most against its language."""
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("size")).join(sizes, ["lang", "source"])
    cells = cells.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    cells = store(cells.where("p > q").select("lang", "source", "n", "lang_n", "size", gap(F.col("p"), F.col("q")).alias("value")), "cells")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("size").alias("size")).withColumn("at", F.row_number().over(down)).where(F.col("at") <= ranks)
    before = F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1))
    reached = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < ranks).select("lang", "source", "value")
    chosen = cells.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = kept.join(chosen, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.col("term").alias("item"), "value")
    return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


def source_ranks(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language by its summed distance.

    The result has a row for each ordered pair of sources of a language; that is what is asked for.
    With n1, n2 the counts of a term on both sides, the sum over all kept terms is
    sum over shared terms of f(n1,n2)-f(n1,0)-f(0,n2)+f(0,0), plus each side's own sum of f(n,0)-f(0,0), plus
    terms * f(0,0). Each line below is such a cell with its signed number of terms.
    """
    side = lambda k: sizes.select("lang", F.col("source").alias(f"s{k}"), F.col("total").alias(f"t{k}"), *(["terms"] if k == 1 else []))
    pairs = store(side(1).join(side(2), "lang").where("s1 < s2"), "pairs")
    own = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("size"))
    cell = lambda n1, n2, size: F.struct(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), size.cast("long").alias("size"))
    n1, n2, m, zero = F.col("n1"), F.col("n2"), F.col("size"), F.lit(0)
    key = ["lang", "s1", "s2"]

    a = kept.select("lang", "term", F.col("source").alias("s1"), F.col("n").alias("n1"))
    b = kept.select("lang", "term", F.col("source").alias("s2"), F.col("n").alias("n2"))
    shared = a.join(b, ["lang", "term"]).where("s1 < s2").groupBy(*key, "n1", "n2").agg(F.count(F.lit(1)).alias("size"))
    shared = shared.select(*key, F.inline(F.array(cell(n1, n2, m), cell(n1, zero, -m), cell(zero, n2, -m), cell(zero, zero, m))))
    left = pairs.join(own.withColumnsRenamed({"source": "s1", "n": "n1"}), ["lang", "s1"]).select(*key, F.inline(F.array(cell(n1, zero, m), cell(zero, zero, -m))))
    right = pairs.join(own.withColumnsRenamed({"source": "s2", "n": "n2"}), ["lang", "s2"]).select(*key, F.inline(F.array(cell(zero, n2, m), cell(zero, zero, -m))))
    none = pairs.select(*key, F.inline(F.array(cell(zero, zero, F.col("terms")))))

    cells = shared.union(left).union(right).union(none).groupBy(*key, "n1", "n2").agg(F.sum("size").alias("size")).where("size <> 0")
    p, q = share(n1, F.col("t1"), F.col("terms")), share(n2, F.col("t2"), F.col("terms"))
    valued = pairs.join(cells, key, "left").groupBy(*key).agg(F.sum(F.coalesce(m * gap(p, q), F.lit(0))).alias("value"))
    both = valued.select("lang", F.inline(F.array(
        F.struct(F.col("s1").alias("source"), F.col("s2").alias("item"), "value"), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item"), "value")
    )))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``df``, parts ``pair`` and ``term``.

    Null lang, source and text are empty strings, and the empty string is a group like any other. Every row is one document,
    repeated rows too. A group without kept terms still has its pairs, whose value is 0 if its language keeps no term;
    a language with one source has no pairs. Equal values rank by item in UTF-8 order. Other columns, whatever their
    names, don't matter; an empty table gives an empty result.
    """
    rows = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = store(kept_terms(rows, min_docs), "terms")
    sizes = store(_sizes(rows, kept), "sizes")
    part = lambda name, found: found.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return part("pair", source_ranks(kept, sizes)).union(part("term", term_ranks(kept, sizes, ranks)))
