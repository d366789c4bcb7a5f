"""Near copies of whole documents: wide SimHash prints, chains on their ring, exact five-word Jaccard verification, components.

The print of a document is voted by its set of five-word shingles; chains of ``simhash`` find candidates of similarity
``SIMILARITY`` or more with probability 0.99 at least, and the exact verification of ``paragraphs`` keeps clean documents apart. Documents
of equal words are one content; those of fewer than ``SHINGLE`` words have no other near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import fresh_names, pick, release, store
from panelwise.llm.paragraphs import SHINGLE, SIMILARITY, Cut, joined
from panelwise.llm.simhash import wide_buckets, wide_print


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, print, content, size, wide, shingles) of every document; the last three once for a content in the same batch."""
    for batch in batches:
        contents, sizes, wide, sets = [], [], [], []
        seen: set[int] = set()  # repeats of other batches are dropped later
        for text in batch.column("text"):
            cut = Cut(text.as_py())
            n = len(cut.h)
            cut.starts, cut.ends = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n)
            content = int(cut.contents().view(np.int64)[0]) if n else 0
            contents.append(content)
            fresh = n >= SHINGLE and content not in seen
            own = np.unique((cut.shingles()[: n - SHINGLE + 1] >> np.uint64(32)).astype("<u4")) if fresh else None
            if fresh:
                seen.add(content)
            sizes.append(len(own) if fresh else None)
            wide.append(wide_print(own) if fresh else None)
            sets.append(own.tobytes() if fresh else None)
        kinds = {"content": pa.int64(), "size": pa.int32(), "wide": pa.binary(), "shingles": pa.binary()}
        arrays = [pa.array(a, t) for a, t in zip((contents, sizes, wide, sets), kinds.values())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), *arrays], ["id", "print", *kinds])
    release()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each class of near copies: the one with the smallest id, null ids last.

    Null and empty texts are one class. Columns are returned as they came.
    """
    rows = pick(df, id=id_col, text=text_col).withColumn("print", F.xxhash64("text"))
    schema = f"id {dict(rows.dtypes)['id']}, print long, content long, size int, wide binary, shingles binary"
    prints = store(rows.select("id", "print", "text").mapInArrow(_documents, schema), "documents")
    different = prints.where("wide IS NOT NULL").select(F.col("content").alias("node"), "size", F.col("wide").alias("print")).dropDuplicates(["node"])
    root = joined(wide_buckets(different, least), prints, least)
    first = prints.groupBy("content").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "print")).alias("least"))
    rooted = first.join(root, first["content"] == root["node"], "left").select("least", F.coalesce("root", "content").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("least").alias("least"))
    own, stay_id, stay_print = fresh_names(df, "print", "stay_id", "stay_print")
    stay = store(stay.select(F.col("least.id").alias(stay_id), F.col("least.print").alias(stay_print)), "stay")
    out = df.withColumn(own, F.xxhash64(F.col(text_col)))
    out = out.join(stay, F.col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_print)), "left_semi")
    return out.dropDuplicates([id_col, own]).drop(own)
