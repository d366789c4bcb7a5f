"""Small shared pieces: stored intermediate tables and normalised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelwise.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str, watch: Observation | None = None, *metrics: Column) -> DataFrame:
    """Write ``df`` as Parquet to the folder all executors share and go on from the files.

    Cuts the lineage: a lost executor costs nothing that lies before this point. The
    files are deleted when the driver's file system closes. ``watch`` collects ``metrics`` of the rows on the way.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.observe(watch, *metrics) if watch else df).write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names."""
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class WordHashes(dict):
    """64-bit hashes of words (UTF-8), remembered up to a bound."""

    def __init__(self, bound: int = 1 << 17):
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


HASHES = WordHashes()


def release() -> None:
    """Give back what a task held in a Python worker, which goes on to tasks of other stages."""
    import ctypes

    import pyarrow as pa

    HASHES.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
