"""Feeds in: CSV folders, zipped CSV archives, input audit, first existing candidate."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROWS_PER_BATCH = 100_000
BAD_RECORD = "_corrupt_record"


def feed_schema(measures: Sequence[str]) -> T.StructType:
    """Raw feed: everything descriptive is text, measures are integers."""
    text = [T.StructField(c, T.StringType()) for c in ("date", "entity", "area", "site")]
    return T.StructType(text + [T.StructField(m, T.LongType()) for m in measures])


def read_csv_feed(spark: SparkSession, root: str | Sequence[str], schema: T.StructType, pattern: str = "*.csv") -> DataFrame:
    """Every matching CSV below the folders, in parallel; broken lines are kept aside
    in ``_corrupt_record`` instead of failing the scan.
    """
    full = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    return (
        spark.read.schema(full)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .csv(root if isinstance(root, str) else list(root))
    )


def read_archives(spark: SparkSession, root: str, schema: T.StructType, pattern: str = "*.zip") -> DataFrame:
    """Rows of every CSV member of every archive; one archive is one unit of work."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")
    )
    return expand_archives(files, schema)


def expand_archives(files: DataFrame, schema: T.StructType) -> DataFrame:
    """``(path, content)`` -> CSV rows; members stream in bounded batches."""
    names = [f.name for f in schema.fields]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        if member.lower().endswith(".csv"):
                            with z.open(member) as f:
                                for chunk in pd.read_csv(f, dtype=str, chunksize=ROWS_PER_BATCH, keep_default_na=True):
                                    yield chunk.reindex(columns=names)

    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # one archive per task: content is large, so rows spread over all cores first
    loose = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInPandas(rows, text)
    return loose.selectExpr(*[f"try_cast(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields])


def _matches(spark: SparkSession, pattern: str) -> int:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return len(found) if found is not None else 0


def audit_inputs(spark: SparkSession, root: str, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Number of files per required feed; feeds with none are missing."""
    rows = [(feed, sum(_matches(spark, f"{root.rstrip('/')}/{p}") for p in patterns)) for feed, patterns in required.items()]
    return spark.createDataFrame(rows, "feed string, files long").selectExpr("feed", "files", "files = 0 AS missing")


def require_inputs(spark: SparkSession, root: str, required: Mapping[str, Sequence[str]]) -> None:
    missing = [r["feed"] for r in audit_inputs(spark, root, required).where("missing").orderBy("feed").collect()]
    if missing:
        raise FileNotFoundError("no input files for: " + ", ".join(missing))


def read_first(spark: SparkSession, candidates: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The first existing candidate; Parquet unless the name ends in .csv."""
    for path in candidates:
        if _matches(spark, path):
            if path.endswith(".csv"):
                reader = spark.read.option("header", True)
                return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
            return spark.read.parquet(path)
    raise FileNotFoundError("none of these exist: " + ", ".join(candidates))
