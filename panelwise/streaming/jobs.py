"""Cleaning, de-duplication, rollup and drift on file streams.

The row rules and the rollup are the batch functions; only the state handling is
added: watermarks bound the state of duplicates and open windows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.operators import drift
from panelwise.operators.clean import clean_rows


def csv_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def clean_stream(raw: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Stateless: the batch rules applied to every micro-batch."""
    return clean_rows(raw, measures)


def dedupe_stream(events: DataFrame, key: Sequence[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First row per key; keys are forgotten once the watermark has passed them."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def rollup_stream(facts: DataFrame, keys: Sequence[str], sums: Sequence[str], time: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling sums per key; rows later than the watermark are dropped."""
    out = facts.withWatermark(time, delay).groupBy(F.window(time, window).alias("_w"), *keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("rows")
    )
    return out.select(F.col("_w.start").alias("window_start"), *keys, *sums, "rows")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available, append to a table and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def closing_row(spark: SparkSession, schema: T.StructType, time: str = "ts", at: str = "9999-12-31 00:00:00") -> DataFrame:
    """One row without values far after all others: fed last, it moves the watermark past every open window."""
    return spark.range(1).select(*[(F.lit(at) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


# ---- windows that keep late rows -------------------------------------------------------------


def _window_of(time: str, seconds: int) -> Column:
    """Start of the tumbling window, from the epoch on; null for a null time."""
    at = F.unix_micros(time)
    return F.timestamp_micros(at - F.pmod(at, F.lit(seconds * 1_000_000)))


def window_sink(folder: str, keys: Sequence[str], sums: Sequence[str], time: str = "ts", seconds: int = 86_400, delay: int = 3_600) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: partial sums of tumbling windows, and the rows that came too late for theirs.

    A row is late if its window ended by the mark: the greatest time of all earlier batches
    less ``delay`` seconds. Rows without a time go with the late ones. Each batch writes ``partials``, ``late`` and
    its ``marks`` under its own number; a repeated batch replaces them, and sees the mark of its
    predecessor again. Partials hold one row a window and key, however many rows a batch has.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("mark timestamp").parquet(f"{folder}/marks/batch={batch_id - 1}").first()["mark"] if batch_id else None
        start = _window_of(time, seconds)
        ends = F.timestamp_micros(F.unix_micros(start) + seconds * 1_000_000)
        kept = F.col(time).isNotNull() if before is None else F.coalesce(ends > F.lit(before), F.lit(False))
        batch.where(~kept).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        partial = batch.where(kept).groupBy(start.alias("window_start"), *keys).agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("rows"))
        partial.write.mode("overwrite").parquet(f"{folder}/partials/batch={batch_id}")
        mark = F.timestamp_micros(F.unix_micros(F.max(time)) - delay * 1_000_000)
        batch.agg(F.greatest(mark, F.lit(before).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")

    return write


def run_windows(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], sums: Sequence[str], **options) -> None:
    """Process everything available with ``window_sink`` and stop."""
    stream.writeStream.foreachBatch(window_sink(folder, keys, sums, **options)).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def window_sums(spark: SparkSession, folder: str, keys: Sequence[str], sums: Sequence[str], seconds: int = 86_400) -> DataFrame:
    """(window_start, keys, sums, rows, closed) from all batches; a closed window can't change any more."""
    parts = spark.read.parquet(f"{folder}/partials")
    mark = spark.read.parquet(f"{folder}/marks").agg(F.max("mark")).scalar()
    whole = parts.groupBy("window_start", *keys).agg(*[F.sum(c).alias(c) for c in sums], F.sum("rows").alias("rows"))
    ends = F.timestamp_micros(F.unix_micros("window_start") + seconds * 1_000_000)
    return whole.withColumn("closed", F.coalesce(ends <= mark, F.lit(False)))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that came after their window was closed, as they were fed."""
    return spark.read.parquet(f"{folder}/late").drop("batch")


# ---- drift -----------------------------------------------------------------------------------


def drift_sink(baseline: DataFrame, features: Sequence[str], history: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: stability index of each batch against a baseline.

    A repeated batch replaces its own earlier result, so retries leave one row each.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        psi = drift.psi_equal_width(drift.pooled(baseline, batch, features))
        psi.withColumn("severity", drift.severity_psi_score(F.col("psi"))).write.mode("overwrite").parquet(f"{history}/batch={batch_id}")

    return write


def run_drift(stream: DataFrame, baseline: DataFrame, features: Sequence[str], history: str, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(drift_sink(baseline, features, history)).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def total_drift_sink(bins: DataFrame, features: Sequence[str], folder: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: stability index of all rows so far against ``drift.baseline_bins``.

    The state after a batch is the counts of its predecessor plus its own, a row a feature and bin. It is stored under
    the batch's number, so that a repeated batch starts from the same state and replaces its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = drift.bin_counts(drift.tall(batch, features), bins)
        if batch_id:
            own = own.unionByName(spark.read.schema(own.schema).parquet(f"{folder}/state/batch={batch_id - 1}"))
        own.groupBy("feature", "bin").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        state = spark.read.schema(own.schema).parquet(f"{folder}/state/batch={batch_id}")
        psi = drift.psi_of_counts(bins, state)
        psi.withColumn("severity", drift.severity_psi_score(F.col("psi"))).write.mode("overwrite").parquet(f"{folder}/history/batch={batch_id}")

    return write


def run_total_drift(stream: DataFrame, bins: DataFrame, features: Sequence[str], folder: str, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(total_drift_sink(bins, features, folder)).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
