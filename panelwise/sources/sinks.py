"""Results out: named outputs, CSV export, previews, versioned parameter tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONED = {"panel": "period"}
VIEWS = {
    "label_view": ("focus_summary", ["entity", "label", "maturity", "pressure", "volatility", "predictability"]),
    "action_view": ("focus_summary", ["entity", "status", "action"]),
    "priority_view": ("focus_summary", ["entity", "priority", "flag_count"]),
}


def write_outputs(outputs: Mapping[str, DataFrame], root: str, csv: bool = False, partition_by: Mapping[str, str] = PARTITIONED) -> dict[str, str]:
    """One table per output plus the projected views; returns name -> path."""
    every = dict(outputs)
    for name, (source, columns) in VIEWS.items():
        if source in outputs:
            every[name] = outputs[source].select(*[c for c in columns if c in outputs[source].columns])
    paths = {}
    for name, df in every.items():
        path = f"{root.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if csv:
            writer.option("header", True).csv(path)
        elif name in partition_by and partition_by[name] in df.columns:
            key = partition_by[name]
            df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)
        else:
            writer.parquet(path)
        paths[name] = path
    return paths


def preview(df: DataFrame, order: Sequence[Column], rows: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(rows)


# ---- versioned parameters -------------------------------------------------------------

ARTEFACT = "name string, version long, saved_at timestamp, params map<string,double>"


def save_artefact(spark: SparkSession, root: str, name: str, params: Mapping[str, float], version: int | None = None) -> int:
    """Append one version of named parameters; versions count up from 1."""
    if version is None:
        known = _artefacts(spark, root)
        last = known.where(F.col("name") == name).agg(F.max("version")).first()[0] if known is not None else None
        version = (last or 0) + 1
    row = spark.createDataFrame([(name, int(version), {k: float(v) for k, v in params.items()})], "name string, version long, params map<string,double>")
    row.withColumn("saved_at", F.current_timestamp()).select("name", "version", "saved_at", "params").coalesce(1).write.mode("append").parquet(root)
    return int(version)


def _artefacts(spark: SparkSession, root: str) -> DataFrame | None:
    from panelwise.sources.readers import _matches

    return spark.read.schema(ARTEFACT).parquet(root) if _matches(spark, root) else None


def latest_artefacts(table: DataFrame) -> DataFrame:
    """Newest version of every name."""
    return table.groupBy("name").agg(F.max("version").alias("version"), F.max_by("params", "version").alias("params"))


def load_artefact(spark: SparkSession, root: str, name: str) -> dict[str, float]:
    table = _artefacts(spark, root)
    row = latest_artefacts(table.where(F.col("name") == name)).first() if table is not None else None
    if row is None:
        raise FileNotFoundError(f"no saved parameters named {name!r}")
    return dict(row["params"])


def list_artefacts(spark: SparkSession, root: str) -> DataFrame:
    table = _artefacts(spark, root)
    if table is None:
        return spark.createDataFrame([], "name string")
    return table.select("name").distinct().orderBy("name")
