"""Jobs from the command line, for spark-submit or a local run.

    python -m panelwise.jobs clean    --in RAW --out CLEAN
    python -m panelwise.jobs core     --in CLEAN --out CORE
    python -m panelwise.jobs advanced --in CORE --out MORE
    python -m panelwise.jobs validate --in CLEAN --out REPORT --run-date 2024-01-31

RAW holds one folder of CSV files for each of the feeds a, b and c; the other folders hold Parquet tables
as written by the job before. On a cluster ship the package with ``--py-files`` and set
``spark.checkpoint.dir`` to a shared folder.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.rollup import BANDS_OF
from panelwise.plans import jobs
from panelwise.sources.readers import feed_schema, read_csv_feed, require_inputs
from panelwise.sources.sinks import write_outputs


def _cleaned(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {feed: spark.read.parquet(f"{root}/{feed}") for feed in BANDS_OF}


def run(spark: SparkSession, job: str, source: str, target: str, run_date: str | None = None) -> dict[str, str]:
    """Run one job; returns the paths written by name."""
    source, target = source.rstrip("/"), target.rstrip("/")
    if job == "clean":
        require_inputs(spark, source, {feed: [f"{feed}/*.csv"] for feed in BANDS_OF})
        raw = {feed: read_csv_feed(spark, f"{source}/{feed}", feed_schema(bands)) for feed, bands in BANDS_OF.items()}
        return write_outputs(jobs.clean_job(raw), target)
    if job == "core":
        return write_outputs(jobs.core_job(**_cleaned(spark, source)), target)
    if job == "advanced":
        core = {name: spark.read.parquet(f"{source}/{name}") for name in ("panel", "profile")}
        # a partition column comes back with the type that its folder names suggest
        core["panel"] = core["panel"].withColumn("period", F.col("period").cast("date"))
        done, failed = jobs.advanced_job(core)
        for name, why in failed.items():
            print(f"module {name} failed: {why}", file=sys.stderr)
        return write_outputs(done, target)
    return write_outputs({"validation": jobs.validate_job(_cleaned(spark, source), run_date=run_date)}, target)


def main(args: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelwise", description="Panel jobs on Spark")
    parser.add_argument("job", choices=["clean", "core", "advanced", "validate"])
    parser.add_argument("--in", dest="source", required=True)
    parser.add_argument("--out", dest="target", required=True)
    parser.add_argument("--run-date", help="latest date that validate allows (default: today)")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"panelwise-{asked.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, path in run(spark, asked.job, asked.source, asked.target, asked.run_date).items():
        print(name, path)
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
