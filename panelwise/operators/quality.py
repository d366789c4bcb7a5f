"""Data-quality checks: one pass per table, one report row per check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = "dataset string, check_name string, success boolean, details string"


@dataclass(frozen=True)
class Check:
    """``violations`` is an aggregate that counts offending rows; a uniqueness check names its ``key`` instead."""

    name: str
    violations: Column | None = None
    key: tuple[str, ...] = ()


def in_range(column: str, low=None, high=None, name: str | None = None) -> Check:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < F.lit(low))
    if high is not None:
        bad = bad | (F.col(column) > F.lit(high))
    return Check(name or f"{column}_in_range", F.count_if(F.coalesce(bad, F.lit(False))))


def not_null(column: str) -> Check:
    return Check(f"{column}_not_null", F.count_if(F.col(column).isNull()))


def unique(columns: Sequence[str], name: str | None = None) -> Check:
    """Rows beyond the first per key; rows with a NULL key part are not counted."""
    return Check(name or "_".join(columns) + "_unique", key=tuple(columns))


def _beyond_first(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat a key. Counts combine before the exchange; no row is multiplied."""
    return df.select(*key).dropna().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("repeated"))


def date_range(column: str, low: str = "2010-01-01", high: str | None = None) -> Check:
    """Dates outside ``low`` .. ``high``; give the run's date as ``high`` to make a run repeatable (default: today)."""
    top = F.to_date(F.lit(high)) if high else F.current_date()
    bad = (F.col(column) < F.to_date(F.lit(low))) | (F.col(column) > top)
    return Check(f"{column}_in_range", F.count_if(F.coalesce(bad, F.lit(False))))


def all_non_negative(df: DataFrame, skip: Sequence[str] = ()) -> list[Check]:
    return [
        in_range(f.name, 0, None, f"{f.name}_non_negative")
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def index_bounds(columns: Sequence[str]) -> list[Check]:
    return [in_range(c, 0.0, 1.0) for c in columns]


def schema_report(df: DataFrame, dataset: str, expected: dict[str, str]) -> DataFrame:
    """Existence and type of the expected columns."""
    have = dict(df.dtypes)
    rows = []
    for c, kind in expected.items():
        rows.append((dataset, f"has_{c}", c in have, have.get(c, "missing")))
        if c in have:
            rows.append((dataset, f"{c}_is_{kind}", have[c] == kind, have[c]))
    return df.sparkSession.createDataFrame(rows, REPORT)


def run_checks(df: DataFrame, dataset: str, checks: Sequence[Check]) -> DataFrame:
    """All checks of a table in one aggregate, and one count by key for each uniqueness check."""
    plain = [c.violations.alias(f"_{i}") for i, c in enumerate(checks) if not c.key]
    one = df.agg(*plain, F.lit(0).alias("_none"))
    for i, c in enumerate(checks):
        if c.key:
            one = one.withColumn(f"_{i}", _beyond_first(df, c.key).scalar())
    rows = [
        F.struct(F.lit(dataset).alias("dataset"), F.lit(c.name).alias("check_name"), F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("long").alias("violations"))
        for i, c in enumerate(checks)
    ]
    out = one.select(F.inline(F.array(*rows)))
    return out.select("dataset", "check_name", (F.col("violations") == 0).alias("success"), "violations")


def as_report(checked: DataFrame) -> DataFrame:
    return checked.select("dataset", "check_name", "success", F.concat(F.lit("violations="), F.col("violations").cast("string")).alias("details"))


def success_rate(report: DataFrame) -> DataFrame:
    return report.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("success").alias("passed"),
        (F.count_if("success") / F.count(F.lit(1)).cast("double")).alias("rate"),
    )


@dataclass(frozen=True)
class Rule:
    """Column contract: target type, whether NULL is allowed, lower bound."""

    column: str
    kind: str
    nullable: bool = True
    at_least: float | None = None


def apply_contract(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Coerce types and split rows into valid ones and a quarantine with reasons.

    Columns without a rule are kept as they are.
    """
    checks = []
    for r in rules:
        raw, cast = F.col(r.column), F.expr(f"try_cast(`{r.column}` AS {r.kind})")
        checks.append(F.when(raw.isNotNull() & cast.isNull(), F.lit(f"{r.column}: not {r.kind}")))
        if not r.nullable:
            checks.append(F.when(raw.isNull(), F.lit(f"{r.column}: null")))
        if r.at_least is not None:
            checks.append(F.when(cast < F.lit(r.at_least), F.lit(f"{r.column}: below {r.at_least:g}")))
    marked = df.withColumn("violations", F.array_compact(F.array(*checks)))
    good = marked.where(F.size("violations") == 0).drop("violations")
    good = good.withColumns({r.column: F.expr(f"try_cast(`{r.column}` AS {r.kind})") for r in rules})
    return good, marked.where(F.size("violations") > 0)
