"""Row-level cleaning of raw feeds: dates, names, identifiers, filters, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.columns import parse_day_first, strip, title_case
from panelwise.functions.fixed import ALIASES, MERGED, SENTINEL


def normalise_text(c: Column | str) -> Column:
    return title_case(strip(c))


def compose_aliases(*maps: Mapping[str, str]) -> dict[str, str]:
    """One map with the effect of applying the given maps one after another."""
    out: dict[str, str] = {}
    for m in maps:
        out = {k: m.get(v, v) for k, v in out.items()}
        for k, v in m.items():
            out.setdefault(k, v)
    return out


def canonical_name(c: Column | str, *maps: Mapping[str, str]) -> Column:
    """Exact-match renaming by literal maps, applied in sequence. For thousands of names ``rename_by_table`` plans faster."""
    c = F.col(c) if isinstance(c, str) else c
    table = compose_aliases(*(maps or (ALIASES, MERGED)))
    if not table:
        return c
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.element_at(lookup, c), c)


def rename_by_table(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Renaming by an alias table ``(alias, name)`` of any size."""
    named = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_name")).dropDuplicates(["_alias"])
    out = df.join(named, df[column] == named["_alias"], "left")
    return out.withColumn(column, F.coalesce("_name", column)).drop("_alias", "_name")


def non_negative(columns: Sequence[str]) -> Column:
    """True when every count is known and at least zero."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.col(c) >= 0)
    return cond


def drop_sentinel(df: DataFrame, column: str, sentinel: str = SENTINEL) -> DataFrame:
    return df.withColumn(column, F.nullif(F.col(column), F.lit(sentinel))).dropna(subset=[column])


def clean_rows(
    df: DataFrame,
    measures: Sequence[str],
    entity: str = "entity",
    names: Sequence[str] = ("entity", "area"),
    date: str = "date",
    identifiers: Sequence[str] = ("site",),
    maps: Sequence[Mapping[str, str]] = (ALIASES, MERGED),
) -> DataFrame:
    """All row-level rules in order; works on batch and streaming frames alike."""
    named = [n for n in names if n in df.columns]
    ids = [i for i in identifiers if i in df.columns]
    out = df.withColumns(
        {date: parse_day_first(date)}
        | {n: normalise_text(n) for n in named}
        | {i: F.col(i).cast("string") for i in ids}
    ).where(non_negative(measures))
    out = drop_sentinel(out, entity)
    return out.withColumn(entity, canonical_name(entity, *maps))


def dedupe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact-duplicate removal: partial and final aggregation, no windows."""
    return df.dropDuplicates(list(columns) if columns else None)


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of every key."""
    cols = list(columns or df.columns)
    per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return per_key.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates"),
    )


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns])


def keep_known(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def unknown_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Distinct keys of ``df`` that do not occur in ``keys``."""
    return df.select(on).distinct().join(keys.select(on).distinct(), on, "left_anti")
