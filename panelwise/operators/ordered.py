"""Ordered statistics over a whole table without a one-task window.

A plain ``Window.orderBy`` without a partition key sends every row to one task.
Above ``SMALL_ROWS`` rows the functions here deal the rows by ranges of the order into buckets, store
them with their bucket's number, work inside the buckets in parallel and add per-bucket
offsets. Two shapes are offered:

* ``ladder``: one row per distinct value with cumulative counts. Values are counted
  before they are shuffled, so a value held by a third of all rows is one rung.
  Ranks, quantiles, empirical CDFs and two-sample distances read off the ladder.
* ``running``: row positions and running sums under a composite order whose last
  key is unique, with ranges of the whole key, so that ties spread too.

Ranges only balance the work; results do not depend on them. A NaN takes no part, as a null. Both functions
look at their input more than once: give them a materialised table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.session import materialize

SMALL_ROWS = 100_000
ROWS_PER_BUCKET = 500_000
BROADCAST_ROWS = 100_000
_B = "_bucket"


def known_value(df: DataFrame, value: str) -> Column:
    """Neither null nor NaN: a NaN takes no part, as a null."""
    known = F.col(value).isNotNull()
    return known & ~F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else known


def _in_buckets(df: DataFrame, keys: list[Column], rows: int, buckets: int | None) -> DataFrame:
    """``df`` dealt by ranges of ``keys`` and stored with its range's number, so that later reads agree.

    The number of ranges follows the rows without an upper end.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or max(least, -(-rows // ROWS_PER_BUCKET))
    return materialize(df.repartitionByRange(n, *keys).withColumn(_B, F.spark_partition_id()))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a join side whose row count is known and below the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ladder(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column] | None = None,
    groups: Sequence[str] = (),
    small_rows: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Distinct values of ``value`` with ``cum_<k>`` and ``total_<k>`` for each sum.

    ``groups`` must be few (features, sides); each may be arbitrarily large.
    """
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    sums = dict(sums or {"cnt": F.count(F.lit(1))})
    groups = list(groups)
    known = df.where(known_value(df, value))
    rungs = known.groupBy(*groups, value).agg(*[e.alias(k) for k, e in sums.items()])
    rows = known.count()
    if rows <= small_rows:
        base = Window.partitionBy(*(groups or [F.lit(0)]))
        up = base.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return rungs.select(
            *groups, value, *sums,
            *[F.sum(k).over(up).alias(f"cum_{k}") for k in sums],
            *[F.sum(k).over(base).alias(f"total_{k}") for k in sums],
        )
    rungs = _in_buckets(rungs, [F.col(c) for c in [*groups, value]], rows, buckets)
    base = Window.partitionBy(*(groups or [F.lit(0)]))
    before = base.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = rungs.groupBy(*groups, _B).agg(*[F.sum(k).alias(f"_s_{k}") for k in sums]).select(
        *groups, _B,
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(base).alias(f"total_{k}") for k in sums],
    )
    up = Window.partitionBy(*groups, _B).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return rungs.join(per_bucket, groups + [_B]).select(
        *groups, value, *sums,
        *[(F.col(f"_off_{k}") + F.sum(k).over(up)).alias(f"cum_{k}") for k in sums],
        *[f"total_{k}" for k in sums],
    )


def running(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    sums: Mapping[str, Column] | None = None,
    position: str = "position",
    small_rows: int | None = None,
    buckets: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add a 1-based position and running sums under ``order``.

    ``order`` lists ``(column, descending)``; the last column must make it unique and
    only numeric columns may be descending.
    """
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    sums = dict(sums or {})
    keys = [(-F.col(c) if desc else F.col(c)).alias(f"_k{i}") for i, (c, desc) in enumerate(order)]
    rows = df.count() if rows is None else rows
    names = [f"_k{i}" for i in range(len(order))]
    if rows <= small_rows:
        up = Window.partitionBy(F.lit(0)).orderBy(*[k for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*", F.count(F.lit(1)).over(up).alias(position), *[F.sum(e).over(up).alias(k) for k, e in sums.items()]
        )
    keyed = _in_buckets(df.select("*", F.struct(*keys).alias("_key")), [F.col(f"_key.{n}") for n in names], rows, buckets)
    before = Window.partitionBy(F.lit(0)).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    agg = keyed.groupBy(_B).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(e).alias(f"_s_{k}") for k, e in sums.items()])
    offsets = agg.select(
        _B,
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
    )
    up = Window.partitionBy(_B).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(offsets, _B).select(
        *[F.col(c) for c in df.columns],
        (F.col("_c0") + F.count(F.lit(1)).over(up)).alias(position),
        *[(F.col(f"_o_{k}") + F.sum(e).over(up)).alias(k) for k, e in sums.items()],
    )
    return out


def _rank_expr(kind: str, descending: bool, cnt: Column, cum: Column, n: Column) -> Column:
    if kind == "average":
        up = cum - (cnt - 1) / F.lit(2.0)
        return (n + 1) - up if descending else up
    if kind == "min":
        return n - cum + 1 if descending else cum - cnt + 1
    if kind == "fraction":
        return (cum - (cnt - 1) / F.lit(2.0)) / n
    if kind == "cdf":
        return (n - cum + cnt) / n if descending else cum / n
    raise ValueError(kind)


def with_ranks(
    df: DataFrame,
    specs: Sequence[tuple[str, str, str, bool]],
    small_rows: int | None = None,
    buckets: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add rank columns; each spec is ``(value, output, kind, descending)``.

    Kinds: ``average`` and ``min`` ranks, ``fraction`` (average rank over n) and ``cdf``.
    """
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    values = list(dict.fromkeys(s[0] for s in specs))
    if (df.count() if rows is None else rows) <= small_rows:
        out = df.repartition(1)  # one small exchange serves every window below
        for v in values:
            there = known_value(df, v)
            known = Window.partitionBy(there)
            same = Window.partitionBy(v)
            cnt, n = F.count(F.lit(1)).over(same), F.count(F.lit(1)).over(known)
            cum = F.rank().over(known.orderBy(v)) + cnt - 1
            out = out.withColumns(
                {o: F.when(there, _rank_expr(k, d, cnt, cum, n)) for vv, o, k, d in specs if vv == v}
            )
        return out
    out = df
    for v in values:
        rungs = ladder(df, v, small_rows=0, buckets=buckets)
        wanted = rungs.select(
            F.col(v).alias("_v"),
            *[_rank_expr(k, d, F.col("cnt"), F.col("cum_cnt"), F.col("total_cnt")).alias(o) for vv, o, k, d in specs if vv == v],
        )
        out = out.join(wanted, out[v] == wanted["_v"], "left").drop("_v")
    return out


def quantile_row(
    df: DataFrame,
    wanted: Mapping[str, tuple[str, float]],
    small_rows: int | None = None,
    buckets: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """One row of exact quantiles with linear interpolation: ``{name: (column, p)}``.

    ``rows`` may pass a known (upper bound of the) row count to save the count.
    """
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    if (df.count() if rows is None else rows) <= small_rows:
        return df.agg(*[F.percentile(F.when(known_value(df, c), F.col(c)), F.lit(p)).alias(name) for name, (c, p) in wanted.items()])
    parts = []
    for c in dict.fromkeys(c for c, _ in wanted.values()):
        rungs = ladder(df, c, small_rows=0, buckets=buckets)
        aggs = []
        for name, (cc, p) in wanted.items():
            if cc == c:
                at = (F.col("total_cnt") - 1) * F.lit(float(p))
                low = F.min(F.when(F.col("cum_cnt") > F.floor(at), F.col(c)))
                high = F.min(F.when(F.col("cum_cnt") > F.ceil(at), F.col(c)))
                part = F.max(at - F.floor(at))
                aggs.append((low + (high - low) * part).alias(name))
        parts.append(rungs.agg(*aggs))
    out = parts[0]
    for p in parts[1:]:
        out = with_row(out, p)
    return out.select(*wanted)


def group_quantiles(df: DataFrame, value: str, group: str, probs: Sequence[float], small_rows: int | None = None) -> DataFrame:
    """Exact quantiles per group as an array; few groups, each of any size."""
    steps = ladder(df, value, None, [group], small_rows)
    cells = []
    for p in probs:
        at = (F.col("total_cnt") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("cum_cnt") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("cum_cnt") > F.ceil(at), F.col(value)))
        cells.append(low + (high - low) * F.max(at - F.floor(at)))
    return steps.groupBy(group).agg(F.array(*cells).alias("quantiles"))


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table to every row, as a scalar subquery."""
    names = one_row.columns
    one = one_row.select(F.struct(*names)).scalar()
    wide = df.withColumn("_row", one)
    return wide.select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in names])
