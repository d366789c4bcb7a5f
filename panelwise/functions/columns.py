"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
TINY = 1e-10
BLANKS = " \t\n\r\x0b\x0c"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / (den + EPS)``: never divides by zero."""
    return as_col(num) / (as_col(den) + F.lit(EPS))


def open_ratio(num: Column | str, den: Column | str) -> Column:
    """Plain ratio, NULL where the denominator is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs; NULL when a side is constant.

    The built-in ``corr`` raises a division error on constant input in ANSI mode.
    """
    x, y = as_col(x).cast("double"), as_col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(px) * F.stddev_pop(py))


def variation(x: Column | str) -> Column:
    """Sample standard deviation over mean + EPS."""
    x = as_col(x)
    return F.stddev_samp(x) / (F.avg(x) + F.lit(EPS))


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(BLANKS))


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    capital = F.transform(runs, lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, 1 << 30)))
    return F.array_join(capital, "")


def parse_day_first(c: Column | str) -> Column:
    """Day-first text date; ISO text is accepted too; anything else is NULL."""
    c = as_col(c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(fmt))) for fmt in ("dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd")])


def month_start(c: Column | str) -> Column:
    return F.trunc(as_col(c), "month")


def month_label(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM")


def first_match(rules: list[tuple[Column, Column]], otherwise: Column | None) -> Column:
    """Ordered rules: the first true condition decides."""
    out = F.when(rules[0][0], rules[0][1])
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def add_all(cols: list[Column | str]) -> Column:
    return reduce(lambda a, b: a + b, [as_col(c) for c in cols])


def rounded(df, digits: int = 6, skip: tuple[str, ...] = ()):
    """Round every double column, for display and comparison."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns]
    )
