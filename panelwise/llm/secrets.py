"""Secret scan with linking of multipart credentials, in DataFrame expressions only.

Base spans are strong by themselves: assignments, access identifiers, long hex runs. Weak
parts say little alone: user names (mail addresses), bare key-like tokens, endpoints. They are
reported only if their complement lies in the same scope, ``SCOPE`` code points around them:

* a key-like token beside an access identifier or a user name,
* a user name beside a secret (assignment, hex run or key-like token),
* an endpoint beside both an identifier and a secret.

Parts meet by an interval join: each weak part is filed under every bucket of the text from ``SCOPE``
before its start to ``SCOPE`` after its end, its complements under all that they touch, and a semi-join on
(text, bucket) keeps it if one is near enough. A bucket holds at most ``SCOPE`` code points, hence few parts, and no pair leaves the
join. Only texts that hold a weak part take part.

Positions are counted in code points. Matches are cut out of the text by the pattern itself
(what lies between is ``split``), so the start of a match is the length of all before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import fresh_names, store

SCOPE = 120
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, least code points of the match, least of its second group)
BASE = {"assign": (ASSIGN, 0, 6), "access": (r"AKIA[A-Z0-9]+", 20, 0), "hex": (r"[0-9a-f]{24,}", 24, 0)}
#: a mail address's own part may follow punctuation, which the match takes along and the span leaves out; every quantifier over a
#: run of unknown length is possessive, and a match starts only where its run starts, so a long text costs one pass and no recursion
LEAD = "._%+-"
WEAK = {
    "user": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0, 0),
    "key": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])(?=[0-9+/=_-]*+[A-Za-z])[A-Za-z0-9+/=_-]{32,}+", 0, 0),
    "endpoint": (r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\s\"'<>]++|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])", 0, 0),
}
KINDS = [*BASE, *WEAK]
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


#: matches of a text are walked in groups, so that long lists are not copied for each match
GROUP = 256


def _matches(text: Column, pattern: str) -> Column:
    """Array of (gap before, match) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    none = F.array().cast("array<struct<gap:string,hit:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.arrays_zip(gaps.alias("gap"), found.alias("hit"))).otherwise(none)


def _spans(matches: str, kind: str, pattern: str, least: int, least_group: int) -> Column:
    """Array of (start, kind, end) of the column ``matches``, only of those that are long enough."""
    span = lambda start, end: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.length(x["hit"])
        size = F.length(F.ltrim(x["hit"], F.lit(LEAD))) if kind == "user" else F.length(x["hit"])
        keep = F.lit(True)
        if least:
            keep = keep & (F.length(x["hit"]) >= least)
        if least_group:
            keep = keep & (F.length(F.regexp_extract(x["hit"], pattern, 2)) >= least_group)
        own = F.array(span(end - size, end))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["spans"], lambda s: span(s["start"] + acc["at"], s["end"] + acc["at"]))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    zero = F.lit(0).cast("bigint")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / GROUP).cast("int")), lambda g: F.slice(F.col(matches), g * GROUP + 1, F.lit(GROUP)))
    walked = F.transform(groups, lambda g: F.aggregate(g, F.struct(zero.alias("at"), empty.alias("spans")), step))
    start = F.struct(zero.alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))
    return F.when(F.size(matches) > 0, F.flatten(F.aggregate(walked, start, join, lambda acc: acc["parts"]))).otherwise(empty)


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    return F.array_sort(spans)


def joined(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, by start and kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(_in_order(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _near(weak: DataFrame, other: DataFrame, scope: int) -> DataFrame:
    """Rows of ``weak`` that have a row of ``other`` in scope; both hold (id, print, start, kind, end)."""
    bucket = lambda at: F.floor(at / scope).cast("bigint")
    # both sides are filed under every bucket that they touch, the weak part with its scope
    tried = weak.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start") - scope), bucket(F.col("end") + scope))))
    filed = other.select(
        F.col("id").alias("i"), F.col("print").alias("p"), F.col("start").alias("s"), F.col("end").alias("e"),
        F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("b"),
    )
    gap = F.greatest(F.col("s") - F.col("end"), F.col("start") - F.col("e"))
    apart = ~((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    on = F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p")) & (F.col("bucket") == F.col("b")) & (gap <= scope) & apart
    return tried.join(filed, on, "left_semi").drop("bucket").distinct()


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak rows of ``parts`` (id, print, start, kind, end) whose complement is in scope."""
    kind = lambda *names: parts.where(F.col("kind").isin([KINDS.index(n) for n in names]))
    identifiers, secrets = kind("access", "user"), kind("assign", "hex", "key")
    keys = _near(kind("key"), identifiers, scope)
    users = _near(kind("user"), secrets, scope)
    ends = _near(_near(kind("endpoint"), identifiers, scope), secrets, scope)
    return keys.union(users).union(ends)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, print, base, spans) for every row: base spans, and all spans with the linked weak parts.

    ``print`` is the text's 64-bit hash; with the id it names a row, so repeated rows share their
    spans and a null id is an id like any other. A null text counts as empty. Columns other
    than the two named don't matter.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("print"), *[_matches(F.col("text"), p).alias(f"m_{k}") for k, (p, *_) in {**BASE, **WEAK}.items()])
    spans = lambda kinds: F.concat(*[_spans(f"m_{k}", k, *p) for k, p in kinds.items()])
    scanned = store(rows.select("id", "print", spans(BASE).alias("base"), spans(WEAK).alias("weak")), "spans")
    parts = scanned.where(F.size("weak") > 0).select("id", "print", F.inline(F.concat("base", "weak"))).distinct()
    linked = link(parts, scope).groupBy(F.col("id").alias("i"), F.col("print").alias("p")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    out = scanned.join(linked, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p")), "left")
    return out.select("id", "print", _in_order(F.col("base")).alias("base"), _in_order(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span (in order; overlaps merge) replaced by ``mask``."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.otherwise(acc["out"]).alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, tail)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``df`` with secrets masked in its text; rows without secrets come back as they were."""
    i, p, spans = fresh_names(df, "i", "p", "spans")
    found = scan(df, id_col, text_col, scope).where(F.size("spans") > 0)
    found = found.groupBy(F.col("id").alias(i), F.col("print").alias(p)).agg(F.first("spans").alias(spans))
    on = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(p))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col(spans)))
    return df.join(found, on, "left").withColumn(text_col, text).select(*df.columns)
