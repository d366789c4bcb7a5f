"""Url rules and empirical-Bayes host reputation.

Labelled pages give each host a count of bad outcomes. Rates are shrunk from the top down:
a suffix towards all pages, a registered domain towards its suffix, a host towards its domain. The
strength of each level's beta prior comes from the data: the more its groups spread beyond
binomial noise around their parents, the weaker the prior. A page is blocked if the lower posterior
bound of its host's bad rate exceeds ``LIMIT``. Rules come before the method; the longest that fits decides.

Counting combines on the map side, so a host with a third of all pages costs one row a task; only
blocked hosts meet the pages again, and that join may split a frequent host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 0.25
Z = 1.645
#: Bad rate before any label, worth one page.
PRIOR = 0.05
#: Bounds of the intra-group correlation; the prior's strength is 1 / rho - 1 observations.
RHO = (0.001, 0.5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str | Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lowered; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: str | Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain(host_col: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host_col, ".", -2)


def suffix(host_col: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host_col, ".", -1)


def rule_of(host_col: Column, path_col: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    ``rules`` is a short configured list of (verdict, host and path).
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        top, slash, rest = rule.partition("/")
        fits = ((host_col == top) | host_col.endswith("." + top)) & path_col.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _level(groups: DataFrame, key: str, parent: str) -> DataFrame:
    """Posterior mean of each group; ``groups`` has key, n, bad and its parent's mean."""
    p = F.col(parent)
    excess = F.when(F.col("n") > 0, (F.col("bad") - F.col("n") * p) ** 2 / (F.col("n") * p * (1 - p)) - 1)
    spread = groups.agg(F.sum(excess).alias("excess"), F.sum(F.when(F.col("n") > 0, F.col("n") - 1)).alias("free"))
    rho = F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), F.coalesce(F.col("excess") / F.when(F.col("free") > 0, F.col("free")), F.lit(RHO[0]))))
    strength = spread.select((1 / rho - 1).alias("strength")).scalar()
    return groups.withColumn("strength", strength).withColumn("mean", (F.col("bad") + F.col("strength") * p) / (F.col("n") + F.col("strength")))


def reputation(outcomes: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """(host, mean, bound, blocked) of every host of ``outcomes`` (host, n, bad: additive rows)."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumn("domain", domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("suffix", suffix(F.col("domain")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.agg(((F.sum("bad") + PRIOR) / (F.sum("n") + 1)).alias("p")).scalar()
    suffixes = _level(suffixes.withColumn("top", top), "suffix", "top").select("suffix", F.col("mean").alias("suffix_mean"))
    domains = _level(domains.join(suffixes, "suffix"), "domain", "suffix_mean").select("domain", F.col("mean").alias("domain_mean"))
    hosts = _level(hosts.join(domains, "domain"), "host", "domain_mean")
    total = F.col("n") + F.col("strength")
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return hosts.select("host", "mean", bound.alias("bound"), (bound > limit).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict) for every page.

    ``labels`` has (id, bad): 1 for a bad outcome, null for none; an id labelled twice is bad if either
    says so. Null urls and urls without ``://`` have an empty host, judged like any other; repeated
    pages are judged alike and each labelled one counts. Other columns don't matter.
    """
    rows = pages.select(F.col(id_col).alias("id"), host(url_col).alias("host"), path(url_col).alias("path"))
    known = labels.where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad"))
    joined = rows.select("id", "host").join(known, "id", "left")
    outcomes = joined.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = reputation(outcomes, limit).where("blocked").select(F.col("host").alias("_host"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(blocked, F.col("host") == F.col("_host"), "left").select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
