"""Queries for projections, joins, aggregates, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.catalog.registry import edge, query
from panelwise.catalog.sql import EPS, build, corr, cv, r, rs, ym
from panelwise.operators import clean, indices, rollup, stats
from panelwise.operators.ordered import quantile_row, running, with_ranks, with_row
from panelwise.plans import bindings as b
from panelwise.session import materialize

TOTALS = "a_total,a_1,a_2,a_3,b_total,b_1,b_2,c_total,c_1,c_2"
RATIOS = ("update_ratio", "b_ratio", "c_ratio", "a1_share", "a2_share", "b2_share", "c2_share")

# A dirty copy of the customers' nation names, derived from the tables in both engines.
DIRTY_SQL = """SELECT c_custkey AS id, CASE c_custkey%7 WHEN 0 THEN '  '||lower(n_name)||' ' WHEN 1 THEN 'o''brien-'||n_name
 WHEN 2 THEN '100000' WHEN 3 THEN 'westbengal' WHEN 4 THEN ' Daman & Diu' WHEN 5 THEN 'WEST  BENGAL' ELSE upper(c_name) END AS name
 FROM customer JOIN nation ON c_nationkey=n_nationkey"""
TITLE_SQL = (
    "array_to_string(list_transform(regexp_extract_all(lower({x}),'[a-z]+|[^a-z]+'),"
    " lambda v: upper(v[1:1])||v[2:]),'')"
)
DIRTY_T = TITLE_SQL.format(x="trim(name)")


def dirty(spark, d):
    n, k = F.col("n_name"), F.col("c_custkey") % 7
    c = b.table(spark, d, "customer").join(b.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(k == 0, F.concat(F.lit("  "), F.lower(n), F.lit(" ")))
        .when(k == 1, F.concat(F.lit("o'brien-"), n))
        .when(k == 2, F.lit("100000"))
        .when(k == 3, F.lit("westbengal"))
        .when(k == 4, F.lit(" Daman & Diu"))
        .when(k == 5, F.lit("WEST  BENGAL"))
        .otherwise(F.upper("c_name"))
        .alias("name"),
    )


def date_text(c):
    return F.when(F.day(c) % 3 == 0, F.date_format(c, "dd-MM-yyyy")).when(F.day(c) % 3 == 1, F.date_format(c, "dd/MM/yyyy")).otherwise(
        F.when(F.day(c) % 5 == 0, F.lit("not a date")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    )


# ---- projections and filters ---------------------------------------------------

@query(
    "p1_day_first_date",
    "SELECT o_orderkey, CASE WHEN day(o_orderdate)%3=2 AND day(o_orderdate)%5=0 THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d') END AS date FROM orders",
)
def _(s, d):
    o = b.table(s, d, "orders").select("o_orderkey", date_text(F.col("o_orderdate")).alias("text"))
    return edge(o.select("o_orderkey", clean.parse_day_first("text").alias("date")))


@query("p2_text_normalise", build("", f"SELECT id::BIGINT AS id, {DIRTY_T} AS name FROM ({DIRTY_SQL})"))
def _(s, d):
    return dirty(s, d).select("id", clean.normalise_text("name").alias("name"))


@query("p3_identifier_text", "SELECT c_custkey, c_custkey::VARCHAR AS site FROM customer")
def _(s, d):
    return b.table(s, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("site"))


@query("p4_non_negative", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_quantity-10>=0 AND l_discount-0.02>=0")
def _(s, d):
    li = b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 10).alias("x"), (F.col("l_discount") - 0.02).alias("y"))
    return edge(li.where(clean.non_negative(["x", "y"])).select("l_orderkey", "l_linenumber"))


@query("p5_sentinel_drop", build("", f"SELECT id::BIGINT AS id, name FROM ({DIRTY_SQL}) WHERE name<>'100000'"))
def _(s, d):
    return clean.drop_sentinel(dirty(s, d), "name")


@query(
    "p6_alias_names",
    build(
        "",
        f"""SELECT id::BIGINT AS id, CASE WHEN t IN ('Westbengal','West  Bengal') THEN 'West Bengal'
 WHEN t IN ('Daman & Diu') THEN 'Dadra And Nagar Haveli And Daman And Diu' ELSE t END AS name
 FROM (SELECT id, {DIRTY_T} AS t FROM ({DIRTY_SQL}))""",
    ),
)
def _(s, d):
    return dirty(s, d).select("id", clean.canonical_name(clean.normalise_text("name")).alias("name"))


@query(
    "p6_alias_table",
    "SELECT c_custkey AS id, r_name AS name FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
)
def _(s, d):
    alias = b.table(s, d, "nation").join(b.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("alias"), F.col("r_name").alias("name")
    )
    named = b.table(s, d, "customer").join(b.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return clean.rename_by_table(named.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("name")), "name", alias)


@query(
    "p7_calendar",
    """SELECT o_orderkey, strftime(o_orderdate,'%Y-%m') AS year_month, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month,
 year(o_orderdate)::VARCHAR||'Q'||quarter(o_orderdate)::VARCHAR AS quarter FROM orders""",
)
def _(s, d):
    return rollup.calendar(b.table(s, d, "orders"), "o_orderdate").select("o_orderkey", "year_month", "year", "month", "quarter")


@query("p8_row_totals", build("fb", "SELECT entity, strftime(date,'%Y-%m-%d') AS date, b_1, b_2, b_1+b_2 AS b_total FROM fb"))
def _(s, d):
    return edge(rollup.row_totals(b.facts_b(s, d), "b"))


@query("p9_guarded_ratios", build("panel", f"SELECT entity, {ym()} AS period, {rs(*RATIOS)}, activity FROM panel"))
def _(s, d):
    return edge(b.panel(s, d), "entity", "period", *RATIOS, "activity")


@query("p10_open_ratio", build("panel", f"SELECT entity, {ym()} AS period, {r('c_1/nullif(a_1::DOUBLE,0)')} AS ratio FROM panel"))
def _(s, d):
    from panelwise.functions.columns import open_ratio

    return edge(b.panel(s, d).select("entity", "period", open_ratio("c_1", "a_1").alias("ratio")))


@query("p11_logs", build("raws", f"SELECT entity, {rs('log_activity', 'pressure_raw')} FROM raws"))
def _(s, d):
    return edge(indices.raw_indices(materialize(b.profile(s, d))), "entity", "log_activity", "pressure_raw")


@query("p12_label", build("idx", "SELECT entity, label FROM idx"))
def _(s, d):
    return b.indexed(s, d).select("entity", "label")


@query("p13_action", build("idx", "SELECT entity, status, action FROM idx"))
def _(s, d):
    return b.indexed(s, d).select("entity", "status", "action")


def _v1_sql():
    from panelwise.catalog.sql import case_rules
    from panelwise.functions.fixed import STATUS_RULES_V1 as v1

    return build("idx", f"SELECT entity, {case_rules(v1, lambda x: x[0])} AS status, {case_rules(v1, lambda x: x[1])} AS action FROM idx")


@query("p13_action_older_rules", _v1_sql())
def _(s, d):
    from panelwise.functions.fixed import STATUS_RULES_V1

    return indices.with_action(b.indexed(s, d), STATUS_RULES_V1).select("entity", "status", "action")


@query(
    "p14_risk",
    build(
        "idx",
        """SELECT entity, CASE WHEN label LIKE '%Maintenance Stress%' OR label LIKE '%Overloaded%' THEN 'Critical'
 WHEN label LIKE '%Unpredictable%' THEN 'Warning' ELSE 'Stable' END AS risk FROM idx""",
    ),
)
def _(s, d):
    return b.indexed(s, d).select("entity", indices.risk_column("label").alias("risk"))


def _band(i, lo):
    return f"CASE WHEN {i}>=0.7 THEN 'high' WHEN {i}<{lo} THEN 'low' ELSE 'moderate' END AS {i}_band"


@query(
    "p15_bands",
    build("idx", "SELECT entity, " + ", ".join(_band(i, 0.3 if i == "predictability" else 0.4) for i in indices.INDICES) + " FROM idx"),
)
def _(s, d):
    return b.indexed(s, d).select("entity", *[indices.band_column(i).alias(f"{i}_band") for i in indices.INDICES])


@query(
    "p16_scope_filter",
    build("fa", "SELECT entity, strftime(date,'%Y-%m-%d') AS date, a_1, a_2, a_3 FROM fa WHERE date BETWEEN '1996-01-01' AND '1997-06-30' AND entity IN ('NATION_1','NATION_5','NATION_9')"),
)
def _(s, d):
    return edge(stats.in_scope(b.facts_a(s, d), "1996-01-01", "1997-06-30", ["NATION_1", "NATION_5", "NATION_9"]))


SCOPE = ["NATION_1", "NATION_2", "NATION_3", "NATION_7", "NATION_11"]
SCOPE_SQL = "('NATION_1','NATION_2','NATION_3','NATION_7','NATION_11')"


@query(
    "p17_scoped_outputs",
    build(
        "idx",
        f"""SELECT entity, activity, row_number() OVER (ORDER BY activity DESC, entity)::BIGINT AS activity_rank,
 {r('sum(activity) OVER (ORDER BY activity DESC, entity ROWS UNBOUNDED PRECEDING)/(sum(activity) OVER ())::DOUBLE')} AS cum_share,
 {rs('maturity', 'pressure')} FROM idx WHERE entity IN {SCOPE_SQL}""",
    ),
)
def _(s, d):
    scoped = stats.restrict({"profile": b.indexed(s, d)}, SCOPE)["pareto"]
    return edge(scoped, "entity", "activity", "activity_rank", "cum_share", "maturity", "pressure")


@query(
    "p18_category_cascade",
    build("panel idx", f"SELECT panel.entity, {ym()} AS period, panel.activity FROM panel WHERE entity IN (SELECT entity FROM idx WHERE label LIKE 'Balanced%')"),
)
def _(s, d):
    p = materialize(b.panel(s, d))
    prof = indices.index_profile(rollup.entity_profile(p))
    return edge(stats.cascade(prof, F.col("label").startswith("Balanced"), [p])[0], "entity", "period", "activity")


@query(
    "p19_risk_zones",
    build("idx", "SELECT entity, pressure>0.6 AND maturity<0.3 AS pressure_zone, volatility>0.6 AND activity>(SELECT quantile_cont(activity,0.5) FROM idx) AS volatile_zone FROM idx"),
)
def _(s, d):
    return indices.risk_zones(b.indexed(s, d)).select("entity", "pressure_zone", "volatile_zone")


@query(
    "p20_quadrant",
    build(
        "idx",
        """SELECT entity, CASE WHEN maturity>mm AND pressure>pm THEN 'Maintenance Stress' WHEN maturity>mm THEN 'Expansion Phase'
 WHEN pressure>pm THEN 'High Maintenance' ELSE 'Stable & Mature' END AS quadrant
 FROM idx, (SELECT quantile_cont(maturity,0.5) AS mm, quantile_cont(pressure,0.5) AS pm FROM idx)""",
    ),
)
def _(s, d):
    return indices.quadrant(b.indexed(s, d)).select("entity", "quadrant")


# ---- joins -----------------------------------------------------------------------

@query("j1_three_way_join", build("ra rb rc", f"SELECT entity, {ym()} AS period, {TOTALS} FROM ra JOIN rb USING (entity,period) JOIN rc USING (entity,period)"))
def _(s, d):
    j = rollup.join_feeds(rollup.rollup(b.facts_a(s, d), "a"), rollup.rollup(b.facts_b(s, d), "b"), rollup.rollup(b.facts_c(s, d), "c"))
    return edge(j, "entity", "period", *TOTALS.split(","))


@query(
    "j2_left_variant",
    build("ra rb rc", f"SELECT entity, {ym()} AS period, {', '.join(c + '::DOUBLE AS ' + c for c in TOTALS.split(','))} FROM rb LEFT JOIN ra USING (entity,period) LEFT JOIN rc USING (entity,period)"),
)
def _(s, d):
    j = rollup.join_feeds(rollup.rollup(b.facts_b(s, d), "b"), rollup.rollup(b.facts_a(s, d), "a"), rollup.rollup(b.facts_c(s, d), "c"), "left")
    return edge(j.select("entity", "period", *[F.col(c).cast("double").alias(c) for c in TOTALS.split(",")]))


@query(
    "j3_left_enrichment",
    build(
        "profile panel",
        f"SELECT entity, profile.activity, {rs('a_cv2', 'ratio_cv2')} FROM profile LEFT JOIN (SELECT entity, {cv('a_total')} AS a_cv2, {cv('update_ratio')} AS ratio_cv2 FROM panel GROUP BY 1) USING (entity)",
    ),
)
def _(s, d):
    p = materialize(b.panel(s, d))
    extra = rollup.variation_by_entity(p).select("entity", F.col("a_cv").alias("a_cv2"), F.col("ratio_cv").alias("ratio_cv2"))
    return edge(rollup.entity_profile(p).select("entity", "activity").join(extra, "entity", "left"))


@query(
    "j4_semi_join",
    "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT o_custkey FROM orders)",
)
def _(s, d):
    keys = b.table(s, d, "orders").select(F.col("o_custkey").alias("p_partkey"))
    return edge(clean.keep_known(b.table(s, d, "part").select("p_partkey", "p_brand"), keys, "p_partkey"))


@query(
    "j5_unknown_keys",
    "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def _(s, d):
    known = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return clean.unknown_keys(b.table(s, d, "orders").select(F.col("o_custkey").alias("k")), known, "k")


@query(
    "j6_scalar_compare",
    build("cust", "SELECT entity, cents>(SELECT quantile_cont(cents,0.75) FROM cust) AS high, orders<(SELECT avg(orders) FROM cust) AS few FROM cust"),
)
def _(s, d):
    c = materialize(b.customer_profile(s, d))
    row = with_row(quantile_row(c, {"q": ("cents", 0.75)}), c.agg(F.avg("orders").alias("m")))
    return with_row(c, row).select("entity", (F.col("cents") > F.col("q")).alias("high"), (F.col("orders") < F.col("m")).alias("few"))


@query(
    "j7_entity_donor_pairs",
    build(
        "panel",
        """SELECT x.entity AS treated, y.entity AS donor, count(*)::BIGINT AS periods, sum(x.activity*y.activity)::BIGINT AS cross_moment
 FROM panel x JOIN panel y ON x.period=y.period AND x.entity<>y.entity WHERE x.entity IN ('NATION_3','NATION_8') GROUP BY 1,2""",
    ),
)
def _(s, d):
    from panelwise.operators.synthetic import donor_pairs

    p = materialize(b.panel(s, d).select("entity", "period", "activity"))
    pairs = donor_pairs(p, ["NATION_3", "NATION_8"], "activity")
    return pairs.groupBy("treated", "donor").agg(
        F.count(F.lit(1)).alias("periods"), F.sum(F.col("y") * F.col("x")).cast("long").alias("cross_moment")
    )


@query(
    "j9_peer_median",
    build(
        "idx",
        "SELECT indicator, "
        + r("own")
        + " AS own, "
        + r("peers")
        + " AS peers FROM ("
        + " UNION ALL ".join(
            f"SELECT '{i}' AS indicator, (SELECT {i} FROM idx WHERE entity='NATION_4') AS own, quantile_cont({i},0.5) AS peers FROM idx"
            for i in indices.INDICES
        )
        + ")",
    ),
)
def _(s, d):
    return edge(stats.peer_comparison(b.indexed(s, d), "NATION_4", indices.INDICES))


# ---- aggregates ------------------------------------------------------------------

@query("a1_panel_rollup", build("rc", f"SELECT entity, {ym()} AS period, c_total, c_1, c_2 FROM rc"))
def _(s, d):
    return edge(rollup.rollup(b.facts_c(s, d), "c"))


PROFILE_D = ("a1_share", "a2_share", "b2_share", "c2_share", "avg_update_ratio", "avg_b_ratio", "avg_c_ratio")


@query("a2_entity_profile", build("profile", f"SELECT entity, a_total, b_total, c_total, active_periods, activity, {rs(*PROFILE_D, 'log_activity')} FROM profile"))
def _(s, d):
    return edge(b.profile(s, d), "entity", "a_total", "b_total", "c_total", "active_periods", "activity", *PROFILE_D, "log_activity")


@query(
    "a3_period_summary",
    build(
        "panel",
        f"""SELECT {ym()} AS period, sum(a_total)::BIGINT AS a_total, sum(b_total)::BIGINT AS b_total, sum(c_total)::BIGINT AS c_total,
 {", ".join(r(f"avg({c})") + " AS " + c for c in ("b_ratio", "c_ratio", "update_ratio", "a1_share", "b2_share", "c2_share"))},
 sum(activity)::BIGINT AS activity FROM panel GROUP BY period""",
    ),
)
def _(s, d):
    return edge(rollup.period_summary(b.panel(s, d)))


@query("a4_variation", build("profile", f"SELECT entity, {rs('a_cv', 'b_cv', 'c_cv', 'ratio_cv')} FROM profile"))
def _(s, d):
    return edge(rollup.variation_by_entity(b.panel(s, d)))


CORR_COLS = ["a_total", "b_total", "c_total", "update_ratio", "a1_share", "b2_share", "c2_share"]


def corr_sql(cte: str, cols: list[str], source: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS metric, " + ", ".join(f"{r('1.0' if x == y else corr(x, y))} AS {y}" for y in cols) + f" FROM {source}" for x in cols
    )
    return build(cte, rows)


@query("a5_corr_matrix", corr_sql("panel", CORR_COLS, "panel"))
def _(s, d):
    return edge(stats.corr_matrix(b.panel(s, d), CORR_COLS))


@query("a5_index_corr_matrix", corr_sql("idx", indices.INDICES, "idx"))
def _(s, d):
    return edge(stats.corr_matrix(b.indexed(s, d), indices.INDICES))


@query("a6_pair_corr", build("panel", f"SELECT {r(corr('a_total', 'c_total'))} AS value FROM panel"))
def _(s, d):
    return edge(stats.pair_corr(b.panel(s, d), "a_total", "c_total"))


@query(
    "a7_spearman",
    build(
        "cust",
        f"""SELECT 'orders_cents' AS metric, {r(corr('ro', 'rc'))} AS value FROM (SELECT
 rank() OVER (ORDER BY orders)+(count(*) OVER (PARTITION BY orders)-1)/2::DOUBLE AS ro,
 rank() OVER (ORDER BY cents)+(count(*) OVER (PARTITION BY cents)-1)/2::DOUBLE AS rc FROM cust)""",
    ),
)
def _(s, d):
    return edge(stats.spearman(materialize(b.customer_profile(s, d)), [("orders_cents", "orders", "cents")]))


@query("a8_lag_corr", build("profile", f"SELECT entity, {rs('lag1_corr', 'lag2_corr')} FROM profile"))
def _(s, d):
    return edge(rollup.lag_correlation(b.panel(s, d)))


@query(
    "a9_quantiles",
    build(
        "cust",
        "SELECT " + ", ".join(f"{r(f'quantile_cont(cents,{p})')} AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9)) + " FROM cust",
    ),
)
def _(s, d):
    c = materialize(b.customer_profile(s, d))
    return edge(quantile_row(c, {f"q{int(p * 100)}": ("cents", p) for p in (0.25, 0.5, 0.75, 0.9)}))


@query(
    "a9_quantiles_bucketed",
    "SELECT " + ", ".join(f"{r(f'quantile_cont(l_extendedprice,{p})')} AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9)) + " FROM lineitem",
)
def _(s, d):
    li = b.table(s, d, "lineitem").select("l_extendedprice")
    return edge(quantile_row(li, {f"q{int(p * 100)}": ("l_extendedprice", p) for p in (0.25, 0.5, 0.75, 0.9)}, small_rows=0))


@query(
    "a10_mad",
    build(
        "cust",
        f"SELECT {r('m')} AS median, {r('quantile_cont(abs(cents-m),0.5)')} AS mad FROM cust, (SELECT quantile_cont(cents,0.5) AS m FROM cust) GROUP BY m",
    ),
)
def _(s, d):
    c = materialize(b.customer_profile(s, d))
    return edge(indices.median_deviation(c, ["cents"]).select(F.col("med_cents").alias("median"), F.col("mad_cents").alias("mad")))


HIST = """SELECT entity, bin, count(v)::BIGINT AS n FROM (SELECT entity, unnest(range(10)) AS bin FROM (SELECT DISTINCT entity FROM panel)) g
 LEFT JOIN (SELECT entity AS e, activity AS v, least(9, floor((activity-lo)/w)::BIGINT) AS vb FROM (SELECT entity, activity,
 (min(activity) OVER p)-(CASE WHEN max(activity) OVER p=min(activity) OVER p THEN 0.5 ELSE 0 END) AS lo,
 (CASE WHEN max(activity) OVER p=min(activity) OVER p THEN 1.0 ELSE max(activity) OVER p-min(activity) OVER p END)/10::DOUBLE AS w
 FROM panel WINDOW p AS (PARTITION BY entity))) x ON e=entity AND vb=bin GROUP BY 1,2"""


@query("a11_histogram", build("panel", HIST))
def _(s, d):
    return stats.histogram(b.panel(s, d), "activity", F.lit(10), ["entity"])


@query("a12_entropy", build("", f"SELECT source, {r('coalesce(-sum(p*log2(p)),0)')} AS entropy FROM (SELECT source, count(*)/(sum(count(*)) OVER (PARTITION BY source))::DOUBLE AS p FROM (SELECT l_returnflag AS source, l_shipmode AS x FROM (SELECT l_returnflag, l_linenumber AS l_shipmode FROM lineitem)) GROUP BY source, x) GROUP BY source"))
def _(s, d):
    li = b.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("source"), "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return edge(stats.entropy(li, "n", ["source"]))


@query("a13_share_of_total", build("profile", f"SELECT entity, {r(f'activity/(sum(activity) OVER ()+{EPS})')} AS share FROM profile"))
def _(s, d):
    return edge(stats.share_of_total(b.profile(s, d), "activity"), "entity", "share")


@query("a14_distinct_counts", "SELECT count(DISTINCT o_custkey)::BIGINT AS customers, count(DISTINCT o_orderpriority)::BIGINT AS priorities FROM orders")
def _(s, d):
    return stats.distinct_counts(b.table(s, d, "orders"), {"o_custkey": "customers", "o_orderpriority": "priorities"})


@query("a14_distinct_values", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1")
def _(s, d):
    return stats.distinct_values(b.table(s, d, "orders"), "o_orderpriority")


@query("a15_value_counts", build("idx", "SELECT label, count(*)::BIGINT AS n FROM idx GROUP BY 1"))
def _(s, d):
    return stats.value_counts(b.indexed(s, d), "label")


@query(
    "a16_mode",
    "SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS k FROM events GROUP BY 1,2) WHERE k=1",
)
def _(s, d):
    return stats.mode_of(b.table(s, d, "events"), "user_id", ["event_type"])


@query(
    "a17_kpi_row",
    build(
        "fl panel",
        """SELECT count(*)::BIGINT AS entities, (SELECT count(DISTINCT period) FROM panel)::BIGINT AS periods, sum(activity)::BIGINT AS total,
 count(*) FILTER (flag_count>0)::BIGINT AS flagged, count(*) FILTER (flag_count>=2)::BIGINT AS high_risk,
 (SELECT label FROM fl GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) AS top_label FROM fl""",
    ),
)
def _(s, d):
    p = materialize(b.panel(s, d))
    flagged = indices.anomaly_flags(materialize(indices.index_profile(rollup.entity_profile(p))))
    return stats.kpi_row(p, flagged)


@query(
    "a19_dedupe",
    "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem",
)
def _(s, d):
    return clean.dedupe(b.table(s, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


@query(
    "a20_duplicate_count",
    "SELECT sum(c)::BIGINT AS rows, count(*)::BIGINT AS distinct_rows, (sum(c)-count(*))::BIGINT AS duplicates FROM (SELECT l_suppkey, l_partkey, count(*) AS c FROM lineitem GROUP BY 1,2)",
)
def _(s, d):
    return clean.duplicate_count(b.table(s, d, "lineitem"), ["l_suppkey", "l_partkey"])


@query("a21_negative_counts", "SELECT count(*) FILTER (c_acctbal<0)::BIGINT AS c_acctbal, count(*) FILTER (c_custkey<0)::BIGINT AS c_custkey FROM customer")
def _(s, d):
    return clean.negative_counts(b.table(s, d, "customer"), ["c_acctbal", "c_custkey"])


DESC = [("a_total", "panel"), ("update_ratio", "panel")]


@query(
    "a22_describe",
    build(
        "panel",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS metric, count({c})::BIGINT AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
 {r(f'quantile_cont({c},0.25)')} AS q25, {r(f'quantile_cont({c},0.5)')} AS q50, {r(f'quantile_cont({c},0.75)')} AS q75, {r(f'max({c})')} AS max FROM panel"""
            for c in ("a_total", "update_ratio")
        ),
    ),
)
def _(s, d):
    return edge(stats.describe(materialize(b.panel(s, d).select("a_total", "update_ratio")), ["a_total", "update_ratio"]))


@query(
    "a23_band_distribution",
    build("panel", "SELECT band, total, " + r("total/(sum(total) OVER ())::DOUBLE") + " AS share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS band, sum({c})::BIGINT AS total FROM panel" for c in ("a_1", "a_2", "a_3")) + ")"),
)
def _(s, d):
    return edge(stats.band_distribution(b.panel(s, d), ["a_1", "a_2", "a_3"]))


@query(
    "a31_table_profile",
    "SELECT 'o_custkey' AS column_name, count(*)::BIGINT AS rows, count(*) FILTER (o_custkey IS NULL)::BIGINT AS nulls FROM orders UNION ALL "
    "SELECT 'late_price', count(*), count(*) FILTER (CASE WHEN o_orderstatus='F' THEN o_totalprice END IS NULL) FROM orders",
)
def _(s, d):
    o = b.table(s, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("late_price"))
    return stats.table_profile(o)


# ---- windows -----------------------------------------------------------------------

@query("w1_avg_rank", build("cust", f"SELECT entity, {r('rank() OVER (ORDER BY orders DESC)+(count(*) OVER (PARTITION BY orders)-1)/2::DOUBLE')} AS rank FROM cust"))
def _(s, d):
    return edge(with_ranks(materialize(b.customer_profile(s, d)), [("orders", "rank", "average", True)]), "entity", "rank")


@query("w1_avg_rank_bucketed", build("cust", f"SELECT entity, {r('rank() OVER (ORDER BY orders DESC)+(count(*) OVER (PARTITION BY orders)-1)/2::DOUBLE')} AS rank FROM cust"))
def _(s, d):
    return edge(with_ranks(materialize(b.customer_profile(s, d)), [("orders", "rank", "average", True)], small_rows=0), "entity", "rank")


@query("w2_min_rank", build("cust", "SELECT entity, rank() OVER (ORDER BY urgent DESC)::BIGINT AS rank FROM cust"))
def _(s, d):
    return edge(with_ranks(materialize(b.customer_profile(s, d)), [("urgent", "rank", "min", True)]), "entity", "rank")


@query("w3_fraction_rank", build("cust", f"SELECT entity, {r('(rank() OVER (ORDER BY orders)+(count(*) OVER (PARTITION BY orders)-1)/2::DOUBLE)/count(*) OVER ()')} AS rank FROM cust"))
def _(s, d):
    return edge(with_ranks(materialize(b.customer_profile(s, d)), [("orders", "rank", "fraction", False)], small_rows=0), "entity", "rank")


@query("w4_row_number", build("cust", "SELECT entity, row_number() OVER (ORDER BY orders DESC, entity)::BIGINT AS position FROM cust"))
def _(s, d):
    return running(materialize(b.customer_profile(s, d)), [("orders", True), ("entity", False)], small_rows=0).select("entity", "position")


PARETO = (
    "SELECT entity, activity, row_number() OVER (ORDER BY activity DESC, entity)::BIGINT AS activity_rank, "
    + r(f"sum(activity) OVER (ORDER BY activity DESC, entity ROWS UNBOUNDED PRECEDING)/(sum(activity) OVER ()+{EPS})")
    + " AS cum_share FROM {src}"
)


@query("w5_pareto", build("profile", PARETO.format(src="profile")))
def _(s, d):
    return edge(indices.pareto(materialize(b.profile(s, d))), "entity", "activity", "activity_rank", "cum_share")


@query("w5_pareto_customers", build("cust", PARETO.format(src="(SELECT entity, cents AS activity FROM cust)")))
def _(s, d):
    return edge(indices.pareto(materialize(b.customer_profile(s, d).select("entity", F.col("cents").alias("activity")))), "entity", "activity", "activity_rank", "cum_share")


@query(
    "w6_shifts",
    build(
        "panel",
        f"SELECT entity, {ym()} AS period, " + ", ".join(f"(lag(a_total,{k}) OVER w)::DOUBLE AS lag_{k}" for k in (1, 2, 3, 6, 12)) + ", " + ", ".join(f"(lead(a_total,{k}) OVER w)::DOUBLE AS lead_{k}" for k in (1, 2)) + " FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period)",
    ),
)
def _(s, d):
    x = stats.shifts(b.panel(s, d).withColumn("a_total", F.col("a_total").cast("double")), "a_total", lags=(1, 2, 3, 6, 12), leads=(1, 2))
    return edge(x, "entity", "period", *[f"lag_{k}" for k in (1, 2, 3, 6, 12)], "lead_1", "lead_2")


@query(
    "w7_rolling",
    build(
        "panel",
        f"SELECT entity, {ym()} AS period, "
        + ", ".join(
            f"{r(f'avg(b_total) OVER (PARTITION BY entity ORDER BY period ROWS {w - 1} PRECEDING)')} AS mean_{w}, {r(f'stddev_samp(b_total) OVER (PARTITION BY entity ORDER BY period ROWS {w - 1} PRECEDING)')} AS std_{w}"
            for w in (3, 6, 12)
        )
        + " FROM panel",
    ),
)
def _(s, d):
    x = stats.rolling(b.panel(s, d), "b_total", (3, 6, 12))
    return edge(x, "entity", "period", *[f"{k}_{w}" for w in (3, 6, 12) for k in ("mean", "std")])


@query("w8_sequence", build("panel", f"SELECT entity, {ym()} AS period, (row_number() OVER (PARTITION BY entity ORDER BY period)-1)::BIGINT AS trend FROM panel"))
def _(s, d):
    return edge(stats.sequence_number(b.panel(s, d)), "entity", "period", "trend")


@query(
    "w9_group_means",
    build(
        "panel",
        f"""SELECT entity, {ym()} AS period, {r('avg(b_total) OVER (PARTITION BY period)')} AS period_mean, {r('b_total-avg(b_total) OVER (PARTITION BY period)')} AS period_gap,
 {r('avg(b_total) OVER (PARTITION BY entity)')} AS entity_mean, {r('b_total-avg(b_total) OVER (PARTITION BY entity)')} AS entity_gap FROM panel""",
    ),
)
def _(s, d):
    return edge(stats.group_means(b.panel(s, d), "b_total"), "entity", "period", "period_mean", "period_gap", "entity_mean", "entity_gap")


@query(
    "w10_differences",
    build(
        "panel",
        f"""SELECT entity, {ym()} AS period, d1, d1-lag(d1) OVER w AS d2 FROM (SELECT entity, period,
 (b_total-lag(b_total) OVER (PARTITION BY entity ORDER BY period))::DOUBLE AS d1 FROM panel) WINDOW w AS (PARTITION BY entity ORDER BY period)""",
    ),
)
def _(s, d):
    p = b.panel(s, d).withColumn("b_total", F.col("b_total").cast("double"))
    x = stats.difference(stats.difference(p, "b_total", 1, "d1"), "b_total", 2, "d2")
    return edge(x, "entity", "period", "d1", "d2")


@query(
    "w6_densified_lag",
    build(
        "panel",
        f"""SELECT entity, {ym()} AS period, a_total, lag(a_total) OVER (PARTITION BY entity ORDER BY period)::DOUBLE AS lag_1 FROM (
 SELECT g.entity, g.period, coalesce(panel.a_total,0) AS a_total FROM (SELECT entity, unnest(generate_series(min(period)::TIMESTAMP,max(period)::TIMESTAMP,INTERVAL 1 MONTH))::DATE AS period FROM panel GROUP BY 1) g LEFT JOIN panel USING (entity,period))""",
    ),
)
def _(s, d):
    full = rollup.densify(b.panel(s, d).select("entity", "period", "a_total"), ["a_total"])
    return edge(stats.shifts(full, "a_total", lags=(1,)).withColumn("lag_1", F.col("lag_1").cast("double")))


@query("w14_percent_below", build("cust", "SELECT entity, floor(100*(rank() OVER (ORDER BY cents)-1)/count(*) OVER ())::BIGINT AS pct FROM cust"))
def _(s, d):
    return stats.percent_below(materialize(b.customer_profile(s, d)), "cents").select("entity", "pct")


@query(
    "w15_ecdf",
    build("cust", f"SELECT entity, {r('cume_dist() OVER (ORDER BY orders)')} AS left_tail, {r('cume_dist() OVER (ORDER BY orders DESC)')} AS right_tail FROM cust"),
)
def _(s, d):
    x = with_ranks(materialize(b.customer_profile(s, d)), [("orders", "left_tail", "cdf", False), ("orders", "right_tail", "cdf", True)], small_rows=0)
    return edge(x, "entity", "left_tail", "right_tail")


@query(
    "w16_gaps",
    """SELECT event_type AS entity, quantile_cont(g,0.5)::DOUBLE AS median_gap, max(g)::BIGINT AS max_gap, max(g)>3*quantile_cont(g,0.5) AS large_gaps,
 count(*)::BIGINT-count(DISTINCT d)::BIGINT AS duplicate_dates FROM (SELECT event_type, d, date_diff('day', lag(d) OVER (PARTITION BY event_type ORDER BY d), d) AS g
 FROM (SELECT event_type, ts::DATE AS d FROM events)) GROUP BY 1""",
)
def _(s, d):
    e = b.table(s, d, "events").select(F.col("event_type").alias("entity"), F.col("ts").cast("date").alias("date"))
    return stats.gap_statistics(e, "date", ["entity"]).select("entity", "median_gap", "max_gap", "large_gaps", "duplicate_dates")


@query(
    "w17_tail",
    build("panel", f"SELECT entity, {ym()} AS period, b_total FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS k FROM panel) WHERE k<=18"),
)
def _(s, d):
    return edge(stats.last_rows(b.panel(s, d), 18), "entity", "period", "b_total")


# ---- ordering ----------------------------------------------------------------------

@query("t1_multi_key_sort", build("fl", f"SELECT entity, flag_count, {rs('volatility', 'pressure')} FROM fl ORDER BY flag_count DESC, fl.volatility DESC, fl.pressure DESC, entity"))
def _(s, d):
    return edge(indices.anomaly_flags(materialize(b.indexed(s, d))).orderBy(*indices.anomaly_order()), "entity", "flag_count", "volatility", "pressure")


@query("t2_top_k", build("cust", "(SELECT 'top' AS side, entity, cents FROM cust ORDER BY cents DESC, entity LIMIT 15) UNION ALL (SELECT 'bottom', entity, cents FROM cust ORDER BY cents, entity LIMIT 10)"))
def _(s, d):
    c = b.customer_profile(s, d)
    top = stats.top_k(c, [F.desc("cents"), F.asc("entity")], 15).select(F.lit("top").alias("side"), "entity", "cents")
    low = stats.top_k(c, [F.asc("cents"), F.asc("entity")], 10).select(F.lit("bottom").alias("side"), "entity", "cents")
    return top.unionByName(low)


@query("t4_priority_queue", build("focus", f"SELECT entity, label, flag_count, {rs('priority')} FROM focus ORDER BY focus.priority DESC, entity LIMIT 12"))
def _(s, d):
    flagged = indices.anomaly_flags(materialize(b.indexed(s, d)))
    return edge(stats.top_k(indices.focus_summary(flagged), indices.focus_order(), 12), "entity", "label", "flag_count", "priority")


@query(
    "t6_nulls_last",
    build("panel", f"SELECT entity, {ym()} AS period, g::DOUBLE AS gain FROM (SELECT entity, period, b_total-lag(b_total) OVER (PARTITION BY entity ORDER BY period) AS g FROM panel) ORDER BY g ASC NULLS LAST, entity, period"),
)
def _(s, d):
    x = stats.difference(b.panel(s, d), "b_total", 1, "gain").orderBy(F.asc_nulls_last("gain"), "entity", "period")
    return edge(x.select("entity", "period", F.col("gain").cast("double").alias("gain")))


@query("t8_best_candidate", "SELECT event_type, user_id, m AS metric FROM (SELECT event_type, user_id, min(round(value*100)::BIGINT) AS m, row_number() OVER (PARTITION BY event_type ORDER BY min(round(value*100)::BIGINT), user_id) AS k FROM events GROUP BY 1,2) WHERE k=1")
def _(s, d):
    m = b.table(s, d, "events").groupBy("event_type", "user_id").agg(F.min(F.round(F.col("value") * 100).cast("long")).alias("metric"))
    return stats.best_by(m, "metric", ["event_type"], ["user_id"])


# ---- set operations and reshaping ----------------------------------------------------

@query("u1_union_inputs", "SELECT c_custkey AS k, c_nationkey::BIGINT AS nk, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_nationkey::BIGINT, NULL FROM supplier")
def _(s, d):
    c = b.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("nk"), F.col("c_mktsegment").alias("seg"))
    p = b.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("nk"))
    return stats.union_all([c, p])


@query("u2_detail_and_total", build("ra", f"SELECT entity, {ym()} AS period, a_total FROM ra UNION ALL SELECT 'Total', {ym()}, sum(a_total)::BIGINT FROM ra GROUP BY period"))
def _(s, d):
    x = rollup.rollup(b.facts_a(s, d), "a").select("entity", "period", "a_total")
    return edge(stats.with_total(x, "a_total", "Total"))


@query("u3_set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(s, d):
    return stats.set_difference(b.table(s, d, "customer").select(F.col("c_custkey").alias("k")), b.table(s, d, "orders").select(F.col("o_custkey").alias("k")))


@query(
    "u4_set_equality",
    "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation))+(SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer))=0 AS equal",
)
def _(s, d):
    return stats.set_equal(b.table(s, d, "customer").select(F.col("c_nationkey").alias("k")), b.table(s, d, "nation").select(F.col("n_nationkey").alias("k")))


@query("u5_distinct_rows", "SELECT DISTINCT event_type, user_id FROM events")
def _(s, d):
    return clean.dedupe(b.table(s, d, "events").select("event_type", "user_id"))


@query("u6_common_keys", "SELECT o_custkey::BIGINT AS k FROM orders INTERSECT SELECT s_suppkey::BIGINT FROM supplier")
def _(s, d):
    x = b.table(s, d, "orders").select(F.col("o_custkey").cast("long").alias("k"))
    y = b.table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    return stats.common_keys(x, y)


@query("u7_wide_to_long", build("panel", " UNION ALL ".join(f"SELECT entity, {ym()} AS period, '{c}' AS measure, {r(c)} AS value FROM panel" for c in ("update_ratio", "b_ratio", "c_ratio"))))
def _(s, d):
    return edge(stats.to_long(b.panel(s, d), ["entity", "period"], ["update_ratio", "b_ratio", "c_ratio"]))


@query("u8_long_to_wide", build("panel", f"SELECT {ym()} AS period, " + ", ".join(f"max(activity::DOUBLE) FILTER (entity='NATION_{i}') AS NATION_{i}" for i in range(25)) + " FROM panel GROUP BY period"))
def _(s, d):
    p = b.panel(s, d).withColumn("activity", F.col("activity").cast("double"))
    return edge(stats.to_wide(p, "activity", [f"NATION_{i}" for i in range(25)]))


# ---- normalisation -------------------------------------------------------------------

@query("f1_minmax", build("idx", f"SELECT entity, {rs('pressure', 'volatility')} FROM idx"))
def _(s, d):
    raw = indices.raw_indices(materialize(b.profile(s, d)))
    return edge(indices.minmax(raw, {"pressure_raw": "pressure", "volatility_raw": "volatility"}), "entity", "pressure", "volatility")


@query("f2_minmax_open", build("cust", "SELECT entity, " + ", ".join(f"{r(f'({c}-min({c}) OVER ())/nullif((max({c}) OVER ()-min({c}) OVER ())::DOUBLE,0)')} AS {c}_scaled" for c in ("orders", "cents")) + " FROM cust"))
def _(s, d):
    c = b.customer_profile(s, d)
    return edge(indices.minmax(c, {"orders": "orders_scaled", "cents": "cents_scaled"}, guarded=False), "entity", "orders_scaled", "cents_scaled")


@query("f3_zscore", build("cust", "SELECT entity, " + ", ".join(f"{r(f'({c}-avg({c}) OVER ())/(stddev_pop({c}) OVER ())')} AS {c}_z" for c in ("orders", "cents")) + " FROM cust"))
def _(s, d):
    return edge(indices.zscore(b.customer_profile(s, d), {"orders": "orders_z", "cents": "cents_z"}), "entity", "orders_z", "cents_z")


MADZ = "CASE WHEN mad<1e-10 THEN 0 ELSE (cents-m)/(1.4826*mad) END"
MADSRC = "cust, (SELECT m, quantile_cont(abs(cents-m),0.5) AS mad FROM cust, (SELECT quantile_cont(cents,0.5) AS m FROM cust) GROUP BY m)"


@query("f4_mad_z", build("cust", f"SELECT entity, {r(MADZ)} AS z FROM {MADSRC}"))
def _(s, d):
    return edge(indices.robust_score(materialize(b.customer_profile(s, d)), {"cents": "z"}, unit=False), "entity", "z")


@query("f5_mad_sigmoid", build("cust", f"SELECT entity, {r(f'1/(1+exp(-({MADZ})))')} AS score FROM {MADSRC}"))
def _(s, d):
    return edge(indices.robust_score(materialize(b.customer_profile(s, d)), {"cents": "score"}), "entity", "score")


@query(
    "f6_rescale",
    build("cust", f"SELECT entity, {r('1-(cents-min(cents) OVER ())/(max(cents) OVER ()-min(cents) OVER ()+1e-10)')} AS reversed, {r('(cents-min(cents) OVER ())/(max(cents) OVER ()-min(cents) OVER ())::DOUBLE')} AS forward FROM cust"),
)
def _(s, d):
    from panelwise.operators.anomaly import rescale

    c = b.customer_profile(s, d)
    return edge(rescale(rescale(c, "cents", "reversed", True), "cents", "forward", False), "entity", "reversed", "forward")


# ---- indices, flags, priority ----------------------------------------------------------

for _key, _col in (("i1_maturity", "maturity"), ("i2_pressure", "pressure"), ("i3_volatility", "volatility"), ("i4_predictability", "predictability")):

    @query(_key, build("idx", f"SELECT entity, {rs(_col)} FROM idx"))
    def _(s, d, col=_col):
        return edge(b.indexed(s, d), "entity", col)


def _sig(c):
    return f"1/(1+exp(-(CASE WHEN mad_{c}<1e-10 THEN 0 ELSE ({c}-med_{c})/(1.4826*mad_{c}) END)))"


ROBUST_RAW = {"maturity_raw": "robust_maturity", "pressure_raw": "robust_pressure", "volatility_raw": "robust_volatility"}
ROBUST_COLS = ", ".join(f"{r(_sig(c) if o != 'robust_maturity' else '1-' + _sig(c))} AS {o}" for c, o in ROBUST_RAW.items())
ROBUST_MED = "SELECT " + ", ".join(f"quantile_cont({c},0.5) AS med_{c}" for c in ROBUST_RAW) + " FROM raws"
ROBUST_MAD = "SELECT " + ", ".join(f"any_value(med_{c}) AS med_{c}, quantile_cont(abs({c}-med_{c}),0.5) AS mad_{c}" for c in ROBUST_RAW) + " FROM raws, rmed"


@query("i5_robust_indices", build("raws", f"SELECT entity, {ROBUST_COLS} FROM raws, rmad", rmed=ROBUST_MED, rmad=ROBUST_MAD))
def _(s, d):
    from panelwise.operators.robust import robust_indices

    return edge(robust_indices(indices.raw_indices(materialize(b.profile(s, d)))), "entity", *ROBUST_RAW.values())


ENTROPY_BINS = """SELECT entity, n, nb, vb, count(*) AS c FROM (SELECT entity, n, nb, least(nb-1, floor((v-lo)/w)::BIGINT) AS vb FROM (
 SELECT entity, activity AS v, count(*) OVER p AS n, least(12, count(*) OVER p) AS nb,
 min(activity) OVER p-(CASE WHEN max(activity) OVER p=min(activity) OVER p THEN 0.5 ELSE 0 END) AS lo,
 (CASE WHEN max(activity) OVER p=min(activity) OVER p THEN 1.0 ELSE max(activity) OVER p-min(activity) OVER p END)/(least(12,count(*) OVER p))::DOUBLE AS w
 FROM panel WINDOW p AS (PARTITION BY entity))) GROUP BY 1,2,3,4"""


@query(
    "i6_entropy_predictability",
    build(
        "panel",
        f"""SELECT entity, {r('h')} AS entropy, {r('h/hm')} AS entropy_share, {r('1-h/hm')} AS entropy_predictability FROM
 (SELECT entity, CASE WHEN n>=3 THEN -sum(c/n::DOUBLE*log2(c/n::DOUBLE)) END AS h, CASE WHEN nb>1 THEN log2(nb) ELSE 1 END AS hm FROM bins GROUP BY entity, n, nb)""",
        bins=ENTROPY_BINS,
    ),
)
def _(s, d):
    from panelwise.operators.robust import entropy_predictability

    return edge(entropy_predictability(b.panel(s, d)), "entity", "entropy", "entropy_share", "entropy_predictability")


FLAG_KEYS = {
    "i7_stress_flag": ("flag_stress", ""),
    "i8_mismatch_flag": ("flag_mismatch", ""),
    "i9_scale_flag": ("flag_scale", "volatility_excess"),
    "i10_distance_flag": ("flag_distance", "index_distance"),
}
for _key, (_flag, _num) in FLAG_KEYS.items():

    @query(_key, build("fl", f"SELECT entity, {_flag}{', ' + rs(_num) if _num else ''} FROM fl"))
    def _(s, d, flag=_flag, num=_num):
        return edge(indices.anomaly_flags(materialize(b.indexed(s, d))), "entity", flag, *([num] if num else []))


@query("i11_flag_count", build("fl", "SELECT entity, flag_count FROM fl"))
def _(s, d):
    return edge(indices.anomaly_flags(materialize(b.indexed(s, d))), "entity", "flag_count")


@query("i12_priority", build("focus", f"SELECT entity, {rs('priority')} FROM focus"))
def _(s, d):
    return edge(indices.focus_summary(indices.anomaly_flags(materialize(b.indexed(s, d)))), "entity", "priority")


FOCUS_D = ("maturity", "pressure", "volatility", "predictability", "volatility_excess", "index_distance", "priority")
FOCUS_O = ("entity", "activity", "label", "status", "flag_stress", "flag_mismatch", "flag_scale", "flag_distance", "flag_count")


@query("i13_focus_summary", build("focus", f"SELECT {', '.join(FOCUS_O)}, {rs(*FOCUS_D)} FROM focus ORDER BY focus.priority DESC, entity"))
def _(s, d):
    out = indices.focus_summary(indices.anomaly_flags(materialize(b.indexed(s, d)))).orderBy(*indices.focus_order())
    return edge(out, *FOCUS_O, *FOCUS_D)


def _scoped(sql: str) -> str:
    """The same SQL over facts limited to a date window and an entity set."""
    out = sql
    for f in ("fa", "fb", "fc"):
        out = out.replace(f" FROM {f} GROUP BY", f" FROM {f} WHERE date BETWEEN '1996-01-01' AND '1998-12-31' AND entity IN {SCOPE_SQL} GROUP BY")
    return out


@query("i14_scope_recompute", _scoped(build("focus", f"SELECT entity, label, flag_count, {rs('maturity', 'pressure', 'volatility', 'predictability', 'priority')} FROM focus")))
def _(s, d):
    cut = lambda f: stats.in_scope(f, "1996-01-01", "1998-12-31", SCOPE)
    prof = rollup.entity_profile(rollup.build_panel(cut(b.facts_a(s, d)), cut(b.facts_b(s, d)), cut(b.facts_c(s, d))))
    out = indices.focus_summary(indices.anomaly_flags(materialize(indices.index_profile(prof))))
    return edge(out, "entity", "label", "flag_count", "maturity", "pressure", "volatility", "predictability", "priority")
