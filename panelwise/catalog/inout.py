"""Queries for sources, sinks, streams and whole jobs.

They write what they read from the given tables below the shared folder and read it
back through the source or stream under test.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.catalog.registry import edge, query
from panelwise.catalog.relational import DIRTY_T, ENTROPY_BINS, ROBUST_COLS, ROBUST_MAD, ROBUST_MED
from panelwise.catalog.quality import PSI2
from panelwise.catalog.sql import build, r, rs, ym
from panelwise.operators import drift, indices, rollup, stats
from panelwise.operators.ordered import with_row
from panelwise.plans import bindings as b
from panelwise.plans import jobs
from panelwise.session import materialize, scratch_path
from panelwise.sources import readers, sinks
from panelwise.streaming import jobs as streams

# ---- raw feeds derived from the tables ------------------------------------------------------

BANDS_A = ["a_1", "a_2", "a_3"]


def raw_orders(s, d) -> DataFrame:
    """Orders as raw text rows: day-first dates, untidy names, repeats, some bad counts."""
    o = b.table(s, d, "orders").join(b.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(b.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("o_orderkey") % 17 == 0, F.lit("100000")).when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).otherwise(F.col("n_name"))
    return o.select(
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("date"),
        name.alias("entity"),
        F.col("c_mktsegment").alias("area"),
        F.col("c_custkey").cast("string").alias("site"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1)).otherwise(F.lit(0)).cast("long").alias("a_1"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit(1)).otherwise(F.lit(0)).cast("long").alias("a_2"),
        F.when(F.col("o_orderkey") % 19 == 0, F.lit(-1)).otherwise(F.lit(1)).cast("long").alias("a_3"),
    )


RAW = """SELECT strftime(o_orderdate,'%Y-%m-%d') AS date, CASE WHEN o_orderkey%17=0 THEN '100000' WHEN o_orderkey%3=0 THEN '  '||lower(n_name)||' ' ELSE n_name END AS name,
 c_mktsegment AS area, c_custkey::VARCHAR AS site, (o_orderpriority='1-URGENT')::BIGINT AS a_1, (o_orderpriority='2-HIGH')::BIGINT AS a_2, CASE WHEN o_orderkey%19=0 THEN -1 ELSE 1 END::BIGINT AS a_3
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey"""
AREA_T = DIRTY_T.replace("name", "area")
CLEANED = f"SELECT date, {DIRTY_T} AS entity, {AREA_T} AS area, site, a_1, a_2, a_3 FROM raw WHERE a_3>=0 AND name<>'100000'"


def _csv(s, d):
    path = scratch_path(s, "raw-csv")
    raw_orders(s, d).write.option("header", True).csv(f"{path}/part/one")
    return path


@query("s1_csv_scan", build("", "SELECT count(*)::BIGINT AS rows, count(DISTINCT site)::BIGINT AS sites, sum(a_1)::BIGINT AS a_1, sum(a_3)::BIGINT AS a_3, 0::BIGINT AS broken FROM raw", raw=RAW))
def _(s, d):
    df = readers.read_csv_feed(s, _csv(s, d), readers.feed_schema(BANDS_A))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("site").alias("sites"), F.sum("a_1").alias("a_1"), F.sum("a_3").alias("a_3"), F.count(readers.BAD_RECORD).alias("broken"))


def _zips(batches):
    for pdf in batches:
        for area, part in pdf.groupby("area"):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{area}/data.csv", part.to_csv(index=False))
            yield pd.DataFrame({"path": [f"{area}.zip"], "content": [buf.getvalue()]})


@query("s2_zip_ingest", build("", "SELECT area, count(*)::BIGINT AS rows, sum(a_1)::BIGINT AS a_1, sum(a_2)::BIGINT AS a_2 FROM raw GROUP BY 1", raw=RAW))
def _(s, d):
    archives = raw_orders(s, d).mapInPandas(_zips, "path string, content binary")
    rows = readers.expand_archives(archives, readers.feed_schema(BANDS_A))
    return rows.groupBy("area").agg(F.count(F.lit(1)).alias("rows"), F.sum("a_1").alias("a_1"), F.sum("a_2").alias("a_2"))


@query(
    "s3_input_audit",
    "SELECT 'orders' AS feed, 1::BIGINT AS files, false AS missing, (SELECT count(*) FROM orders)::BIGINT AS rows UNION ALL SELECT 'refunds', 0, true, 0"
    " UNION ALL SELECT 'dimensions', 2, false, (SELECT count(*) FROM customer)+(SELECT count(*) FROM supplier)",
)
def _(s, d):
    audit = readers.audit_inputs(s, d, {"orders": ["orders*.parquet"], "refunds": ["refund*.zip", "refund*.csv"], "dimensions": ["customer.parquet", "supplier*.parquet"]})
    feeds = [("orders", "orders"), ("dimensions", "customer"), ("dimensions", "supplier")]
    rows = stats.union_all([b.table(s, d, t).groupBy(F.lit(f).alias("feed")).agg(F.count(F.lit(1)).alias("rows")) for f, t in feeds])
    rows = rows.groupBy("feed").agg(F.sum("rows").alias("rows"))
    return audit.join(rows, "feed", "left").fillna({"rows": 0})


@query("s4_first_candidate", "SELECT c_custkey, c_mktsegment FROM customer")
def _(s, d):
    return readers.read_first(s, [f"{d}/customer_cleaned.csv", f"{d}/customer.parquet", f"{d}/region.parquet"]).select("c_custkey", "c_mktsegment")


@query("s5_output_sink", build("panel", f"SELECT entity, {ym()} AS period, a_total, b_total, c_total FROM panel"))
def _(s, d):
    paths = sinks.write_outputs({"panel": b.panel(s, d).select("entity", "period", "a_total", "b_total", "c_total")}, scratch_path(s, "outputs"))
    return edge(s.read.parquet(paths["panel"]).select("entity", "period", "a_total", "b_total", "c_total"))


@query("s6_artefact_latest", f"SELECT event_type AS name, 2::BIGINT AS version, {r('avg(value)*2')} AS mean FROM events GROUP BY 1")
def _(s, d):
    one = b.table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("m"))
    path = scratch_path(s, "artefacts")
    for version in (1, 2):
        out = one.select("name", F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("saved_at"), F.create_map(F.lit("mean"), F.col("m") * version).alias("params"))
        out.write.mode("append").parquet(path)
    return edge(sinks.latest_artefacts(s.read.parquet(path)).select("name", "version", F.col("params")["mean"].alias("mean")))


@query("s7_export_preview", build("profile", "SELECT entity, a_total, b_total FROM profile ORDER BY entity LIMIT 50"))
def _(s, d):
    path = scratch_path(s, "preview")
    sinks.preview(b.profile(s, d).select("entity", "a_total", "b_total"), [F.asc("entity")], 50).write.option("header", True).csv(path)
    return s.read.schema("entity string, a_total long, b_total long").option("header", True).csv(path)


# ---- streams -----------------------------------------------------------------------------------


@query("x1_stream_clean", build("", "SELECT date, entity, area, site, a_1, a_2, a_3 FROM cleaned", raw=RAW, cleaned=CLEANED))
def _(s, d):
    out, ck = scratch_path(s, "clean-out"), scratch_path(s, "clean-ck")
    stream = streams.csv_stream(s, _csv(s, d), readers.feed_schema(BANDS_A))
    streams.run_to_table(streams.clean_stream(stream, BANDS_A), out, ck)
    return edge(s.read.parquet(out).select("date", "entity", "area", "site", *BANDS_A))


def _events(s, d):
    return b.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


EV_SCHEMA = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("cents", T.LongType())]
)


def _event_folder(s, d, copies=1):
    path = scratch_path(s, "events")
    for _ in range(copies):
        _events(s, d).write.mode("append").parquet(path)
    return path


@query("x2_stream_dedupe", "SELECT event_id, event_type, round(value*100)::BIGINT AS cents FROM events")
def _(s, d):
    out, ck = scratch_path(s, "dedupe-out"), scratch_path(s, "dedupe-ck")
    stream = streams.parquet_stream(s, _event_folder(s, d, copies=2), EV_SCHEMA)
    streams.run_to_table(streams.dedupe_stream(stream, ["event_id"]), out, ck)
    return s.read.parquet(out).select("event_id", "event_type", "cents")


X3 = """SELECT strftime(date_trunc('day',ts),'%Y-%m-%d') AS day, event_type, sum(round(value*100)::BIGINT)::BIGINT AS cents, count(*)::BIGINT AS rows FROM events GROUP BY 1,2"""


@query("x3_stream_rollup", X3)
def _(s, d):
    # the closing row, fed after all events, ends the last day
    path, out, ck = scratch_path(s, "events"), scratch_path(s, "rollup-out"), scratch_path(s, "rollup-ck")
    for rows in (_events(s, d), streams.closing_row(s, EV_SCHEMA)):
        rows.write.mode("append").parquet(path)
        streams.run_to_table(streams.rollup_stream(streams.parquet_stream(s, path, EV_SCHEMA), ["event_type"], ["cents"]), out, ck)
    return s.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "cents", "rows")


X4 = """SELECT strftime(date_trunc('day',ts),'%Y-%m-%d') AS day, event_type, event_id%10=0 AND date_trunc('day',ts)+INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_id%10<>0)-INTERVAL 1 HOUR AS late,
 sum(round(value*100)::BIGINT)::BIGINT AS cents, count(*)::BIGINT AS rows FROM events GROUP BY 1,2,3"""


@query("x4_stream_late_rows", X4)
def _(s, d):
    # a first run takes nine tenths; most of the rest arrives when its windows are closed
    path, out, ck = scratch_path(s, "late"), scratch_path(s, "late-out"), scratch_path(s, "late-ck")
    ev = _events(s, d)
    tenth = F.col("event_id") % 10 == 0
    for rows in (ev.where(~tenth), ev.where(tenth)):
        rows.write.mode("append").parquet(path)
        streams.run_windows(streams.parquet_stream(s, path, EV_SCHEMA), out, ck, ["event_type"], ["cents"])
    day = lambda time: F.date_format(time, "yyyy-MM-dd").alias("day")
    written = streams.window_sums(s, out, ["event_type"], ["cents"]).select(day("window_start"), "event_type", F.lit(False).alias("late"), "cents", "rows")
    late = streams.late_rows(s, out).groupBy(day("ts"), "event_type").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("rows"))
    return written.unionByName(late.withColumn("late", F.lit(True)))


X5_POOL = "SELECT 'balance' AS feature, s_acctbal::DOUBLE AS v, 0 AS side FROM supplier UNION ALL SELECT 'balance', c_acctbal::DOUBLE, 1 FROM customer"


@query(
    "x5_stream_drift",
    build("", "SELECT *, CASE WHEN psi<0.1 THEN 'stable' WHEN psi<0.25 THEN 'warning' ELSE 'critical' END AS severity, (SELECT count(*) FROM customer)::BIGINT AS n_cur FROM (" + PSI2 + ")", pool=X5_POOL),
)
def _(s, d):
    # suppliers are the baseline, customers arrive in four files, a batch each
    path, out, ck = scratch_path(s, "balances"), scratch_path(s, "drift-state"), scratch_path(s, "drift-ck")
    current = b.table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"))
    current.repartition(4, "c_custkey").select("balance").write.parquet(path)
    bins = materialize(drift.baseline_bins(b.table(s, d, "supplier").select(F.col("s_acctbal").alias("balance")), ["balance"]))
    stream = streams.parquet_stream(s, path, T.StructType([T.StructField("balance", T.DoubleType())]), files_per_trigger=1)
    streams.run_total_drift(stream, bins, ["balance"], out, ck)
    last = s.read.parquet(f"{out}/history")
    return edge(last.where(F.col("n_cur") == last.agg(F.max("n_cur")).scalar()).select("feature", "psi", "severity", "n_cur").distinct())


# ---- jobs -----------------------------------------------------------------------------------------


@query("r1_clean_job", build("", "SELECT DISTINCT date, entity, area, site, a_1, a_2, a_3 FROM cleaned", raw=RAW, cleaned=CLEANED))
def _(s, d):
    return edge(jobs.clean_job({"a": raw_orders(s, d)})["a"].select("date", "entity", "area", "site", *BANDS_A))


@query("r2_core_job", build("focus", f"SELECT entity, label, status, flag_count, {rs('maturity', 'pressure', 'volatility', 'predictability', 'priority')} FROM focus"))
def _(s, d):
    out = jobs.core_job(b.facts_a(s, d), b.facts_b(s, d), b.facts_c(s, d))["focus_summary"]
    return edge(out, "entity", "label", "status", "flag_count", "maturity", "pressure", "volatility", "predictability", "priority")


@query(
    "r2_core_outputs",
    build(
        "fa fb fc panel idx",
        """SELECT unnest(['a_ready', 'b_ready', 'c_ready', 'panel', 'stability', 'lag_features', 'rank_persistence', 'rank_correlations', 'profile', 'anomalies', 'focus_summary', 'period_summary', 'pareto']) AS output,
 unnest([(SELECT count(*) FROM fa), (SELECT count(*) FROM fb), (SELECT count(*) FROM fc), np, ne, ne, ne, 2, ne, ne, ne, (SELECT count(DISTINCT period) FROM panel), ne]) AS n,
 unnest([(SELECT sum(a_1+a_2+a_3) FROM fa), (SELECT sum(b_1+b_2) FROM fb), (SELECT sum(c_1+c_2) FROM fc), (SELECT sum(activity) FROM panel), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL])::BIGINT AS total
 FROM (SELECT (SELECT count(*) FROM panel) AS np, (SELECT count(*) FROM idx) AS ne)""",
    ),
)
def _(s, d):
    """Rows of every output, and the sum of its counts where it holds them."""
    out = jobs.core_job(b.facts_a(s, d), b.facts_b(s, d), b.facts_c(s, d))
    sums = {"a_ready": "a_total", "b_ready": "b_total", "c_ready": "c_total", "panel": "activity"}
    skip = ("activity_correlation", "index_correlation")  # matrices, compared by a5_corr_matrix and a5_index_corr_matrix
    parts = [
        df.agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("n"), (F.sum(sums[n]) if n in sums else F.lit(None)).cast("bigint").alias("total"))
        for n, df in out.items() if n not in skip
    ]
    return stats.union_all(parts)


@query("r3_advanced_job")
def _(s, d):
    core = jobs.core_job(b.facts_a(s, d), b.facts_b(s, d), b.facts_c(s, d))
    done, failed = jobs.advanced_job(core)
    rows = [o.agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("rows")) for n, o in sorted(done.items())]
    return stats.union_all(rows + ([s.createDataFrame([(f"failed:{k}", 0) for k in failed], "output string, rows long")] if failed else []))


@query("r4_causal_job")
def _(s, d):
    out = jobs.causal_job(materialize(b.panel(s, d)))
    g = out["granger"].groupBy("entity").agg(F.count_if("significant").alias("links"))
    return out["cusum"].select("entity", "break_detected").join(g, "entity", "left")


@query(
    "r6_robust_job",
    build(
        "raws",
        f"SELECT entity, {ROBUST_COLS}, {r('coalesce(e,0)')} AS robust_predictability FROM raws, rmad JOIN ent ON ent.k=raws.entity",
        rmed=ROBUST_MED,
        rmad=ROBUST_MAD,
        bins=ENTROPY_BINS,
        ent="SELECT entity AS k, CASE WHEN n>=3 THEN 1+sum(c/n::DOUBLE*log2(c/n::DOUBLE))/(CASE WHEN nb>1 THEN log2(nb) ELSE 1 END) END AS e FROM bins GROUP BY entity, n, nb",
    ),
)
def _(s, d):
    p = materialize(b.panel(s, d))
    out = jobs.robust_job(indices.raw_indices(materialize(rollup.entity_profile(p))), p)["robust"]
    return edge(out, "entity", "robust_maturity", "robust_pressure", "robust_volatility", "robust_predictability")


@query(
    "r7_validate_job",
    build(
        "fb idx",
        "SELECT dataset, check_name, n=0 AS success, 'violations='||n AS details FROM (SELECT 'b' AS dataset, unnest(['entity_not_null','date_not_null','date_in_range','b_1_non_negative','b_2_non_negative','unique_key']) AS check_name, unnest([0, 0, (SELECT count(*) FROM fb WHERE date<DATE '2010-01-01'), 0, 0, (SELECT count(*) FROM fb)-(SELECT count(*) FROM (SELECT DISTINCT entity, date FROM fb))]) AS n"
        " UNION ALL SELECT 'profile', unnest(['entity_not_null','entity_unique','maturity_in_range','pressure_in_range','volatility_in_range','predictability_in_range','maturity_not_null','pressure_not_null','volatility_not_null','predictability_not_null']), 0)",
    ),
)
def _(s, d):
    return jobs.validate_job({"b": b.facts_b(s, d)}, b.indexed(s, d))


R8_OUTPUTS = "unnest(['weights', 'effects', 'fit', 'average_effect', 'placebo_effects', 'placebo']) AS output"


@query("r8_counterfactual_job")
def _(s, d):
    out = jobs.counterfactual_job(b.panel(s, d), "NATION_3", "activity", "1999-01-01", ["NATION_8"])
    return edge(with_row(out["average_effect"].withColumnRenamed("n_periods", "n_post").join(out["fit"], "treated"), out["placebo"].withColumnRenamed("significant", "placebo_significant").withColumnRenamed("p_value", "placebo_p")))


@query(
    "r8_counterfactual_outputs",
    build(
        "panel",
        f"""SELECT output, n, true AS sound FROM (SELECT {R8_OUTPUTS}, unnest([NULL, (SELECT count(*) FROM panel WHERE entity='NATION_3'), 1, 1,
 (SELECT count(DISTINCT entity) FROM panel WHERE entity<>'NATION_8'), 1]) AS n)""",
    ),
)
def _(s, d):
    """Rows of every output (weights: as many as the fit keeps) and whether each is sound in itself."""
    from functools import reduce

    out = jobs.counterfactual_job(b.panel(s, d), "NATION_3", "activity", "1999-01-01", ["NATION_8"])
    sound = {
        "weights": (F.abs(F.sum("weight") - 1) < 1e-9) & (F.min("weight") > 0) & (F.count_if(F.col("donor").isin("NATION_3", "NATION_8")) == 0),
        "effects": F.count_if(F.abs(F.col("actual") - F.col("synthetic") - F.col("effect")) > 1e-6) == 0,
        "fit": F.min("converged") & (F.min("pre_rmse") >= 0),
        "average_effect": (F.min("p_value") >= 0) & (F.max("p_value") <= 1),
        "placebo_effects": F.min("converged") & (F.count_if("real") == 1),
        "placebo": (F.min("p_value") >= 0) & (F.max("p_value") <= 1) & (F.min("n_without") == 0),
    }
    rows = F.count(F.lit(1))
    parts = [out[k].agg(F.lit(k).alias("output"), (F.lit(None) if k == "weights" else rows).cast("bigint").alias("n"), test.alias("sound")) for k, test in sound.items()]
    return reduce(lambda a, c: a.unionByName(c), parts)
