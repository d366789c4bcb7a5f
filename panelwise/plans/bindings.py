"""Bind a star schema (orders, line items, customers, suppliers, nations) to the panel.

Activity a counts orders by priority, b sums shipped quantity of the supplier's
nation by line status, c sums returned/accepted quantity of the customer's nation.
Only the needed columns and rows leave the scans. The dimension joins carry no
broadcast hints: Spark broadcasts a side whose measured size is below its threshold
and otherwise sorts and merges, where adaptive execution splits skewed keys. The
rollup that follows combines on the map side right after the last join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.rollup import build_panel, entity_profile
from panelwise.operators.indices import index_profile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _nation(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("entity"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_ck"), F.col("c_nationkey").alias("_nk"))


def _one(cond):
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long")


def _qty(cond):
    return F.when(cond, F.col("l_quantity").cast("long")).otherwise(F.lit(0).cast("long"))


def facts_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("_ck"),
        F.col("o_orderdate").cast("date").alias("date"),
        _one(F.col("o_orderpriority") == "1-URGENT").alias("a_1"),
        _one(F.col("o_orderpriority") == "2-HIGH").alias("a_2"),
        _one(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("a_3"),
    )
    return o.join(_customers(spark, sf_dir), "_ck").join(_nation(spark, sf_dir), "_nk").select("entity", "date", "a_1", "a_2", "a_3")


def facts_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("_sk"),
        F.col("l_shipdate").cast("date").alias("date"),
        _qty(F.col("l_linestatus") == "F").alias("b_1"),
        _qty(F.col("l_linestatus") == "O").alias("b_2"),
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_sk"), F.col("s_nationkey").alias("_nk"))
    return li.join(s, "_sk").join(_nation(spark, sf_dir), "_nk").select("entity", "date", "b_1", "b_2")


def facts_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    # orders meet customers first, so the rollup follows the line-item join directly
    geo = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("_ok"), F.col("o_custkey").alias("_ck"))
        .join(_customers(spark, sf_dir), "_ck")
        .join(_nation(spark, sf_dir), "_nk")
        .select("_ok", "entity")
    )
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A")).select(
        F.col("l_orderkey").alias("_ok"),
        F.col("l_shipdate").cast("date").alias("date"),
        _qty(F.col("l_returnflag") == "R").alias("c_1"),
        _qty(F.col("l_returnflag") == "A").alias("c_2"),
    )
    return li.join(geo, "_ok").select("entity", "date", "c_1", "c_2")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(facts_a(spark, sf_dir), facts_b(spark, sf_dir), facts_c(spark, sf_dir))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_profile(panel(spark, sf_dir))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_profile(profile(spark, sf_dir))


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide entity set: order counts and values per customer."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )


def event_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel of the event stream: event type x day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("entity"), F.col("ts").cast("date").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    )
