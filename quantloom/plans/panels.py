"""Panels out of the driver's tables, in Spark and as the same SQL.

Prices and factors are rounded to eight digits where a panel is built: averages that are equal in exact
arithmetic may sit a rounding error apart, and ranks would make that visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import PanelSpec

#: Added before a result is rounded to six digits: decimal inputs make exact ties, which engines round differently.
NUDGE = 1e-9
SPEC = PanelSpec(date="dt", symbol="symbol", price="price", factor="factor")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by month: unit price, mean discount (factor), mean tax and quantity (exposures)."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("dt"), F.col("l_suppkey").alias("symbol"))
    mean = lambda c: F.round(F.avg(c), 8)
    return rows.agg(mean(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), mean("l_discount").alias("factor"), mean("l_tax").alias("tax"), mean("l_quantity").alias("qty"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day: mean value (price) and number of events (factor)."""
    rows = _table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("dt"), F.col("user_id").alias("symbol"))
    return rows.agg(F.round(F.avg("value"), 8).alias("price"), F.count(F.lit(1)).cast("double").alias("factor"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, industry): the nation of each supplier."""
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"))


MONTHLY_SQL = """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, l_suppkey AS symbol, round(avg(l_extendedprice / l_quantity), 8) AS price,
  round(avg(l_discount), 8) AS factor, round(avg(l_tax), 8) AS tax, round(avg(l_quantity), 8) AS qty FROM lineitem GROUP BY 1, 2"""
DAILY_SQL = """SELECT CAST(ts AS DATE) AS dt, user_id AS symbol, round(avg(value), 8) AS price, CAST(count(*) AS DOUBLE) AS factor FROM events GROUP BY 1, 2"""
