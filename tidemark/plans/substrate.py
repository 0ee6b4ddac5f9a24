"""Monthly and daily series made from the relational tables.

All are long tables (series_id, ds, t, n, y): month end, place from 0, length of
the series, value.  The values are pre-aggregated sums; one more shuffle, by
series, numbers the months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def along():
    """Rows of a series in order."""
    return Window.partitionBy("series_id").orderBy("ds")


def whole():
    """All rows of a series."""
    return Window.partitionBy("series_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(observations: DataFrame) -> DataFrame:
    """Adds t and n to (series_id, ds, y)."""
    return observations.withColumn("t", F.row_number().over(along()) - 1).withColumn("n", F.count("*").over(whole())).select("series_id", "ds", "t", "n", "y")


def brand_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped by brand and month."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return numbered(j.groupBy(F.col("p_brand").alias("series_id"), F.last_day("l_shipdate").alias("ds")).agg(F.sum("l_quantity").alias("y")))


def line_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped by return flag, line status and line number, and month."""
    items = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return numbered(items.groupBy(name.alias("series_id"), F.last_day("l_shipdate").alias("ds")).agg(F.sum("l_quantity").alias("y")))


def priority_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and month."""
    orders = table(spark, sf_dir, "orders")
    return numbered(orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.last_day("o_orderdate").alias("ds")).agg(F.count("*").cast("double").alias("y")))


_NUMBERED = "SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n, y FROM {0}"

#: The same views as DuckDB common table expressions.
BRAND_SQL = f"""
bm0 AS (SELECT p_brand AS series_id, last_day(l_shipdate) AS ds, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bm AS ({_NUMBERED.format("bm0")})"""
LINE_SQL = f"""
lm0 AS (SELECT concat_ws('-', l_returnflag, l_linestatus, l_linenumber) AS series_id, last_day(l_shipdate) AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2),
lm AS ({_NUMBERED.format("lm0")})"""
PRIORITY_SQL = f"""
pm0 AS (SELECT o_orderpriority AS series_id, last_day(o_orderdate) AS ds, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2),
pm AS ({_NUMBERED.format("pm0")})"""
