"""The test tables as the library's data model: rows in groups and cells, sparse activations, and the items' dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.session import read_table

#: The same tables in DuckDB SQL, to put before a query.
SQL = """WITH rows_ AS (
  SELECT o_orderkey AS row_id, n_name AS city, CAST(c_custkey % 40 AS BIGINT) AS gx, c_custkey // 40 AS gy, o_totalprice AS price, o_orderdate AS day
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
acts AS (SELECT l_orderkey AS row_id, l_partkey AS item, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
dims AS (SELECT p_partkey AS item, p_type AS family, p_brand AS unit, p_name AS label FROM part)
"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    """row_id, city (group), gx, gy (cell), price, day."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("row_id"), F.col("n_name").alias("city"), (F.col("c_custkey") % 40).alias("gx"), F.expr("c_custkey div 40").alias("gy"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))


def acts(spark: SparkSession, d: str) -> DataFrame:
    """row_id, item, v: distinct (row, item)."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.groupBy(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("v"))


def dims(spark: SparkSession, d: str) -> DataFrame:
    """item, family, unit, label."""
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("family"), F.col("p_brand").alias("unit"), F.col("p_name").alias("label"))


def unit_presence(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (row_id, unit) with the unit's family of smallest name."""
    return acts(spark, d).join(dims(spark, d), "item").select("row_id", "unit").distinct()
