"""Graphs derived from the driver's tables; a customer or part k is vertex 2k, a supplier k is 2k + 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph_etl import symmetrize
from ..session import materialize, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built once and written, as most queries read it several times."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return materialize(symmetrize(j.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))), "graph")


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``customer_supplier``."""
    li = table(spark, sf_dir, "lineitem")
    return materialize(symmetrize(li.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))), "graph")


GC = """gc0 AS (SELECT DISTINCT 2 * o_custkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT a AS src, b AS dst FROM gc0 UNION SELECT b, a FROM gc0)"""
GP = """gp0 AS (SELECT DISTINCT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem),
e AS (SELECT a AS src, b AS dst FROM gp0 UNION SELECT b, a FROM gp0)"""
