"""Tables of a folder, and variants with missing values, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The given tables have no nulls, so missing values are put in by key.
HOLED_ORDERS = """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
           o_orderdate,
           CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE '' END AS o_orderpriority
    FROM {orders}
"""
HOLED_LINES = """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity,
           CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice,
           l_discount,
           CASE WHEN l_suppkey % 9 <> 0 THEN l_tax END AS l_tax
    FROM {lineitem}
"""


def from_sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Run a statement whose ``{table}`` marks stand for tables of the folder."""
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **used)


def holed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, HOLED_ORDERS)


def holed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, HOLED_LINES)


def plain(statement: str) -> str:
    """The statement over views named like the tables."""
    for t in TABLES:
        statement = statement.replace("{" + t + "}", t)
    return statement


def with_holed(body: str) -> str:
    """A statement over ``ho`` (orders with gaps) and ``hl`` (lineitem with gaps)."""
    return f"WITH ho AS ({plain(HOLED_ORDERS)}), hl AS ({plain(HOLED_LINES)}) {body}"


def stacked(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)
