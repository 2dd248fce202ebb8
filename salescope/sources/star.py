"""The retail star schema (stores, products, transactions).

Two ways in:

* :func:`star_from_tpch` derives the star from the TPC-H-style driver tables
  (suppliers are stores, parts are products, line items are transactions).
  The mapping is fixed so that the SQL oracle can rebuild the same views.
* :func:`read_star` reads a star written by the ETL job
  (:mod:`salescope.operators.star_build`), where ``transactions`` is
  partitioned by ``sale_date`` so look-back filters prune whole folders.
"""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.sources.tables import table

REVENUE_TYPE = "decimal(17,4)"


class Parts(NamedTuple):
    """The fact rows before their look-up: ``lines`` have ``key``, by which
    ``attributes`` are looked up.  ``late`` columns are made of key and other
    columns of a line after the joins, so that fewer bytes are shuffled."""
    lines: DataFrame
    attributes: DataFrame
    key: str
    late: dict[str, tuple[Column, list[str]]]


class Star(NamedTuple):
    stores: DataFrame
    products: DataFrame
    transactions: DataFrame
    # Optional: the same fact rows without the attributes that need extra
    # joins (customer_type, payment_mode).  Queries that do not read those
    # columns use it and skip the joins.
    narrow: DataFrame | None = None
    # Optional: the rows of ``transactions`` as lines and looked-up attributes.
    parts: Parts | None = None


# Fact attributes that come from joined tables in the driver-table mapping.
JOINED_ATTRIBUTES = ("customer_type", "payment_mode")


def stores_view(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("store_id"),
        F.col("s_name").alias("store_location"),
        F.round(F.lit(2.5) + F.lit(2.5) * F.col("s_acctbal") / F.lit(10000.0), 2)
        .alias("store_rating"))


def products_view(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("subcategory"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("p_size").alias("stock_on_hand"))


def _fact_columns(extra: list) -> list:
    one = F.lit(1).cast("decimal(3,2)")
    return [
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.round(F.col("l_discount") * 100, 2).alias("discount_percentage"),
        (F.col("l_extendedprice").cast("decimal(12,2)")
         * (one - F.col("l_discount").cast("decimal(3,2)"))).alias("revenue"),
        *extra,
        (F.col("l_returnflag") == "R").alias("promotion_applied"),
        ((F.month("l_shipdate") == 12) & (F.dayofmonth("l_shipdate") >= 24))
        .alias("holiday_flag")]


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey",
                "l_discount", "l_extendedprice", "l_returnflag"]


def transactions_view(lineitem: DataFrame, orders: DataFrame,
                      customer: DataFrame) -> DataFrame:
    """One transaction per line item.

    Revenue stays an exact decimal so sums are order independent (the same
    total on every engine and every partitioning); it is cast to double only
    when a result leaves the library.  ``payment_mode`` and ``customer_type``
    are attributes looked up by primary key (left joins: a lookup never drops
    or repeats a fact).  Both are shuffle joins on their keys at scale; AQE
    turns them into broadcasts when a side is small.
    """
    li = lineitem.select(*LINE_COLUMNS)
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = customer.select("c_custkey", "c_mktsegment")
    j = (li.join(o, li.l_orderkey == o.o_orderkey, "left")
           .join(c, F.col("o_custkey") == c.c_custkey, "left"))
    return j.select(*_fact_columns([F.col("c_mktsegment").alias("customer_type"),
                                    F.col("o_orderpriority").alias("payment_mode")]))


def transactions_narrow(lineitem: DataFrame) -> DataFrame:
    """The same fact rows without the two looked-up attributes: no join."""
    return lineitem.select(*LINE_COLUMNS).select(*_fact_columns([]))


def transaction_parts(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> Parts:
    """The rows of :func:`transactions_view` before the look-up.  Customers are
    looked up per order, of which there are fewer than lines; a left join on
    the order's own column gives the same rows before the lines' join as after."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = customer.select("c_custkey", "c_mktsegment")
    attributes = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_orderkey").alias("order_key"), F.col("c_mktsegment").alias("customer_type"),
        F.col("o_orderpriority").alias("payment_mode"))
    _, *rest = _fact_columns([])        # transaction_id is made late
    lines = lineitem.select(*LINE_COLUMNS).select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), *rest)
    return Parts(lines, attributes, "order_key", {"transaction_id": (
        F.col("order_key") * 10 + F.col("line"), ["order_key", "line"])})


def star_from_tpch(spark: SparkSession, sf_dir: str) -> Star:
    li = table(spark, sf_dir, "lineitem")
    looked_up = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return Star(
        stores_view(table(spark, sf_dir, "supplier")),
        products_view(table(spark, sf_dir, "part")),
        transactions_view(li, *looked_up),
        transactions_narrow(li),
        transaction_parts(li, *looked_up))


def read_star(spark: SparkSession, path: str) -> Star:
    """Read a star written by :func:`salescope.sources.sinks.write_star`.

    The fact table keeps its ``sale_date`` partition column, so look-back
    filters prune whole partitions (see ``filters.lookback_predicate``)."""
    tx = spark.read.parquet(os.path.join(path, "transactions"))
    return Star(spark.read.parquet(os.path.join(path, "stores")),
                spark.read.parquet(os.path.join(path, "products")), tx)


# SQL text of the same views, used as CTEs by the DuckDB oracle.
STAR_CTES = """
stores AS (
  SELECT s_suppkey AS store_id, s_name AS store_location,
         round(2.5 + 2.5 * s_acctbal / 10000.0, 2) AS store_rating
  FROM supplier),
products AS (
  SELECT p_partkey AS product_id, p_type AS category, p_name AS subcategory,
         p_brand AS brand, p_retailprice AS unit_price, p_size AS stock_on_hand
  FROM part),
transactions AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id, l_shipdate AS ts,
         l_suppkey AS store_id, l_partkey AS product_id,
         round(l_discount * 100, 2) AS discount_percentage,
         cast(l_extendedprice AS decimal(12,2))
           * (cast(1 AS decimal(3,2)) - cast(l_discount AS decimal(3,2))) AS revenue,
         c_mktsegment AS customer_type, o_orderpriority AS payment_mode,
         l_returnflag = 'R' AS promotion_applied,
         (month(l_shipdate) = 12 AND day(l_shipdate) >= 24) AS holiday_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey)
"""
