"""Declared schemas of the star tables and their registration as tables."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import types as T

STORES = T.StructType([
    T.StructField("store_id", T.LongType(), False),
    T.StructField("store_location", T.StringType(), False),
    T.StructField("store_rating", T.DoubleType(), True),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("subcategory", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("unit_price", T.DoubleType(), False),
    T.StructField("stock_on_hand", T.IntegerType(), True),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("store_id", T.LongType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("discount_percentage", T.DoubleType(), True),
    T.StructField("revenue", T.DecimalType(17, 4), False),
    T.StructField("customer_type", T.StringType(), True),
    T.StructField("payment_mode", T.StringType(), True),
    T.StructField("promotion_applied", T.BooleanType(), True),
    T.StructField("holiday_flag", T.BooleanType(), True),
    T.StructField("sale_date", T.DateType(), True),
])

TABLES = {"stores": STORES, "products": PRODUCTS, "transactions": TRANSACTIONS}


def create_star_tables(spark: SparkSession, path: str, database: str | None = None) -> list[str]:
    """Register the three tables of a star written by ``write_star`` as
    external Parquet tables with the declared schemas (facts partitioned by
    ``sale_date``); returns the qualified names."""
    names = []
    for name, schema in TABLES.items():
        full = f"{database}.{name}" if database else name
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        part = " PARTITIONED BY (sale_date)" if name == "transactions" else ""
        spark.sql(f"DROP TABLE IF EXISTS {full}")
        spark.sql(f"CREATE TABLE {full} ({cols}) USING parquet{part} "
                  f"LOCATION '{os.path.join(path, name)}'")
        if part:
            spark.sql(f"MSCK REPAIR TABLE {full}")
        names.append(full)
    return names
