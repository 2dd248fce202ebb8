"""Raw sales input: the CSV file the ETL job reads, and a dirty test view.

The CSV is read with every column as text, pandas-style missing-value tokens
become nulls, and values are then cast to a declared superset schema with
``try_cast`` (a bad number is a null, not a failed job).  ``_row`` keeps the
order of the records, which "first row wins" rules depend on: by file (path),
start of the file's block, and place in the block.  Spark packs blocks of
several files into tasks by size, so task order alone is not file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.sources.tables import table

# Declared raw columns and their types (any may be absent).
RAW_COLUMNS = {
    "Date": "string", "Timestamp": "string", "Revenue": "double", "Unit_Price": "double",
    "Store_Location": "string", "Store_Rating": "double", "Product_Category": "string",
    "Product_Subcategory": "string", "Brand": "string", "Stock_On_Hand": "int",
    "Discount_Percentage": "double", "Customer_Type": "string", "Payment_Mode": "string",
    "Promotion_Applied": "string", "Holiday_Flag": "string",
}

# Text read as missing (the pandas CSV reader's defaults).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")


def read_sales_csv(spark: SparkSession, path: str | list[str],
                   multi_line: bool = False) -> DataFrame:
    """Scan raw sales CSV files (header row) into typed columns plus ``_row``,
    a struct that sorts as the records do.  With ``multi_line`` a quoted value
    may hold line breaks; files are then read whole, one task each."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("mode", "PERMISSIVE").option("multiLine", multi_line).option("escape", '"')
           .csv(path))
    raw = raw.withColumn("_row", F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place")))
    cols = []
    for c in raw.columns:
        if c == "_row":
            continue
        v = F.when(F.col(c).isin(*NA_TOKENS), None).otherwise(F.col(c))
        t = RAW_COLUMNS.get(c, "string")
        cols.append((v if t == "string" else v.try_cast(t)).alias(c))
    return raw.select("_row", *cols)


def dirty_sales(spark: SparkSession, sf_dir: str, copies: bool = True) -> DataFrame:
    """A raw-sales-shaped view of the driver tables with nulls, bad case,
    padding, negatives and exact duplicates at fixed rates; ``_row`` is the
    order key (the order number)."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier")
    p = table(spark, sf_dir, "part")
    j = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    k = F.col("l_orderkey")
    rating = F.round(F.lit(2.5) + F.lit(2.5) * F.col("s_acctbal") / F.lit(10000.0), 2)
    once = j.select(
        k.alias("_row"),
        F.when(k % 97 == 0, None).otherwise(F.col("l_shipdate").cast("date").cast("string"))
         .alias("Date"),
        F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("  "), F.lower("s_name"), F.lit(" ")))
         .otherwise(F.col("s_name")).alias("Store_Location"),
        F.when(k % 53 == 0, None).otherwise(rating).alias("Store_Rating"),
        F.when(F.col("l_partkey") % 41 == 0, F.lit("none"))
         .when(F.col("l_partkey") % 43 == 0, None).otherwise(F.lower("p_type"))
         .alias("Product_Category"),
        F.col("p_name").alias("Product_Subcategory"), F.col("p_brand").alias("Brand"),
        F.col("p_size").alias("Stock_On_Hand"),
        F.when(k % 89 == 0, -F.col("p_retailprice")).otherwise(F.col("p_retailprice"))
         .alias("Unit_Price"),
        F.when(k % 59 == 0, None).otherwise(F.round(F.col("l_discount") * 100, 2))
         .alias("Discount_Percentage"),
        F.when(k % 101 == 0, None).when(k % 103 == 0, -F.col("l_extendedprice"))
         .otherwise(F.col("l_extendedprice")).alias("Revenue"),
        F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("Promotion_Applied"))
    if not copies:
        return once
    # Same rows as once ∪ once[_row % 200 = 0], from one pass over the join:
    # the flagged rows are emitted twice.
    n = F.when(F.col("_row") % 200 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return once.withColumn("_copy", F.explode(n)).drop("_copy")


def broken_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty_sales`` with rows that break the rules of the load as well:
    unparsable dates, ratings above 5, free products, discounts above 100."""
    k = F.col("_row")
    return dirty_sales(spark, sf_dir).withColumns({
        "Date": F.when(k % 61 == 0, "not a date").otherwise(F.col("Date")),
        "Store_Rating": F.when(F.col("Store_Location").contains("7"), F.col("Store_Rating") * 3)
                         .otherwise(F.col("Store_Rating")),
        "Unit_Price": F.when(k % 67 == 0, 0.0).otherwise(F.col("Unit_Price")),
        "Discount_Percentage": F.when(k % 71 == 0, 150.0).otherwise(F.col("Discount_Percentage"))})


BROKEN_COLUMNS = """
SELECT * REPLACE (
  CASE WHEN _row % 61 = 0 THEN 'not a date' ELSE "Date" END AS "Date",
  CASE WHEN contains("Store_Location", '7') THEN "Store_Rating" * 3 ELSE "Store_Rating" END
    AS "Store_Rating",
  CASE WHEN _row % 67 = 0 THEN 0.0 ELSE "Unit_Price" END AS "Unit_Price",
  CASE WHEN _row % 71 = 0 THEN 150.0 ELSE "Discount_Percentage" END AS "Discount_Percentage")
"""

DIRTY_SQL = """
dirty_once AS (
  SELECT l_orderkey AS _row,
    CASE WHEN l_orderkey % 97 = 0 THEN NULL
         ELSE cast(cast(l_shipdate AS date) AS varchar) END AS "Date",
    CASE WHEN l_linenumber % 5 = 0 THEN concat('  ', lower(s_name), ' ') ELSE s_name END AS "Store_Location",
    CASE WHEN l_orderkey % 53 = 0 THEN NULL
         ELSE round(2.5 + 2.5 * s_acctbal / 10000.0, 2) END AS "Store_Rating",
    CASE WHEN l_partkey % 41 = 0 THEN 'none' WHEN l_partkey % 43 = 0 THEN NULL
         ELSE lower(p_type) END AS "Product_Category",
    p_name AS "Product_Subcategory", p_brand AS "Brand", p_size AS "Stock_On_Hand",
    CASE WHEN l_orderkey % 89 = 0 THEN -p_retailprice ELSE p_retailprice END AS "Unit_Price",
    CASE WHEN l_orderkey % 59 = 0 THEN NULL ELSE round(l_discount * 100, 2) END AS "Discount_Percentage",
    CASE WHEN l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 103 = 0 THEN -l_extendedprice
         ELSE l_extendedprice END AS "Revenue",
    CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS "Promotion_Applied"
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
dirty AS (SELECT * FROM dirty_once UNION ALL SELECT * FROM dirty_once WHERE _row % 200 = 0)
"""
