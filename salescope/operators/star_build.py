"""Star build (the second half of the ETL job): dimensions with surrogate
keys, key lookups, fact projection, rejects and row validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from salescope.functions.flags import parse_flag
from salescope.session import checkpoint_dir
from salescope.session import materialize as write_staging
from salescope.sources.star import REVENUE_TYPE, Star

ORDER = "_row"
# Stand-ins when the raw file lacks a column.
DEFAULT_LOCATION = "Default_Location"
DEFAULT_CATEGORY = "Default"
DEFAULT_PRICE = 10.0
UNKNOWN = "Unknown"
PRODUCT_COLS = ["Product_Category", "Unit_Price", "Product_Subcategory", "Brand",
                "Stock_On_Hand"]
PRODUCT_KEY = ["Product_Category", "Product_Subcategory", "Brand", "Unit_Price"]


def dense_index(df: DataFrame, order: list[str], name: str,
                partitions: int | None = None) -> DataFrame:
    """1-based consecutive ids following ``order`` (which must be unique),
    without a single-partition window.

    Rows are range-partitioned and sorted on ``order``; each partition
    numbers its own rows and adds the number of rows in all earlier
    partitions.  Only the per-partition counts (one row per partition) are
    ranked together.  The tagged rows are checkpointed so both uses see the
    same partitioning even after an executor loss.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_p", F.spark_partition_id())
                .withColumn("_m", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # One row per partition: a proven bound, so broadcast.
    return (tagged.join(F.broadcast(offsets), "_p")
                  .withColumn(name, F.col("_off") + local + 1)
                  .drop("_p", "_m", "_off"))


def with_defaults(clean: DataFrame) -> DataFrame:
    """Stand-in columns for a raw file without store or product columns."""
    df = clean
    if "Store_Location" not in df.columns:
        df = df.withColumn("Store_Location", F.lit(DEFAULT_LOCATION))
    if "Product_Category" not in df.columns or "Unit_Price" not in df.columns:
        df = df.withColumn("Product_Category", F.lit(DEFAULT_CATEGORY)) \
               .withColumn("Unit_Price", F.lit(DEFAULT_PRICE))
    for c in ("Product_Subcategory", "Brand"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if "Stock_On_Hand" not in df.columns:
        df = df.withColumn("Stock_On_Hand", F.lit(0))
    return df


def build_stores(clean: DataFrame) -> DataFrame:
    """One store per location; the rating of the first row wins.  Ids follow
    first appearance."""
    df = with_defaults(clean)
    rating = (F.min_by(F.col("Store_Rating"), F.col(ORDER)) if "Store_Rating" in df.columns
              else F.lit(0.0))
    s = df.groupBy("Store_Location").agg(F.min(ORDER).alias("_first"),
                                         rating.cast("double").alias("store_rating"))
    s = dense_index(s, ["_first", "Store_Location"], "store_id")
    # Staged: of known size, so the facts' lookup can broadcast a small one.
    return write_staging(s.select("store_id", F.col("Store_Location").alias("store_location"),
                                  "store_rating"), "stores")


def build_products(clean: DataFrame) -> DataFrame:
    """One product per distinct (category, price, subcategory, brand, stock);
    ids follow first appearance."""
    df = with_defaults(clean)
    p = df.groupBy(*PRODUCT_COLS).agg(F.min(ORDER).alias("_first"))
    p = dense_index(p, ["_first"] + PRODUCT_COLS, "product_id")
    return write_staging(p.select(
        "product_id", F.col("Product_Category").alias("category"),
        F.col("Product_Subcategory").alias("subcategory"), F.col("Brand").alias("brand"),
        F.col("Unit_Price").cast("double").alias("unit_price"),
        F.coalesce(F.col("Stock_On_Hand").cast("int"), F.lit(0)).alias("stock_on_hand")), "products")


def product_lookup(products: DataFrame) -> DataFrame:
    """(category, subcategory, brand, price) → id.  Stock is not part of the
    key, so among variants differing only in stock the later id wins."""
    return products.groupBy(
        F.col("category").alias("_k_category"), F.col("subcategory").alias("_k_subcategory"),
        F.col("brand").alias("_k_brand"), F.col("unit_price").alias("_k_unit_price")).agg(
        F.max("product_id").alias("product_id"))


def parse_ts(df: DataFrame) -> Column:
    """Date, else Timestamp, else the load time, as a wall-clock timestamp
    (timestamp_ntz: the same type as the star's ``ts`` and independent of the
    session time zone)."""
    cands = [F.try_to_timestamp(F.col(c)).cast("timestamp_ntz")
             for c in ("Date", "Timestamp") if c in df.columns]
    return F.coalesce(*cands) if cands else F.localtimestamp()


@dataclass
class LoadResult:
    """``counts`` holds what was counted while the facts were staged: rows in
    ``transactions`` and ``rejected``, and failures by rule."""
    star: Star
    rejected: DataFrame
    counts: dict[str, int]


def build_facts(clean: DataFrame, stores: DataFrame, products: DataFrame) -> LoadResult:
    """Transactions with resolved keys; rows whose timestamp does not parse or
    whose store / product does not resolve go to ``rejected`` with a reason.

    Both are staged in one write (a folder each), so the lookups run once and
    ids stay as they were given; rows, rejects and broken rules are metrics
    observed during that write."""
    df = with_defaults(clean).withColumn("_ts", parse_ts(clean))
    look = product_lookup(products)
    j = (df.join(stores.select(F.col("store_location").alias("Store_Location"), "store_id"),
                 "Store_Location", "left")
           .join(look,
                 (df.Product_Category.eqNullSafe(look._k_category))
                 & (df.Product_Subcategory.eqNullSafe(look._k_subcategory))
                 & (df.Brand.eqNullSafe(look._k_brand))
                 & (df.Unit_Price.cast("double").eqNullSafe(look._k_unit_price)), "left"))
    reason = (F.when(F.col("_ts").isNull(), "unparsable_timestamp")
               .when(F.col("store_id").isNull(), "unknown_store")
               .when(F.col("product_id").isNull(), "unknown_product"))
    j = j.withColumn("reject_reason", reason)

    def col_or(name, default, cast):
        return (F.coalesce(F.col(name).cast(cast), F.lit(default)) if name in df.columns
                else F.lit(default).cast(cast))

    rows = j.select(
        F.struct(*clean.columns).alias("raw"), "reject_reason",
        F.col("reject_reason").isNotNull().alias("bad"),
        F.monotonically_increasing_id().alias("transaction_id"),
        F.col("_ts").alias("ts"), "store_id", "product_id",
        col_or("Discount_Percentage", 0.0, "double").alias("discount_percentage"),
        col_or("Revenue", 0.0, "double").cast(REVENUE_TYPE).alias("revenue"),
        col_or("Customer_Type", UNKNOWN, "string").alias("customer_type"),
        col_or("Payment_Mode", UNKNOWN, "string").alias("payment_mode"),
        (parse_flag(F.col("Promotion_Applied")) if "Promotion_Applied" in df.columns
         else F.lit(False)).alias("promotion_applied"),
        (parse_flag(F.col("Holiday_Flag")) if "Holiday_Flag" in df.columns
         else F.lit(False)).alias("holiday_flag"))
    fact_columns = [c for c in rows.columns if c not in ("raw", "reject_reason", "bad")]
    seen = Observation()
    rows = rows.observe(
        seen, F.count_if(~F.col("bad")).alias("transactions"), F.count_if("bad").alias("rejected"),
        *[F.count_if(~F.col("bad") & failed(p)).alias(n) for n, p in TRANSACTION_RULES])
    staged = write_staging(rows.select(
        "bad", F.when(F.col("bad"), F.struct("raw.*", "reject_reason")).alias("reject"),
        F.when(~F.col("bad"), F.struct(*fact_columns)).alias("fact")), "facts", ["bad"])
    counts = {n: seen.get.get(n, 0)
              for n in ("transactions", "rejected", *[n for n, _ in TRANSACTION_RULES])}
    return LoadResult(Star(stores, products, staged.where("NOT bad").select("fact.*")),
                      staged.where("bad").select("reject.*"), counts)


def load_star(clean: DataFrame, materialize: bool = False) -> LoadResult:
    """Dimensions, facts and rejects from cleaned rows.  These feed four
    builds; rows that ``clean_sales`` has not staged are written once with
    ``materialize``."""
    if materialize:
        clean = write_staging(clean, "clean-rows")
    stores = build_stores(clean)
    products = build_products(clean)
    return build_facts(clean, stores, products)


def load_report(lr: LoadResult) -> DataFrame:
    """(table, rows): row counts of the loaded star and of the rejects.  The
    facts were counted while they were written."""
    n = F.count(F.lit(1))
    return lr.star.stores.agg(n.alias("stores")).select(
        "stores", lr.star.products.agg(n).scalar().alias("products"),
        *[F.lit(lr.counts[c]).cast("long").alias(c) for c in ("transactions", "rejected")]).select(
        F.expr("stack(4, 'stores', stores, 'products', products, 'transactions', "
               "transactions, 'rejected', rejected) AS (table, rows)"))


# ------------------------------------------------------------------ validation
# Row rules of the three tables (name, predicate).
STORE_RULES = [
    ("store_location_required", "store_location IS NOT NULL AND store_location <> ''"),
    ("store_rating_range", "store_rating BETWEEN 0 AND 5"),
]
PRODUCT_RULES = [
    ("category_required", "category IS NOT NULL AND category <> ''"),
    ("unit_price_positive", "unit_price > 0"),
    ("stock_non_negative", "stock_on_hand >= 0"),
]
TRANSACTION_RULES = [
    ("store_id_required", "store_id IS NOT NULL"),
    ("product_id_required", "product_id IS NOT NULL"),
    ("discount_range", "discount_percentage BETWEEN 0 AND 100"),
    ("revenue_non_negative", "revenue >= 0"),
    ("customer_type_required", "customer_type IS NOT NULL"),
    ("payment_mode_required", "payment_mode IS NOT NULL"),
]


def failed(predicate: str) -> Column:
    """True where a rule does not hold; a null (missing value) fails it."""
    return ~F.coalesce(F.expr(predicate), F.lit(False))


def validate(df: DataFrame, rules: list[tuple[str, str]]):
    """(valid rows, rejected rows with an array of failed rule names)."""
    tagged = df.withColumn("failed_rules", F.array_compact(F.array(*[
        F.when(failed(pred), F.lit(name)) for name, pred in rules])))
    return (tagged.filter(F.size("failed_rules") == 0).drop("failed_rules"),
            tagged.filter(F.size("failed_rules") > 0))


def validation_summary(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, failures) for every rule, in one aggregate."""
    aggs = [F.count_if(failed(p)).alias(n) for n, p in rules]
    stack = ", ".join(f"'{n}', `{n}`" for n, _ in rules)
    return df.agg(*aggs).select(F.expr(f"stack({len(rules)}, {stack}) AS (rule, failures)"))


def validate_star(lr: LoadResult) -> DataFrame:
    """(table, rule, failures) of all three tables: one aggregate over each
    dimension, the facts' counts as taken while they were staged."""
    facts = ", ".join(f"'{n}', {lr.counts[n]}L" for n, _ in TRANSACTION_RULES)
    parts = {"stores": validation_summary(lr.star.stores, STORE_RULES),
             "products": validation_summary(lr.star.products, PRODUCT_RULES),
             "transactions": lr.star.stores.sparkSession.range(1).select(F.expr(
                 f"stack({len(TRANSACTION_RULES)}, {facts}) AS (rule, failures)"))}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("table"), "rule", "failures")
        out = df if out is None else out.unionByName(df)
    return out
