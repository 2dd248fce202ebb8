"""Dashboard overview: KPIs, daily trend, top stores and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators.filters import FilterSpec, check_overview_days, enriched
from salescope.sources.star import Star

TOP_N = 5


def _revenue_total():
    # Exact decimal sum, one cast at the edge.
    return F.sum("revenue").cast("double")


def kpis(star: Star, spec: FilterSpec) -> DataFrame:
    """One row: total_revenue, transaction_count, avg_order_value (2 dp),
    store_count, product_count.  The two dimension counts ignore the filters;
    they are attached as scalar subqueries (no join, no cross product)."""
    f = enriched(star, spec, ["transaction_id", "revenue"])
    store_n = star.stores.agg(F.count(F.lit(1))).scalar()
    product_n = star.products.agg(F.count(F.lit(1))).scalar()
    return f.agg(
        F.coalesce(_revenue_total(), F.lit(0.0)).alias("total_revenue"),
        F.count("transaction_id").alias("transaction_count"),
        F.round(F.coalesce(_revenue_total() / F.count("revenue"), F.lit(0.0)), 2)
        .alias("avg_order_value"),
    ).select("*", store_n.alias("store_count"), product_n.alias("product_count"))


def dimension_counts(star: Star) -> DataFrame:
    return star.stores.agg(F.count(F.lit(1)).alias("store_count")).select(
        "store_count", star.products.agg(F.count(F.lit(1))).scalar().alias("product_count"))


def revenue_trend(star: Star, spec: FilterSpec) -> DataFrame:
    """Daily revenue; days without sales are absent.  Partial aggregation
    leaves at most one row per day per task before the shuffle, so a day
    holding a third of all rows costs no more than any other."""
    f = enriched(star, spec, ["ts", "revenue"])
    return (f.groupBy(F.to_date("ts").alias("date"))
             .agg(_revenue_total().alias("revenue"))
             .orderBy("date"))


def _top(f: DataFrame, key: str, n: int) -> DataFrame:
    # orderBy + limit plans as TakeOrderedAndProject: each task keeps n rows.
    return (f.groupBy(key).agg(_revenue_total().alias("revenue"))
             .orderBy(F.desc("revenue"), F.asc(key)).limit(n))


def top_stores(star: Star, spec: FilterSpec, n: int = TOP_N) -> DataFrame:
    """Top stores by revenue; the store filter itself does not apply."""
    return _top(enriched(star, spec.without("store"), ["store_location", "revenue"]),
                "store_location", n)


def top_categories(star: Star, spec: FilterSpec, n: int = TOP_N) -> DataFrame:
    """Top categories by revenue; the category filter itself does not apply."""
    return _top(enriched(star, spec.without("category"), ["category", "revenue"]),
                "category", n)


def filter_options(star: Star) -> DataFrame:
    """(kind, value): every distinct store location and category, sorted."""
    s = star.stores.select(F.lit("store").alias("kind"), F.col("store_location").alias("value"))
    c = star.products.select(F.lit("category").alias("kind"), F.col("category").alias("value"))
    return s.union(c).distinct().orderBy("kind", "value")


def overview(star: Star, spec: FilterSpec = FilterSpec(days=30)) -> dict[str, DataFrame]:
    """All overview frames for one filter spec (lazy; nothing runs here
    except the one-value look-back cutoff)."""
    check_overview_days(spec.days)
    return {
        "kpis": kpis(star, spec),
        "revenue_trend": revenue_trend(star, spec),
        "top_stores": top_stores(star, spec),
        "top_categories": top_categories(star, spec),
        "filters": filter_options(star),
    }


def overview_one_pass(star: Star, spec: FilterSpec = FilterSpec(days=30),
                      n: int = TOP_N) -> dict[str, DataFrame]:
    """The same KPI, trend and top-list frames from ONE scan of the facts.

    A single grouping-sets aggregate over (day), (store), (category) and ()
    carries one conditional sum per consumer, which is how the cross-filter
    exemptions are kept: the trend and KPIs need both the store and category
    predicates, the store list only the category one, the category list
    only the store one.  Partial aggregation runs before the shuffle; the
    result has one row per day, store and category, and is persisted so the
    four frames read it instead of the facts.
    """
    check_overview_days(spec.days)
    f = enriched(star, FilterSpec(days=spec.days),
                 ["ts", "revenue", "transaction_id", "store_location", "category"])
    s_ok = (F.col("store_location") == spec.store) if spec.store else F.lit(True)
    c_ok = (F.col("category") == spec.category) if spec.category else F.lit(True)
    both = s_ok & c_ok
    g = (f.select(F.to_date("ts").alias("date"), "store_location", "category", "revenue",
                  "transaction_id", both.alias("_both"), s_ok.alias("_s"), c_ok.alias("_c"))
          .groupingSets([["date"], ["store_location"], ["category"], []],
                        "date", "store_location", "category")
          .agg(F.grouping_id().alias("_gid"),
               F.sum(F.when(F.col("_both"), F.col("revenue"))).alias("rev_both"),
               F.count(F.when(F.col("_both"), F.col("transaction_id"))).alias("n_both"),
               F.count(F.when(F.col("_both"), F.col("revenue"))).alias("nrev_both"),
               F.sum(F.when(F.col("_c"), F.col("revenue"))).alias("rev_c"),
               F.sum(F.when(F.col("_s"), F.col("revenue"))).alias("rev_s"))
          .persist())
    # grouping_id bits: date, store_location, category (1 = rolled up).
    by_date, by_store, by_cat, total = 3, 5, 6, 7
    store_n = star.stores.agg(F.count(F.lit(1))).scalar()
    product_n = star.products.agg(F.count(F.lit(1))).scalar()
    tot = g.filter(F.col("_gid") == total)
    rev = F.col("rev_both").cast("double")
    kpi = tot.select(
        F.coalesce(rev, F.lit(0.0)).alias("total_revenue"),
        F.col("n_both").alias("transaction_count"),
        F.round(F.coalesce(rev / F.col("nrev_both"), F.lit(0.0)), 2).alias("avg_order_value"),
        store_n.alias("store_count"), product_n.alias("product_count"))
    trend = (g.filter((F.col("_gid") == by_date) & F.col("rev_both").isNotNull())
              .select("date", rev.alias("revenue")).orderBy("date"))
    stores = (g.filter((F.col("_gid") == by_store) & F.col("rev_c").isNotNull())
               .select("store_location", F.col("rev_c").cast("double").alias("revenue"))
               .orderBy(F.desc("revenue"), F.asc("store_location")).limit(n))
    cats = (g.filter((F.col("_gid") == by_cat) & F.col("rev_s").isNotNull())
             .select("category", F.col("rev_s").cast("double").alias("revenue"))
             .orderBy(F.desc("revenue"), F.asc("category")).limit(n))
    return {"kpis": kpi, "revenue_trend": trend, "top_stores": stores,
            "top_categories": cats, "filters": filter_options(star),
            # the persisted grouping-sets result; unpersist() it when done
            "shared": g}
