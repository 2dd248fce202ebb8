"""What the cleaning writes and how text is cased, against the plain ways."""

import random

from pyspark.sql import functions as F

from salescope.functions.text import title_case
from salescope.operators.clean import clean_sales, standardize_strings, standardize_text
from salescope.session import recorded_tables

COLUMNS = ("_row long, Date string, Store_Location string, Store_Rating double, "
           "Unit_Price double, Discount_Percentage double, Revenue double")


def test_copies_are_collapsed_before_rows_are_written(spark):
    rows = [(i, "2024-01-01", " a  ", None if i % 5 == 0 else 4.0, 1.0, None if i % 7 else 0.0, 2.0)
            for i in range(300)]
    rows += [(300, "2024-01-01", "a", 5.0, 1.0, 0.0, 2.0), (301, None, "a", 1.0, 1.0, 0.0, 2.0),
             (302, "2024-01-02", "a", 1.0, -1.0, 0.0, 2.0)]
    raw = spark.createDataFrame(rows, COLUMNS)
    with recorded_tables() as paths:
        got = clean_sales(raw)
        staged = sum(spark.read.parquet(p).count() for p in paths)
    assert staged <= 10
    plain = clean_sales(raw, materialize=False)
    assert sorted(got.rows.collect()) == sorted(plain.rows.collect())
    assert sorted(r["_row"] for r in got.rows.collect()) == [0, 300]
    assert got.report.collect() == plain.report.collect()
    assert got.median_rating.collect() == plain.median_rating.collect()


def test_missing_ratings_alone(spark):
    raw = spark.createDataFrame([(1, "2024-01-01", "a", None, 1.0, 0.0, 2.0)] * 2, COLUMNS)
    got, plain = clean_sales(raw), clean_sales(raw, materialize=False)
    assert got.rows.collect() == plain.rows.collect()
    assert got.report.collect() == plain.report.collect()
    assert got.median_rating.first()["median"] is None


def test_plain_text_is_cased_as_a_whole(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abZN oe'-#7_\t\néⓐßΣı") for _ in range(rnd.randrange(9)))
             for _ in range(4000)] + ["nan", " NONE", "", None, "forest green", "supplier#0007"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    runs = F.regexp_extract_all("t", F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    slow = F.array_join(F.transform(runs, lambda t: F.initcap(t)), "")
    assert df.where(~title_case(F.col("t")).eqNullSafe(slow)).count() == 0
    both = standardize_strings(df.withColumn("u", F.col("t"))).select("t").collect()
    assert both == df.select(standardize_text(F.col("t")).alias("t")).collect()
    plan = standardize_strings(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" in plan.lower() and plan.count("Project") == 3
