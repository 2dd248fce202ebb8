"""Text is cased once a row; the facts' lookups read staged dimensions."""

from pyspark.sql import functions as F

from salescope.operators.clean import standardize_text


def test_text_is_cased_once(spark):
    df = spark.createDataFrame([(" o'brien e-wallet ",), ("NaN",), (None,), ("  ",), ("NONE ",),
                                ("été 3x",)], "t string").select(
        standardize_text(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["O'Brien E-Wallet", "Unknown", "Unknown", "Unknown",
                                              "Unknown", "Été 3X"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_dimensions_are_staged(spark):
    from salescope.operators.star_build import build_products, build_stores
    clean = spark.createDataFrame([(1, "A", "c", 2.0)], "_row long, Store_Location string, "
                                  "Product_Category string, Unit_Price double")
    for build in (build_stores, build_products):
        assert build(clean).inputFiles()
