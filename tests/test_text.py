from pyspark.sql import functions as F

from salescope.functions.flags import parse_flag
from salescope.functions.text import compact_number, feature_display_name, long_date, title_case


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_title_case_matches_python(spark):
    for s in ["e-wallet o'brien", "small ring", "ECONOMY", "4-not specified",
              "supplier#000000001", "brand#13", "  padded  ", "mixed CASE words", "a, b",
              "3rd street", "x  y", "O'NEIL-SMITH jr.", "tab\there", "abc1", "__x__y"]:
        assert one(spark, title_case, s) == s.title(), s


def test_display_names(spark):
    cases = {"store_rating": "Store Rating", "payment_mode_Card": "Payment Mode = Card",
             "customer_type_BUILDING": "Customer Type = Building",
             "category_PROMO": "Category Promo", "discount_percentage": "Discount Percentage"}
    for f, want in cases.items():
        assert one(spark, feature_display_name, f) == want


def test_display_name_uses_metadata_for_underscored_levels(spark):
    df = spark.createDataFrame([("payment_mode_Credit_Card", "payment_mode", "Credit_Card")],
                               "f string, s string, l string")
    r = df.select(feature_display_name(F.col("f"), F.col("s"), F.col("l"))).first()[0]
    assert r == "Payment Mode = Credit Card"


def test_flags(spark):
    for v, want in [("Yes", True), ("no", False), ("False", False), ("0", False), ("1", True),
                    ("TRUE", True), (None, False), ("maybe", False)]:
        assert one(spark, parse_flag, v) is want, v


def test_formats(spark):
    assert one(spark, compact_number, 1234567.0, "double") == "1.2M"
    assert one(spark, compact_number, 4321.0, "double") == "4.3K"
    from datetime import date
    assert one(spark, long_date, date(2024, 1, 5), "date") == "Jan 05, 2024"
