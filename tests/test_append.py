"""Loading a second file into a written star; series ids of clashing keys."""

from pyspark.sql import functions as F

from salescope.operators.forecast import series_id
from salescope.operators.star_build import load_star
from salescope.sources.sinks import append_star, write_star
from salescope.sources.star import read_star


def month(spark, rows):
    return spark.createDataFrame(
        [(i, d, s, 4.0, "Toys", 5.0, "a", "b", 1, r) for i, (d, s, r) in enumerate(rows)],
        "_row long, Date string, Store_Location string, Store_Rating double, "
        "Product_Category string, Unit_Price double, Product_Subcategory string, "
        "Brand string, Stock_On_Hand int, Revenue double")


def test_second_load_keeps_ids(spark, tmp_path):
    path = str(tmp_path / "star")
    write_star(load_star(month(spark, [("2024-01-01", "Alpha", 100.0),
                                       ("2024-01-02", "Beta", 200.0)])).star, path)
    assert append_star(month(spark, [("2024-02-01", "Gamma", 7.0), ("2024-02-01", "Beta", 3.0)]),
                       path).count() == 0
    st = read_star(spark, path)
    by_store = {r.store_location: float(r.r) for r in st.transactions.join(st.stores, "store_id")
                .groupBy("store_location").agg(F.sum("revenue").alias("r")).collect()}
    assert by_store == {"Alpha": 100.0, "Beta": 203.0, "Gamma": 7.0}
    assert st.stores.count() == 3 and st.products.count() == 1
    assert st.transactions.select("transaction_id").distinct().count() == 4


def test_series_ids_differ(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ("a\\", "c")],
                               "x string, y string")
    assert df.select(series_id(["x", "y"])).distinct().count() == 5
    assert spark.createDataFrame([("A", "B")], "x string, y string") \
        .select(series_id(["x", "y"])).first()[0] == "A|B"
