"""One-row dirty cases for every cleaning / load rule."""

import os

from pyspark.sql import functions as F

from salescope.operators.clean import clean_sales, downcast
from salescope.operators.star_build import load_star, validate, STORE_RULES
from salescope.sources.raw import read_sales_csv

HEADER = ("Date,Store_Location,Store_Rating,Product_Category,Product_Subcategory,Brand,"
          "Stock_On_Hand,Unit_Price,Discount_Percentage,Revenue,Customer_Type,Payment_Mode,"
          "Promotion_Applied,Holiday_Flag")
ROWS = [
    "2024-01-01,  downtown ,4.0,electronics,phones,acme,5,10.0,,100.0,new,e-wallet o'brien,No,False",
    "2024-01-02,Downtown,3.0,Electronics,Phones,Acme,7,10.0,5,50.0,nan,Card,Yes,0",  # later rating
    "2024-01-03,Uptown,,Clothing,Shirts,Co,1,2.0,1,20.0,None,Cash,1,yes",
    "2024-01-03,Uptown,,Clothing,Shirts,Co,1,2.0,1,20.0,None,Cash,1,yes",  # exact copy
    ",Uptown,4.0,Clothing,Shirts,Co,1,2.0,1,20.0,New,Cash,No,No",        # no date
    "2024-01-04,Uptown,4.0,Clothing,Shirts,Co,1,-2.0,1,20.0,New,Cash,No,No",  # negative price
    "2024-01-05,Uptown,4.0,Clothing,Shirts,Co,1,2.0,1,-5.0,New,Cash,No,No",   # negative revenue
    "not a date,Uptown,5.0,Clothing,Shirts,Co,1,2.0,1,30.0,New,Cash,No,No",   # unparsable
]


def load(spark, tmp_path):
    p = os.path.join(tmp_path, "sales.csv")
    with open(p, "w") as f:
        f.write("\n".join([HEADER] + ROWS) + "\n")
    return read_sales_csv(spark, p)


def test_cleaning_rules(spark, tmp_path):
    cr = clean_sales(load(spark, str(tmp_path)))
    rep = {r.step: (r.rows_removed, r.cells_filled) for r in cr.report.collect()}
    assert rep["drop_missing_critical"] == (1, 0)
    assert rep["drop_anomalies"] == (2, 0)
    assert rep["impute_median_rating"] == (0, 2)
    assert rep["impute_zero_discount"] == (0, 1)
    assert rep["drop_exact_duplicates"] == (1, 0)
    rows = cr.rows.orderBy("_row").collect()
    assert len(rows) == 4
    assert rows[0].Store_Location == "Downtown"
    assert rows[0].Payment_Mode == "E-Wallet O'Brien"
    assert rows[1].Customer_Type == "Unknown"           # 'nan' text → Unknown
    assert rows[2].Store_Rating == 4.0                   # median of 4, 3, 5
    assert rows[0].Discount_Percentage == 0.0


def test_star_load(spark, tmp_path):
    cr = clean_sales(load(spark, str(tmp_path)))
    lr = load_star(cr.rows)
    stores = {r.store_location: r for r in lr.star.stores.collect()}
    assert stores["Downtown"].store_rating == 4.0        # first row wins
    assert stores["Downtown"].store_id == 1 and stores["Uptown"].store_id == 2
    prods = lr.star.products.collect()
    assert len(prods) == 3                               # two stock levels of one product
    rej = lr.rejected.collect()
    assert [r.reject_reason for r in rej] == ["unparsable_timestamp"]
    tx = lr.star.transactions.orderBy("ts").collect()
    assert len(tx) == 3
    assert [t.promotion_applied for t in tx] == [False, True, True]
    assert [t.holiday_flag for t in tx] == [False, False, True]
    # both Downtown rows resolve to the later product id (stock not in key)
    pid = max(p.product_id for p in prods if p.category == "Electronics")
    assert tx[0].product_id == pid and tx[1].product_id == pid


def test_validation_and_downcast(spark):
    df = spark.createDataFrame([(1, "A", 4.5), (2, "", 7.0)],
                               "store_id long, store_location string, store_rating double")
    ok, bad = validate(df, STORE_RULES)
    assert ok.count() == 1
    assert bad.first().failed_rules == ["store_location_required", "store_rating_range"]
    d = downcast(df)
    assert dict(d.dtypes)["store_id"] == "tinyint" and dict(d.dtypes)["store_rating"] == "float"


def test_defaults_when_columns_are_missing(spark, tmp_path):
    p = os.path.join(str(tmp_path), "bare.csv")
    with open(p, "w") as f:
        f.write("Date,Revenue\n2024-02-01,12.5\n2024-02-02,7.5\n")
    cr = clean_sales(read_sales_csv(spark, p))
    lr = load_star(cr.rows)
    s = lr.star.stores.collect()
    pr = lr.star.products.collect()
    assert [(x.store_location, x.store_rating) for x in s] == [("Default_Location", 0.0)]
    assert [(x.category, x.unit_price, x.stock_on_hand) for x in pr] == [("Default", 10.0, 0)]
    tx = lr.star.transactions.orderBy("ts").collect()
    assert len(tx) == 2 and tx[0].customer_type == "Unknown" and tx[0].promotion_applied is False
    assert float(tx[0].revenue) == 12.5
