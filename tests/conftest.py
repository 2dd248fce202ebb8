import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from salescope.session import build_session
    scratch = tempfile.mkdtemp(prefix="salescope-test-")
    s = build_session("local[4]", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
        "spark.driver.memory": "4g",
    })
    yield s
    s.stop()


@pytest.fixture(scope="session")
def ref_star(spark):
    """The reference's own test data: 5 stores × 3 products × 90 days."""
    from datetime import datetime, timedelta
    from decimal import Decimal

    from salescope.sources.star import Star
    stores = [(1, "Downtown", 4.5), (2, "Suburban Mall", 3.8), (3, "Airport Terminal", 4.2),
              (4, "Harbor District", 3.2), (5, "University Plaza", 4.8)]
    products = [(1, "Electronics", "Phones", "TechBrand", Decimal("599.99"), 100),
                (2, "Clothing", "Shirts", "FashionCo", Decimal("49.99"), 500),
                (3, "Groceries", "Dairy", "FarmFresh", Decimal("3.99"), 1000)]
    rows = []
    tid = 0
    for d in range(90):
        for s in stores:
            for p in products:
                tid += 1
                rows.append((tid, datetime(2024, 1, 1) + timedelta(days=d), s[0], p[0],
                             5.0 if d % 7 == 0 else 0.0,
                             p[4] * (Decimal(1) + Decimal(d) / Decimal(100)),
                             "Returning" if d % 3 == 0 else "New",
                             "Card" if d % 2 == 0 else "Cash", d % 14 == 0, d % 30 == 0))
    st = spark.createDataFrame(stores, "store_id long, store_location string, store_rating double")
    pr = spark.createDataFrame(
        [(a, b, c, d, float(e), f) for a, b, c, d, e, f in products],
        "product_id long, category string, subcategory string, brand string, "
        "unit_price double, stock_on_hand int")
    tx = spark.createDataFrame(
        rows, "transaction_id long, ts timestamp, store_id long, product_id long, "
              "discount_percentage double, revenue decimal(17,4), customer_type string, "
              "payment_mode string, promotion_applied boolean, holiday_flag boolean")
    return Star(st, pr, tx)
