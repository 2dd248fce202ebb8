"""Hand-computed expectations on the reference's own 5×3×90 test data."""

import pytest
from pyspark.sql import functions as F

from salescope.operators import forecast as fc
from salescope.operators import overview as ov
from salescope.operators import segments as seg
from salescope.operators.filters import FilterSpec


def test_kpis_all_time(ref_star):
    k = ov.kpis(ref_star, FilterSpec(days=0)).first()
    assert k.transaction_count == 1350
    assert k.total_revenue == pytest.approx(425243.9925, abs=1e-6)
    assert k.avg_order_value == 315.00
    assert (k.store_count, k.product_count) == (5, 3)


def test_lookback_is_inclusive(ref_star):
    trend = ov.revenue_trend(ref_star, FilterSpec(days=30)).collect()
    assert len(trend) == 31
    assert str(trend[0].date) == "2024-02-29"
    assert ov.kpis(ref_star, FilterSpec(days=30)).first().transaction_count == 465


def test_flag_counts(ref_star):
    r = ref_star.transactions.agg(
        F.count_if(F.col("discount_percentage") > 0).alias("disc"),
        F.count_if("promotion_applied").alias("promo"), F.count_if("holiday_flag").alias("hol"),
        F.count_if(F.col("customer_type") == "Returning").alias("ret"),
        F.count_if(F.col("payment_mode") == "Card").alias("card")).first()
    assert tuple(r) == (195, 105, 45, 450, 675)


def test_top_lists_and_cross_filter(ref_star):
    spec = FilterSpec(days=0, store="Downtown", category="Clothing")
    stores = ov.top_stores(ref_star, spec).collect()
    assert len(stores) == 5  # the store filter does not apply to its own list
    cats = ov.top_categories(ref_star, spec).collect()
    assert [c.category for c in cats] == ["Electronics", "Clothing", "Groceries"]
    assert cats[0].revenue == pytest.approx(599.99 * 130.05, rel=1e-12)


def test_filter_options_sorted(ref_star):
    opts = ov.filter_options(ref_star).collect()
    assert [o.value for o in opts if o.kind == "category"] == ["Clothing", "Electronics", "Groceries"]


def test_empty_filter_gives_empty_frames(ref_star):
    spec = FilterSpec(days=0, store="Nowhere")
    assert ov.revenue_trend(ref_star, spec).count() == 0
    k = ov.kpis(ref_star, spec).first()
    assert (k.total_revenue, k.transaction_count, k.avg_order_value) == (0.0, 0, 0.0)


def test_segments_two_clusters(ref_star):
    r = seg.segment_stores(ref_star, n_clusters=2, n_init=3)
    assert r.summary.count() == 2
    a = r.assignments.collect()
    assert len(a) == 5 and {x.cluster_id for x in a} <= {0, 1}
    # id 0 is the cluster with the highest centroid revenue
    c = {x.cluster_id: x.avg_revenue for x in r.centers.collect()}
    assert c[0] >= c[1]


def test_segments_bad_k(ref_star):
    with pytest.raises(ValueError):
        seg.segment_stores(ref_star, n_clusters=9, n_init=1)


def test_forecast_shapes_and_band(ref_star):
    out = fc.revenue_forecast(ref_star, steps=7)
    p = out["predictions"]
    assert p.count() == 90 + 7
    assert p.filter("yhat_lower > yhat OR yhat > yhat_upper").count() == 0
    assert out["summary"].count() == 1
    assert out["predictions_tail"].count() == 5
    s = out["summary"].first()
    assert s.trend_word == "upward"  # revenue grows 1 % a day in the fixture


def test_forecast_rejects_zero_steps(ref_star):
    with pytest.raises(ValueError):
        fc.revenue_forecast(ref_star, steps=0)


def test_batched_fit_equals_per_group_fit(ref_star, spark):
    daily = fc.daily_series(ref_star, FilterSpec(), ["store_location", "category"])
    # small Arrow batches force series to straddle batch boundaries
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        a = fc.forecast(daily, ["store_location", "category"], 7).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    b = fc.forecast(daily, ["store_location", "category"], 7, fit_fn=fc.fit_predict).toPandas()
    key = ["series", "ds"]
    a, b = a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True)
    assert len(a) == 15 * 97
    import numpy as np
    np.testing.assert_allclose(a["yhat"], b["yhat"], rtol=1e-9)
    np.testing.assert_allclose(a["yhat_upper"], b["yhat_upper"], rtol=1e-9)


def test_drivers_and_explanation(ref_star):
    from salescope.operators import drivers as drv
    out = drv.shap_explainability(ref_star, FilterSpec(), rounds=10, max_depth=3)
    imp = out["importance"].collect()
    assert len(imp) > 0
    # revenue depends on the product (category) and the day only
    assert imp[0].Feature.startswith("category_")
    assert abs(sum(r.pct_contribution for r in imp) - 100) < 1.0
    entries = out["entries"].collect()
    assert {e.side for e in entries} <= {"booster", "reducer"}
    s = out["summary"].first()
    assert s.booster_count + s.reducer_count == len(entries)
    assert s.summary.startswith("Analysis identified") or s.summary.startswith("Insufficient")
    assert all(e.interpretation.endswith("of average order value).") for e in entries)


def test_saved_coefficients_reproduce_forecast(ref_star, spark, tmp_path):
    keys = ["store_location", "category"]
    daily = fc.daily_series(ref_star, FilterSpec(), keys)
    pred = fc.forecast(daily, keys, 7).toPandas()
    path = str(tmp_path / "coef")
    fc.fit_coefficients(daily, keys).write.parquet(path)
    coefs = spark.read.parquet(path)
    assert coefs.count() == 15
    dates = fc.model_input(daily, keys, 7).select("series", "ds", "holiday_flag")
    again = fc.predict_with_coefficients(coefs, dates).toPandas()
    key = ["series", "ds"]
    a = pred.sort_values(key).reset_index(drop=True)
    b = again.sort_values(key).reset_index(drop=True)
    import numpy as np
    np.testing.assert_allclose(a["yhat"], b["yhat"], rtol=1e-9)
    np.testing.assert_allclose(a["yhat_lower"], b["yhat_lower"], rtol=1e-9)


def test_one_pass_overview_equals_separate_frames(ref_star):
    spec = FilterSpec(days=45, store="Downtown", category="Clothing")
    a = ov.overview(ref_star, spec)
    b = ov.overview_one_pass(ref_star, spec)
    for k in ("kpis", "revenue_trend", "top_stores", "top_categories"):
        assert [tuple(r) for r in a[k].collect()] == [tuple(r) for r in b[k].collect()], k
