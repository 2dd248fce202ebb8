"""Property and recovery tests for the model operators."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from salescope.operators import forecast as fc
from salescope.operators import segments as seg
from salescope.operators.features import min_max_scale
from salescope.operators.filters import FilterSpec


def test_additive_fit_recovers_trend_and_weekly_pattern(spark):
    """730 days of 100 + 0.1 d + 20·[weekend] + noise per series: the fit must
    recover the weekly swing and extrapolate the trend."""
    rng = np.random.default_rng(7)
    start = date(2022, 1, 3)  # a Monday
    rows = []
    truth = {}
    for key, level in (("a", 100.0), ("b", 300.0)):
        for d in range(730 + 28):
            day = start + timedelta(days=d)
            y = level + 0.1 * d + (20.0 if day.weekday() >= 5 else 0.0)
            if d < 730:
                rows.append((key, day, float(y + rng.normal(0, 2.0)), False))
            else:
                truth[(key, day)] = y
    daily = spark.createDataFrame(rows, "k string, ds date, y double, holiday_flag boolean")
    pred = fc.forecast(daily, ["k"], 28).filter("is_forecast").toPandas()
    err = [abs(r.yhat - truth[(r.series, r.ds)]) for r in pred.itertuples()]
    assert len(err) == 56
    assert np.mean(err) < 3.0
    for key in ("a", "b"):
        p = pred[pred.series == key]
        assert 15.0 < p.weekly.max() - p.weekly.min() < 25.0
        inside = [(r.yhat_lower <= truth[(key, r.ds)] <= r.yhat_upper) for r in p.itertuples()]
        assert np.mean(inside) >= 0.6


def test_scaled_features_in_unit_interval(ref_star, spark):
    m = seg.store_metrics(ref_star, FilterSpec())
    s = min_max_scale(m, seg.FEATURES)
    r = s.agg(*[F.min(c + "_scaled").alias("lo_" + c) for c in seg.FEATURES],
              *[F.max(c + "_scaled").alias("hi_" + c) for c in seg.FEATURES]).first()
    for c in seg.FEATURES:
        assert 0.0 <= r["lo_" + c] <= r["hi_" + c] <= 1.0


def test_extra_regressor_with_future_values(spark):
    """y = 50 + 8·x + noise with a continuous daily regressor x: the fit must
    use the supplied future x (back-filled where missing)."""
    rng = np.random.default_rng(3)
    start = date(2023, 1, 2)
    rows, fut = [], []
    for d in range(400):
        x = float(rng.uniform(0, 10))
        rows.append(("s", start + timedelta(days=d), 50.0 + 8.0 * x + float(rng.normal(0, 0.5)),
                     False, x))
    for d in range(400, 410):
        if d % 2 == 0:  # every other future day given; the rest back-fill
            fut.append(("s", start + timedelta(days=d), 9.0))
    daily = spark.createDataFrame(rows, "k string, ds date, y double, holiday_flag boolean, x double")
    future = spark.createDataFrame(fut, "k string, ds date, x double")
    pred = (fc.forecast(daily, ["k"], 10, regressors=["x"], future=future)
              .filter("is_forecast").orderBy("ds").toPandas())
    assert len(pred) == 10
    # every future day sees x = 9 (given or back-filled from the next given day),
    # except the last, which has no later value and falls back to 0
    expect = [50 + 8 * 9.0] * 9 + [50.0]
    assert np.max(np.abs(pred.yhat.to_numpy() - np.array(expect))) < 3.0
    assert pred.extra_regressors.abs().max() > 10
