"""Rows joined in written steps: the same rows, one shuffle of the facts a step."""

import os

import pytest
from pyspark.sql import functions as F

from salescope.operators import drivers as drv
from salescope.operators import filters as fl
from salescope.operators import forecast as fc
from salescope.session import recorded_tables
from salescope.sources.star import star_from_tpch

SMALL = "/root/testdata/sf0.001"
KEYS = ["store_location", "category"]


def held(paths):
    return [p for p in paths if os.path.exists(p.removeprefix("file:"))]


@pytest.mark.parametrize("most_stores", [500_000, 0])
@pytest.mark.parametrize("spec", [fl.FilterSpec(), fl.FilterSpec(365, category="PROMO")])
@pytest.mark.parametrize("given", [True, False])
def test_staged_rows_are_the_enriched_rows(spark, ref_star, monkeypatch, most_stores, spec, given):
    monkeypatch.setattr(fl, "MAX_BROADCAST_STORES", most_stores)
    star = star_from_tpch(spark, SMALL) if given else ref_star
    columns = [drv.ID, "ts", "store_id", *drv.DRIVER_COLUMNS]
    want, got = fl.enriched(star, spec, columns), fl.staged_rows(star, spec, columns, "rows")
    assert got.dtypes == want.dtypes and got.count() == want.count()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_lines_without_their_order_are_kept(spark):
    """A line without an order, and one whose order has no customer."""
    star = star_from_tpch(spark, SMALL)
    parts = star.parts
    some = parts.attributes.where("order_key % 3 <> 0").withColumn(
        "customer_type", F.when(F.col("order_key") % 3 == 1, F.col("customer_type")))
    got = fl.staged_rows(star._replace(parts=parts._replace(attributes=some)), fl.FilterSpec(),
                         [drv.ID, "customer_type", "payment_mode"], "rows")
    assert got.count() == star.narrow.count()
    third = F.floor(F.col(drv.ID) / 10) % 3
    assert got.where((third == 0) & F.coalesce("customer_type", "payment_mode").isNotNull()).count() == 0
    assert got.where((third != 0) & F.col("payment_mode").isNull()).count() == 0
    assert got.where((third == 1) != F.col("customer_type").isNotNull()).count() == 0


@pytest.mark.parametrize("most_stores,steps", [(500_000, 2), (0, 3)])
def test_a_step_shuffles_the_facts_once(spark, monkeypatch, most_stores, steps):
    """Of all joins that a step's plan makes of the lines, one is a shuffle;
    what a step read is deleted after it."""
    monkeypatch.setattr(fl, "MAX_BROADCAST_STORES", most_stores)
    plans, plain = [], fl.materialize

    def kept(df, *a, **b):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, *a, **b)
    monkeypatch.setattr(fl, "materialize", kept)
    with recorded_tables() as paths:
        rows = fl.staged_rows(star_from_tpch(spark, SMALL), fl.FilterSpec(),
                              [drv.ID, *drv.DRIVER_COLUMNS], "rows")
    assert len(plans) == len(paths) == steps and held(paths) == paths[-1:] and rows.count() > 0
    for plan in plans:
        joins = [x for x in plan.splitlines() if "Join " in x and "strategy=broadcast" not in x]
        # The lines' own join, and in the last step that of orders and customers.
        assert len([x for x in joins if "c_custkey" not in x]) == 1


def test_every_row_has_values_without_a_copy_in_order(spark, monkeypatch):
    """shap_values writes no copy of the rows in the order of their ids."""
    from salescope.plans import registry
    monkeypatch.setattr(registry, "_driver_model", lambda s, d: drv.fit_drivers(
        star_from_tpch(s, d), fl.FilterSpec(), rounds=3))
    with recorded_tables() as paths:
        out = registry.shap_values(spark, SMALL)
        off = F.abs(F.aggregate("values", F.col("base_value"), lambda s, x: s + x) - F.col("prediction"))
        n, worst = out.agg(F.count(F.lit(1)), F.max(off)).first()
    assert n == star_from_tpch(spark, SMALL).narrow.count() and worst < 1e-6
    assert not [p for p in paths if "driver-matrix" in p]
    assert len([p for p in held(paths) if "driver-rows" in p]) == 1


@pytest.mark.parametrize("most_stores", [500_000, 0])
def test_coefficients_are_fitted_from_written_days(spark, monkeypatch, most_stores):
    """The fit's shuffle is the only one left to do: joined rows and days are
    written in turn, and the rows deleted.  Same coefficients."""
    from salescope.plans import registry
    monkeypatch.setattr(fl, "MAX_BROADCAST_STORES", most_stores)
    with recorded_tables() as paths:
        got = registry.forecast_coefficients(spark, SMALL)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert [p.split("/")[-1][:12] for p in held(paths)] == ["daily-series"]
    daily = fc.daily_series(star_from_tpch(spark, SMALL), fl.FilterSpec(), KEYS)
    want = {r["series"]: r for r in fc.fit_coefficients(daily, KEYS).collect()}
    rows = got.collect()
    assert len(rows) == len(want) > 1 and all(r == want[r["series"]] for r in rows)


def test_staged_days_are_the_days(spark, ref_star):
    """Also of extra regressors, and without keys."""
    for keys, regs in ([], None), (KEYS, None), (["category"], {"d": F.max("discount_percentage")}):
        want = fc.daily_series(ref_star, fl.FilterSpec(), keys, regs)
        got = fc.daily_series(ref_star, fl.FilterSpec(), keys, regs, stage=True)
        assert got.dtypes == want.dtypes and got.count() == want.count()
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
