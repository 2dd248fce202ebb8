"""The five analyses over one star, each returning named lazy DataFrames.

Which filters apply follows the dashboard: overview, drivers and
explanations take days + store + category; the forecast takes store +
category (and an optional look-back on its training data); segmentation
takes days + category.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from salescope.operators import drivers as drv
from salescope.operators import forecast as fc
from salescope.operators import overview as ov
from salescope.operators import segments as seg
from salescope.operators.filters import FilterSpec
from salescope.sources.star import Star


@dataclass
class Analytics:
    star: Star

    def overview(self, days: int = 30, store: str | None = None,
                 category: str | None = None, one_pass: bool = True) -> dict[str, DataFrame]:
        """KPIs, daily trend, top stores / categories and filter lists.  With
        ``one_pass`` (default) the facts are scanned once for all frames."""
        spec = FilterSpec(days, store, category)
        return ov.overview_one_pass(self.star, spec) if one_pass else ov.overview(self.star, spec)

    def forecast(self, steps: int = 30, store: str | None = None, category: str | None = None,
                 days: int = 0, keys: list[str] | None = None,
                 baseline: str = "daily") -> dict[str, DataFrame]:
        return fc.revenue_forecast(self.star, steps=steps, store=store, category=category,
                                   days=days, keys=keys, baseline=baseline)

    def drivers(self, days: int = 0, store: str | None = None, category: str | None = None,
                **fit_args) -> dict:
        return drv.analyze_drivers(self.star, FilterSpec(days, store, category), **fit_args)

    def explain(self, days: int = 0, store: str | None = None, category: str | None = None,
                **fit_args) -> dict:
        return drv.shap_explainability(self.star, FilterSpec(days, store, category), **fit_args)

    def segments(self, n_clusters: int = 4, days: int = 0, category: str | None = None,
                 n_init: int = 10) -> dict:
        r = seg.segment_stores(self.star, n_clusters, days, category, n_init=n_init)
        return {"assignments": r.assignments, "summary": r.summary, "centers": r.centers,
                "inertia": r.inertia}

    def filters(self) -> DataFrame:
        return ov.filter_options(self.star)
