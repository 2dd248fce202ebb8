"""salescope: retail sales analytics on Spark DataFrames.

The package turns a three-table star schema (stores, products, transactions)
into dashboard frames (KPIs, trends, top lists), store segments, revenue
drivers with exact tree SHAP attributions, and many-series revenue
forecasts.  Everything is expressed with the DataFrame / MLlib APIs so that
Catalyst plans the work; Python runs on executors only for the two
numerical kernels (tree SHAP and the additive forecast fit).
"""

from salescope.operators.filters import FilterSpec

__all__ = ["FilterSpec"]
