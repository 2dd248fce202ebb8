"""Revenue drivers: boosted trees on transaction features + SHAP ranking,
and the plain-language booster / reducer explanation built on it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.functions.text import feature_display_name, money
from salescope.operators.features import bools_to_int, one_hot_drop_first
from salescope.operators.filters import FilterSpec, enriched, staged_rows
from salescope.operators.leafwise import Coding, LeafwiseModel, collapse, fit_coding, fit_leafwise
from salescope.operators.path_shap import PathExplainer
from salescope.session import materialize, release_shuffles
from salescope.sources.star import Star

DRIVER_COLUMNS = ["discount_percentage", "customer_type", "payment_mode",
                  "promotion_applied", "holiday_flag", "revenue", "store_rating", "category"]
CATEGORICAL = ["customer_type", "payment_mode", "category"]
TARGET, ID = "revenue", "transaction_id"
TOP_N = 10

# Sentence templates and thresholds of the explanation text.
STRONG_PCT = 5.0
MODERATE_PCT = 2.0
BOOSTER_TEMPLATE = ("%s %s boosts revenue, contributing an average of +%s per transaction "
                    "(%s%% of average order value).")
REDUCER_TEMPLATE = ("%s %s reduces revenue, associated with a -%s decrease per transaction "
                    "(%s%% of average order value).")
SUMMARY_TEMPLATE = ("Analysis identified %d factors that boost revenue and %d factors that "
                    "reduce it. The top booster is '%s' and the top reducer is '%s'.")
SUMMARY_EMPTY = "Insufficient data for classification."


def driver_rows(star: Star, spec: FilterSpec, with_id: bool = False) -> DataFrame:
    """The analysed columns of every filtered transaction (target as double)."""
    f = enriched(star, spec, [*([ID] if with_id else []), *DRIVER_COLUMNS])
    return f.withColumn(TARGET, F.col(TARGET).cast("double"))


def driver_matrix(rows: DataFrame):
    """One-hot (drop first) the string columns, booleans to 0/1.
    Returns (frame, feature metadata without the target)."""
    enc, meta = one_hot_drop_first(rows, CATEGORICAL)
    enc = bools_to_int(enc)
    return enc, [m for m in meta if m.name != TARGET]


def driver_coding(rows: DataFrame) -> tuple[Coding, DataFrame]:
    """How the driver columns are coded, and the rows with numbers as doubles."""
    numeric = [c for c in DRIVER_COLUMNS if c not in CATEGORICAL and c != TARGET]
    plain = rows.withColumns({c: F.col(c).cast("int").cast("double")
                              if rows.schema[c].dataType.typeName() == "boolean"
                              else F.col(c).cast("double") for c in numeric})
    return fit_coding(plain, numeric, CATEGORICAL), plain


@dataclass
class DriverModel:
    """``plain``: every row as it is coded; ``vectors``: distinct codes with the
    number of rows and sum of the target."""
    plain: DataFrame
    vectors: DataFrame
    model: LeafwiseModel
    explainer: PathExplainer

    @property
    def coding(self) -> Coding:
        return self.model.coding

    @cached_property
    def matrix(self) -> DataFrame:
        """Every row with its codes, in the order of transaction_id.  Written on
        first use: the model and the means of its SHAP values need the vectors
        only.  Rows are put in order before they are coded, as the ranges are
        found by a look at what is to be ordered."""
        n = int(self.plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return materialize(self.coding.encode(self.plain.repartitionByRange(n, ID))
                           .sortWithinPartitions(ID), "driver-matrix")

    def feature_frame(self) -> DataFrame:
        return self.coding.features().select("feature_index", "feature", "source", "level")

    def lookup(self, ids: list[int]) -> DataFrame:
        """The rows of given transactions.  The matrix is sorted by id, so the
        row-group statistics leave one group per id to be read."""
        return self.matrix.where(F.col(ID).isin([int(i) for i in ids]))


def fit_drivers(star: Star, spec: FilterSpec, rounds: int = 500, step_size: float = 0.05,
                max_leaves: int = 31, max_depth: int | None = None, seed: int = 42,
                min_rows: int = 20, feature_fraction: float = 0.8) -> DriverModel:
    """Leaf-wise boosted trees on every filtered row; ``max_depth`` d allows at
    most 2^d leaves.  Rows are joined and written once, coded as they are
    collapsed to vectors."""
    rows = staged_rows(star, spec, [ID, *DRIVER_COLUMNS], "driver-rows")
    rows = rows.withColumn(TARGET, F.col(TARGET).cast("double"))
    if rows.isEmpty():
        raise ValueError("no data for the selected filters")
    coding, plain = driver_coding(rows)
    vectors = materialize(collapse(coding.encode(plain), coding.codes, TARGET), "driver-vectors")
    release_shuffles(rows.sparkSession)
    leaves = max_leaves if max_depth is None else min(max_leaves, 2 ** max_depth)
    model = fit_leafwise(coding, vectors, rounds, step_size, leaves, min_rows, feature_fraction, seed)
    return DriverModel(plain, vectors, model, PathExplainer(model))


def sample_by_id(df: DataFrame, n: int, seed: int = 42, id_col: str = ID) -> DataFrame:
    """A repeatable sample of n rows: those with the smallest digests of (id,
    seed), so that rows with equal contents are chosen apart.  Planned as a
    top-k: each task keeps n candidates, and their merge is the sample."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_h", digest).orderBy("_h", *df.columns).limit(n).drop("_h")


def shap_stats(dm: DriverModel, sample_rows: int | None = None, seed: int = 42) -> DataFrame:
    """feature_index, feature, source, level, mean_shap, mean_abs_shap over all
    rows (default) or over a repeatable sample of ``sample_rows`` rows."""
    vectors = dm.vectors if not sample_rows else materialize(collapse(
        dm.coding.encode(sample_by_id(dm.plain, sample_rows, seed)), dm.coding.codes, TARGET),
        "driver-sample")
    return dm.explainer.feature_stats(vectors)


def rank_and_share(df: DataFrame, value: str, name: str, top: int | None = TOP_N) -> DataFrame:
    """Top rows by value with 1-based Rank and % Contribution (1 dp) of the
    listed total.  The frame is already bounded (one row per feature), so the
    un-partitioned window sorts a handful of rows."""
    w = Window.orderBy(F.desc(value), F.asc(name))
    ranked = df.withColumn("Rank", F.row_number().over(w))
    if top:
        ranked = ranked.filter(F.col("Rank") <= top)
    total = F.sum(value).over(Window.partitionBy(F.lit(0)))
    return ranked.withColumn(
        "pct_contribution",
        F.when(total > 0, F.round(F.col(value) * 100 / total, 1)).otherwise(F.lit(0.0)))


def global_importance(dm: DriverModel, top: int = TOP_N) -> DataFrame:
    """(Feature, SHAP_Importance, Rank, pct_contribution), mean |SHAP| desc."""
    s = shap_stats(dm).select(F.col("feature").alias("Feature"),
                              F.col("mean_abs_shap").alias("SHAP_Importance"))
    return rank_and_share(s, "SHAP_Importance", "Feature", top).orderBy("Rank")


def explain_entries(dm: DriverModel, sample_rows: int | None = None) -> DataFrame:
    """One row per feature: rounded signed / absolute mean SHAP, share of the
    average order value, booster or reducer, and the sentence."""
    avg_rev = F.lit(dm.model.base)      # the mean of the target
    s = shap_stats(dm, sample_rows)
    pct = F.when(avg_rev != 0,
                 F.round(F.col("mean_abs_shap") / avg_rev * 100, 1)).otherwise(F.lit(0.0))
    s = s.withColumn("pct_of_avg_revenue", pct)
    strength = (F.when(F.col("pct_of_avg_revenue") > STRONG_PCT, "strongly")
                 .when(F.col("pct_of_avg_revenue") > MODERATE_PCT, "moderately")
                 .otherwise("slightly"))
    name = feature_display_name(F.col("feature"), F.col("source"), F.col("level"))
    args = [name, strength, money(F.col("mean_abs_shap")),
            F.col("pct_of_avg_revenue").cast("string")]
    booster = F.col("mean_shap") >= 0
    return s.select(
        "feature_index", "feature",
        F.round("mean_shap", 4).alias("shap_value"),
        F.round("mean_abs_shap", 4).alias("abs_importance"),
        "pct_of_avg_revenue",
        F.when(booster, F.format_string(BOOSTER_TEMPLATE, *args))
         .otherwise(F.format_string(REDUCER_TEMPLATE, *args)).alias("interpretation"),
        F.when(booster, "booster").otherwise("reducer").alias("side"))


def explain_summary(entries: DataFrame) -> DataFrame:
    """Counts of boosters / reducers, the strongest of each, and the text.
    Ties on importance go to the earlier feature."""
    key = F.struct(F.col("abs_importance"), -F.col("feature_index"))
    is_b = F.col("side") == "booster"
    s = entries.agg(
        F.count_if(is_b).alias("booster_count"),
        F.count_if(~is_b).alias("reducer_count"),
        F.max_by(F.when(is_b, F.col("feature")), F.when(is_b, key)).alias("top_booster"),
        F.max_by(F.when(~is_b, F.col("feature")), F.when(~is_b, key)).alias("top_reducer"))
    text = F.when((F.col("booster_count") > 0) & (F.col("reducer_count") > 0),
                  F.format_string(SUMMARY_TEMPLATE, "booster_count", "reducer_count",
                                  "top_booster", "top_reducer")).otherwise(F.lit(SUMMARY_EMPTY))
    return s.withColumn("summary", text)


def sorted_entries(entries: DataFrame) -> DataFrame:
    """Boosters first, then reducers, each by absolute importance."""
    return entries.orderBy(F.asc("side"), F.desc("abs_importance"), F.asc("feature_index"))


def local_explanation(dm: DriverModel, ids: list[int]) -> DataFrame:
    """Contributions of given transactions (transaction_id, feature,
    shap_value) with a ``__base__`` row each."""
    return dm.explainer.long(dm.lookup(ids), ID)


def all_values(dm: DriverModel) -> DataFrame:
    """transaction_id, prediction, base_value and values of every transaction.
    The rows are coded as they are read; only look-ups need them in order."""
    return dm.explainer.row_values(dm.coding.encode(dm.plain), ID, vectors=dm.vectors)


def all_explanations(dm: DriverModel) -> DataFrame:
    """The same of every transaction; their distinct codes are the vectors."""
    return dm.explainer.long(dm.coding.encode(dm.plain), ID, dm.vectors)


def analyze_drivers(star: Star, spec: FilterSpec = FilterSpec(), **fit_args) -> dict:
    dm = fit_drivers(star, spec, **fit_args)
    imp = global_importance(dm)
    return {"model": dm, "global_importance": imp}


def shap_explainability(star: Star, spec: FilterSpec = FilterSpec(),
                        sample_rows: int | None = None, **fit_args) -> dict:
    dm = fit_drivers(star, spec, **fit_args)
    entries = explain_entries(dm, sample_rows)
    return {"model": dm, "entries": sorted_entries(entries),
            "summary": explain_summary(entries),
            "importance": global_importance(dm, top=None)}
