"""Writers: the star schema, result frames and model state."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.operators.star_build import build_facts, build_products, build_stores
from salescope.session import materialize
from salescope.sources.star import Star, read_star

# Natural keys of the dimensions.
STAR_KEYS = {"stores": ["store_location"],
             "products": ["category", "subcategory", "brand", "unit_price", "stock_on_hand"]}


def write_star(star: Star, path: str, mode: str = "overwrite",
               partitions: int | None = None) -> None:
    """Write the three tables as Parquet; transactions partitioned by day.

    A whole star at a time: its ids hold within one load, and a re-run with
    dynamic partition overwrite replaces the days it holds.  To load further
    files into a written star use ``append_star``.  Facts are
    range-partitioned on (sale_date, transaction_id): each writer task covers
    a few consecutive days (few files per folder), and a day holding a third
    of all rows is split across many tasks instead of landing on one.
    """
    star.stores.write.mode(mode).parquet(os.path.join(path, "stores"))
    star.products.write.mode(mode).parquet(os.path.join(path, "products"))
    write_facts(star.transactions, os.path.join(path, "transactions"), mode, partitions)


def write_facts(tx: DataFrame, path: str, mode: str, partitions: int | None = None) -> None:
    n = partitions or int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "sale_date" not in tx.columns:
        tx = tx.withColumn("sale_date", F.to_date("ts"))
    (tx.repartitionByRange(n, "sale_date", "transaction_id")
       .write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy("sale_date").parquet(path))


def new_members(found: DataFrame, have: DataFrame, name: str, key: str) -> DataFrame:
    """The rows of a dimension that ``have`` lacks by natural key, with ids
    above its present maximum."""
    same = [found[c].eqNullSafe(have[c]) for c in STAR_KEYS[name]]
    last = have.agg(F.max(key)).first()[0] or 0
    new = found.join(have, same, "left_anti").withColumn(key, F.col(key) + last)
    return new.select(*have.columns)


def append_star(clean: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Load further cleaned rows into a star written by ``write_star``; returns
    the rejected rows.

    Stores and products already there keep their ids (a known store keeps its
    rating); only new ones are added, with ids above the present maximum, and
    so are the facts.  Dimensions are written first: after a failure a second
    try finds them by their natural keys, and only facts are added.  Every call
    adds its rows, so load a file once."""
    spark = clean.sparkSession
    clean = materialize(clean, "append-rows")
    old = read_star(spark, path)
    for name, key, have, found in (
            ("stores", "store_id", old.stores, build_stores(clean)),
            ("products", "product_id", old.products, build_products(clean))):
        new_members(found, have, name, key).write.mode("append").parquet(os.path.join(path, name))
    now = read_star(spark, path)
    loaded = build_facts(clean, now.stores, now.products)
    last = old.transactions.agg(F.max("transaction_id")).first()[0]
    facts = loaded.star.transactions
    if last is not None:
        facts = facts.withColumn("transaction_id", F.col("transaction_id") + (last + 1))
    write_facts(facts, os.path.join(path, "transactions"), "append", partitions)
    return loaded.rejected


def write_frames(frames: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write each result frame of an analysis to ``path/<name>`` as Parquet."""
    for name, df in frames.items():
        if isinstance(df, DataFrame):
            df.write.mode(mode).parquet(os.path.join(path, name))


def save_segments(result, path: str) -> None:
    """Persist a segmentation: centres (original units), assignments, and the
    model itself (scaled centres and scaler bounds) so new data can be
    assigned later with ``load_segments``."""
    spark = result.centers.sparkSession
    result.centers.write.mode("overwrite").parquet(os.path.join(path, "centers"))
    result.assignments.write.mode("overwrite").parquet(os.path.join(path, "assignments"))
    model = {"centres": result.scaled_centres, "bounds": result.bounds}
    spark.createDataFrame([(json.dumps(model),)], "model string") \
        .write.mode("overwrite").json(os.path.join(path, "model"))


def load_segments(spark: SparkSession, path: str) -> dict:
    """{'centres': ranked scaled centres, 'bounds': feature -> (min, max)};
    use with ``segments.assign_saved``."""
    m = json.loads(spark.read.json(os.path.join(path, "model")).first()["model"])
    m["bounds"] = {k: tuple(v) for k, v in m["bounds"].items()}
    return m


def save_trees(tm, path: str) -> None:
    """Persist a boosted-tree model with its feature names."""
    tm.model.write().overwrite().save(os.path.join(path, "model"))
    spark = tm.spark
    spark.createDataFrame([(json.dumps(tm.features),)], "features string") \
        .write.mode("overwrite").json(os.path.join(path, "features"))


def load_trees(spark: SparkSession, path: str):
    from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel

    from salescope.operators.trees import TreeModel
    mpath = os.path.join(path, "model")
    meta = spark.read.json(os.path.join(mpath, "metadata")).first()["class"]
    cls = RandomForestRegressionModel if "RandomForest" in meta else GBTRegressionModel
    model = cls.load(mpath)
    feats = json.loads(spark.read.json(os.path.join(path, "features")).first()["features"])
    return TreeModel(model, feats, os.path.join(path, "model"), spark)


def save_forecast(pred: DataFrame, path: str) -> None:
    """Persist forecast output (predictions) as Parquet."""
    pred.write.mode("overwrite").parquet(path)


def save_forecaster(coefs: DataFrame, path: str) -> None:
    """Persist fitted forecast parameters (one row per series, from
    ``forecast.fit_coefficients``)."""
    coefs.write.mode("overwrite").parquet(path)


def load_forecaster(spark: SparkSession, path: str) -> DataFrame:
    """Coefficient table for ``forecast.predict_with_coefficients``."""
    return spark.read.parquet(path)
