"""Incremental loading of raw sales files with Structured Streaming.

Row-wise cleaning rules (text standardisation, critical-field and anomaly
drops, zero discount fill, flag parsing) need no global state, so they run
unchanged on a file stream.  The two rules that need earlier data run per
micro-batch in ``foreachBatch`` with bounded state:

* exact de-duplication: the output is partitioned by ``Date`` (then load and epoch) and
  exact copies share their date, so each batch is anti-joined only with the
  partitions of the dates it contains (a semi-join on the batch's dates
  lets the scan prune the rest);
* median fill of missing ratings: a (rating, count) table — one row per
  distinct rating and epoch — is kept next to the
  output; the median of everything loaded so far comes from it.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.operators.clean import (ZERO_FILL, anomalous, critical_missing,
                                       median_from_counts, standardize_strings)
from salescope.sources.raw import NA_TOKENS, RAW_COLUMNS


def raw_stream(spark: SparkSession, folder: str, columns: list[str],
               max_files: int = 16) -> DataFrame:
    """Stream of raw CSV rows, typed.  A stream needs its schema up front:
    ``columns`` is the files' header, in order (CSV columns are positional)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    s = (spark.readStream.schema(schema).option("header", True)
         .option("maxFilesPerTrigger", max_files).csv(folder))
    cols = []
    for c in columns:
        t = RAW_COLUMNS.get(c, "string")
        v = F.when(F.col(c).isin(*NA_TOKENS), None).otherwise(F.col(c))
        cols.append((v if t == "string" else v.try_cast(t)).alias(c))
    return s.select(*cols)


def clean_rows_stream(raw: DataFrame) -> DataFrame:
    """The row-wise part of cleaning, valid on a stream."""
    std = standardize_strings(raw)
    out = std.filter(~critical_missing(std) & ~anomalous(std))
    return out.withColumn(ZERO_FILL, F.coalesce(F.col(ZERO_FILL), F.lit(0.0)))


def load_id(spark: SparkSession, checkpoint: str) -> str:
    """The query's id, which Spark keeps in the checkpoint: the same over
    restarts, another one with a new checkpoint (whose epochs start at 0)."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def write_epoch(frame: DataFrame, parts: list[str], path: str) -> None:
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*parts).parquet(path)


def start_clean_load(spark: SparkSession, folder: str, columns: list[str], out: str,
                     checkpoint: str, trigger_once: bool = True):
    """Clean new files as they arrive and append distinct rows to ``out``.

    The checkpoint (in the shared folder) makes the load restartable and
    exactly-once per file."""
    cleaned = clean_rows_stream(raw_stream(spark, folder, columns))

    counts_path = out.rstrip("/") + "_rating_counts"

    def load_batch(batch: DataFrame, epoch: int):
        load = load_id(spark, checkpoint)
        keys = [T.StructField("load", T.StringType()), T.StructField("epoch", T.LongType())]
        out_schema = T.StructType(list(batch.schema.fields)
                                  + [T.StructField("rating_filled", T.BooleanType()), *keys])
        # All other loads and this load's earlier epochs count as loaded; what
        # a failed attempt of this epoch left behind is overwritten below.
        loaded = (F.col("load") != load) | (F.col("epoch") < epoch)
        try:
            # Explicit schema: the Date partition values stay the raw text
            # they are (no partition type inference).
            done = spark.read.schema(out_schema).parquet(out).filter(loaded).drop("load", "epoch")
        except AnalysisException:
            done = None
        try:
            hist = spark.read.schema("v double, n long, load string, epoch long") \
                .parquet(counts_path).filter(loaded).select("v", "n")
        except AnalysisException:
            hist = None
        # Exact duplicates are judged on the values as they arrived (a loaded
        # row's rating is null again where it was filled).
        b = batch.dropDuplicates()
        if done is not None:
            dates = b.select("Date").distinct()
            prior = (done.join(dates, "Date", "left_semi")
                         .withColumn("Store_Rating", F.when(F.col("rating_filled"), F.lit(None))
                                     .otherwise(F.col("Store_Rating")).cast("double"))
                         .drop("rating_filled"))
            cond = [b[c].eqNullSafe(prior[c]) for c in b.columns]
            b = b.join(prior, cond, "left_anti")
        b = b.checkpoint(eager=True)  # feeds the counts and the output
        new = (b.filter(F.col("Store_Rating").isNotNull())
                .groupBy(F.col("Store_Rating").alias("v")).agg(F.count(F.lit(1)).alias("n")))
        new = new.checkpoint(eager=True)  # bounded: one row per distinct rating
        counts = new if hist is None else new.unionByName(hist).groupBy("v").agg(
            F.sum("n").alias("n"))
        med = median_from_counts(counts).scalar()
        filled = (b.withColumn("rating_filled", F.col("Store_Rating").isNull())
                   .withColumn("Store_Rating", F.coalesce(F.col("Store_Rating"), med)))
        # An epoch's rows and counts are written under its load and number
        # with overwrite: a retry after a failure at any point gives the same
        # rows and counts, and no other load's rows are touched.
        for frame, parts, path in ((filled, ["Date", "load", "epoch"], out),
                                   (new, ["load", "epoch"], counts_path)):
            write_epoch(frame.withColumns({"load": F.lit(load),
                                           "epoch": F.lit(epoch).cast("long")}), parts, path)

    w = cleaned.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load_batch)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")
    return w.start()
