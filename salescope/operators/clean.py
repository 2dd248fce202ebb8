"""Cleaning of raw sales rows (the first half of the ETL job).

Steps, in order: standardise text, drop rows missing a critical field, drop
negative revenue / price, fill missing ratings with the median and missing
discounts with 0, drop exact duplicates.  Every step is a Catalyst
expression or aggregate; the report counts what each step did in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.functions.text import strip_all, title_case
from salescope.session import checkpoint_dir
from salescope.session import materialize as write_staging

CRITICAL = ("Date", "Timestamp", "Revenue")
NON_NEGATIVE = ("Revenue", "Unit_Price")
MEDIAN_FILL = "Store_Rating"
ZERO_FILL = "Discount_Percentage"
MONEY = ("Revenue", "Unit_Price")
ORDER = "_row"

# Cleaned text that means "missing".
UNKNOWN = "Unknown"
MISSING_TEXT = ("nan", "none", "")      # in any case


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def standardize_text(c: Column) -> Column:
    """null → Unknown, strip, title-case, missing spellings → Unknown.  The
    lambda binds the stripped text, so it is worked out and cased once a row."""
    return F.transform(F.array(_present(c)), lambda s: F.when(
        F.lower(s).isin(*MISSING_TEXT), F.lit(UNKNOWN)).otherwise(title_case(s)))[0]


def _present(c: Column) -> Column:
    return strip_all(F.coalesce(c, F.lit(UNKNOWN)))


def standardize_strings(df: DataFrame) -> DataFrame:
    """``standardize_text`` of the text columns except the critical ones (a null
    date must stay null so the critical-field rule can drop it).  A projection
    per step: each result is worked out once a row, by generated code."""
    cols = string_columns(df, exclude=CRITICAL + (ORDER,))
    missing = [t.capitalize() for t in MISSING_TEXT]
    for step in (_present, title_case,
                 lambda t: F.when(t.isin(*missing), F.lit(UNKNOWN)).otherwise(t)):
        df = df.withColumns({c: step(F.col(c)) for c in cols}) if cols else df
    return df


def critical_missing(df: DataFrame) -> Column:
    present = [c for c in CRITICAL if c in df.columns]
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in present]) if present \
        else F.lit(False)


def anomalous(df: DataFrame) -> Column:
    """Negative revenue or price; a null price fails the comparison too."""
    present = [c for c in NON_NEGATIVE if c in df.columns]
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in present]) \
        if present else F.lit(True)
    return ~ok


def exact_median(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """One-row frame with the exact median of a column (mean of the two middle
    values for an even count), computed without any single-task step.

    1. A partially aggregated group-by reduces rows to (value, count) pairs.
    2. The pairs are range-partitioned by value; each partition's total goes
       into a table with one row per partition (the only global ranking).
    3. Running counts are computed inside each partition and shifted by the
       partition's offset, giving every value its rank interval.
    4. The value(s) whose interval holds the middle rank(s) are averaged.
    """
    vc = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    return median_from_counts(vc, partitions)


def median_from_counts(vc: DataFrame, partitions: int | None = None) -> DataFrame:
    """Exact median from a (v, n) value-count table (steps 2–4 above)."""
    spark = vc.sparkSession
    checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (vc.repartitionByRange(n_parts, "v")
                .withColumn("_p", F.spark_partition_id())
                .checkpoint(eager=True))
    per_part = ranged.groupBy("_p").agg(F.sum("n").alias("_pn"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_p", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # offsets has one row per partition: a proven bound, so broadcast.
    cum = (ranged.join(F.broadcast(offsets), "_p")
                 .withColumn("hi", F.col("_off") + F.sum("n").over(inside))
                 .withColumn("lo", F.col("hi") - F.col("n")))
    total = per_part.agg(F.sum("_pn")).scalar()
    k1 = F.floor((total - 1) / 2)   # 0-based ranks of the middle value(s)
    k2 = F.floor(total / 2)
    pick = cum.filter(((F.col("lo") <= k1) & (k1 < F.col("hi")))
                      | ((F.col("lo") <= k2) & (k2 < F.col("hi"))))
    return pick.agg(
        ((F.min_by("v", "lo") + F.max_by("v", "lo")) / 2).alias("median"))


@dataclass
class CleanResult:
    rows: DataFrame
    report: DataFrame
    median_rating: DataFrame


def clean_sales(raw: DataFrame, materialize: bool = True) -> CleanResult:
    """Run the cleaning steps; ``rows`` keeps ``_row`` as the first position
    at which each distinct cleaned row appeared.

    With ``materialize`` the distinct standardised rows are written once as a
    Parquet staging table in the shared checkpoint folder (``_staged_clean``),
    and the report's counts are metrics observed while it is written, so
    nothing is scanned for the report.  Without it all is lazy and the report
    runs its own aggregates.
    """
    std = standardize_strings(raw)
    data_cols = [c for c in raw.columns if c != ORDER]
    if materialize:
        rows, median, found = _staged_clean(std, data_cols)
        rep = raw.sparkSession.range(1).select(*[
            F.lit(found.get(n) or 0).cast("long").alias(n)
            for n in ("n_in", "n_crit", "n_anom", "n_rating", "n_disc", "n_out")])
        return CleanResult(rows, _report(rep), median)
    flagged = std.withColumn("_crit", critical_missing(std)).withColumn(
        "_anom", ~F.col("_crit") & anomalous(std))
    fine = ~F.col("_crit") & ~F.col("_anom")

    def filled(c):
        return F.count_if(fine & F.col(c).isNull()) if c in raw.columns \
            else F.count_if(F.lit(False))

    counts = [F.count(F.lit(1)).alias("n_in"), F.count_if("_crit").alias("n_crit"),
              F.count_if("_anom").alias("n_anom"), filled(MEDIAN_FILL).alias("n_rating"),
              filled(ZERO_FILL).alias("n_disc")]
    kept = flagged.filter(fine)
    if MEDIAN_FILL in raw.columns:
        median = exact_median(kept, MEDIAN_FILL)
        kept = kept.withColumn(MEDIAN_FILL, F.coalesce(F.col(MEDIAN_FILL), median.scalar()))
    else:
        median = raw.sparkSession.createDataFrame([(None,)], "median double")
    if ZERO_FILL in raw.columns:
        kept = kept.withColumn(ZERO_FILL, F.coalesce(F.col(ZERO_FILL), F.lit(0.0)))
    # Exact duplicates: group on every data column.  Partial aggregation
    # collapses copies inside each task before the shuffle, so a row copied
    # a million times moves once per task.
    rows = kept.groupBy(*data_cols).agg(F.min(ORDER).alias(ORDER)).select(ORDER, *data_cols)
    n_out = F.count(F.lit(1)).alias("n_out")
    rep = flagged.agg(*counts).select("*", rows.agg(n_out).scalar().alias("n_out"))
    return CleanResult(rows, _report(rep), median)


def _staged_clean(std: DataFrame, data_cols: list[str]) -> tuple[DataFrame, DataFrame, dict]:
    """(cleaned rows, median, counts) of standardised rows.

    Rows are collapsed before anything is written: equal ones to one, with
    their number and first position, missing discounts filled.  The median is
    taken over these with their numbers.  Filling it in can only make rows
    equal to those whose rating is the median, so only these and the filled
    ones are collapsed again.  The counts are observed in the tasks that write,
    each of which counts once however often a lost stage is run again."""
    spark = std.sparkSession
    std = std.withColumn("_no_discount", F.col(ZERO_FILL).isNull()).withColumn(
        ZERO_FILL, F.coalesce(F.col(ZERO_FILL), F.lit(0.0))) if ZERO_FILL in data_cols \
        else std.withColumn("_no_discount", F.lit(False))
    kinds = std.groupBy(*data_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_no_discount").alias("_d"),
        F.min(ORDER).alias(ORDER))
    crit = critical_missing(kinds)
    anom = ~crit & anomalous(kinds)
    fine = ~crit & ~anom
    no_rating = F.col(MEDIAN_FILL).isNull() if MEDIAN_FILL in data_cols else F.lit(False)
    seen, left = Observation(), Observation()
    staged = write_staging(kinds.observe(
        seen, F.sum("_n").alias("n_in"), F.sum(F.when(crit, F.col("_n"))).alias("n_crit"),
        F.sum(F.when(anom, F.col("_n"))).alias("n_anom"),
        F.sum(F.when(fine & no_rating, F.col("_n"))).alias("n_rating"),
        F.sum(F.when(fine, F.col("_d"))).alias("n_disc"),
        F.count_if(fine).alias("n_out")), "clean-kinds")
    found, kept, out = seen.get, staged.where(fine), [ORDER, *data_cols]
    if MEDIAN_FILL not in data_cols:
        return kept.select(*out), spark.createDataFrame([(None,)], "median double"), found
    median = median_from_counts(kept.where(~no_rating).groupBy(F.col(MEDIAN_FILL).alias("v"))
                                .agg(F.sum("_n").alias("n")))
    value = median.first()["median"]
    fill = F.lit(value).cast(median.schema["median"].dataType)
    alike = no_rating | F.coalesce(F.col(MEDIAN_FILL) == fill, F.lit(False))
    again = kept.where(alike).withColumn(MEDIAN_FILL, F.coalesce(F.col(MEDIAN_FILL), fill)) \
        .groupBy(*data_cols).agg(F.min(ORDER).alias(ORDER), F.count(F.lit(1)).alias("_n"))
    again = write_staging(again.observe(left, F.sum(F.col("_n") - 1).alias("merged"))
                          .select(*out), "clean-filled")
    found = {**found, "n_out": (found.get("n_out") or 0) - (left.get.get("merged") or 0)}
    return (kept.where(~alike).select(*out).unionByName(again),
            spark.createDataFrame([(value,)], median.schema), found)


def _report(rep: DataFrame) -> DataFrame:
    return rep.withColumn("n_dup", F.expr("n_in - n_crit - n_anom - n_out")).select(F.expr(
        "stack(7, 'input', 0L, 0L, 'standardize_strings', 0L, 0L, "
        "'drop_missing_critical', n_crit, 0L, 'drop_anomalies', n_anom, 0L, "
        "'impute_median_rating', 0L, n_rating, 'impute_zero_discount', 0L, n_disc, "
        "'drop_exact_duplicates', n_dup, 0L) AS (step, rows_removed, cells_filled)"),
        "n_in", "n_out")


def downcast(df: DataFrame, exclude=MONEY) -> DataFrame:
    """Narrowest integer type that holds each integer column, and float for a
    double column whose every value survives the round trip (money columns
    are never touched).  One aggregate decides all columns."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType))
            and f.name not in exclude]
    dbls = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
            and f.name not in exclude]
    if not ints and not dbls:
        return df
    aggs = []
    for c in ints:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max")]
    for c in dbls:
        aggs.append(F.count_if(F.col(c).isNotNull()
                               & (F.col(c).cast("float").cast("double") != F.col(c)))
                    .alias(f"{c}__lossy"))
    st = df.agg(*aggs).first()
    target = {}
    for c in ints:
        lo, hi = st[f"{c}__min"], st[f"{c}__max"]
        if lo is None:
            continue
        for t, a, b in (("tinyint", -128, 127), ("smallint", -32768, 32767),
                        ("int", -2**31, 2**31 - 1)):
            if a <= lo and hi <= b:
                target[c] = t
                break
    for c in dbls:
        if st[f"{c}__lossy"] == 0:
            target[c] = "float"
    return df.select(*[F.col(c).cast(target[c]).alias(c) if c in target else F.col(c)
                       for c in df.columns])
