"""Feature preparation: one-hot (drop first), bool→int, min-max scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEVELS = 1000


@dataclass(frozen=True)
class EncodedColumn:
    """One model input column; ``source``/``level`` are set for one-hot columns."""

    name: str
    source: str
    level: str | None = None


def category_levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null levels of each string column, in one job.

    The level lists define the output schema, so they come to the driver.
    (column, value) pairs go through one distinct (a shuffle aggregate, no
    per-task set) stopped after (MAX_LEVELS + 1) × columns pairs: if that
    many arrive, some column has more than MAX_LEVELS levels and this raises
    instead of flooding the driver.  Nothing is capped.
    """
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols]))
        .alias("p")).select("p.k", "p.v").where(F.col("v").isNotNull()).distinct()
    cap = (MAX_LEVELS + 1) * len(cols)
    got = pairs.limit(cap).collect()
    out = {c: [] for c in cols}
    for r in got:
        out[r.k].append(r.v)
    for c, vals in out.items():
        if len(vals) > MAX_LEVELS or len(got) >= cap:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        vals.sort()
    return out


def one_hot_drop_first(df: DataFrame, cols: list[str],
                       levels: dict[str, list[str]] | None = None):
    """``col_level`` 0/1 columns for every level but the first (sorted);
    null gives all zeros.  Encoded columns follow the other columns, in the
    order of ``cols``.  Returns (frame, [EncodedColumn])."""
    levels = levels if levels is not None else category_levels(df, cols)
    keep = [c for c in df.columns if c not in cols]
    exprs: list[Column] = [F.col(c) for c in keep]
    meta = [EncodedColumn(c, c) for c in keep]
    for c in cols:
        for lv in levels[c][1:]:
            name = f"{c}_{lv}"
            exprs.append(F.when(F.col(c) == F.lit(lv), 1).otherwise(0).alias(name))
            meta.append(EncodedColumn(name, c, lv))
    return df.select(*exprs), meta


def bools_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("int").alias(f.name)
                       if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
                       for f in df.schema.fields])


def min_max_bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``{c}_min``, ``{c}_max`` per column."""
    return df.agg(*[e for c in cols for e in (F.min(c).alias(f"{c}_min"),
                                              F.max(c).alias(f"{c}_max"))])


def min_max_scale(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """(x - min) / (max - min) per column, 0 for a constant column.

    The bounds are one aggregate row (2 numbers per column), resolved once
    and inlined as literals, so the scaled frame is a plain projection: no
    join, no window over all rows, no subquery re-running the input.
    """
    b = min_max_bounds(df, cols).first()
    out = []
    for c in cols:
        lo, hi = b[f"{c}_min"], b[f"{c}_max"]
        if lo is None or hi is None or hi == lo:
            out.append(F.lit(0.0).alias(c + suffix))
        else:
            out.append(F.coalesce((F.col(c) - F.lit(float(lo))) / F.lit(float(hi - lo)),
                                  F.lit(0.0)).alias(c + suffix))
    return df.select("*", *out)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)
