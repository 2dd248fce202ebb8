"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.session import materialize, scratch_path, ship_package

__all__ = ["stage", "scratch_path", "ship_package", "table", "let", "ascii_lower", "words",
           "lit_or_empty", "bounded_broadcast", "WHITESPACE", "shuffle_partitions"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the white space of the word rule [^\x20\x09-\x0D]+.
WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one input table (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """``materialize``, after which the shuffle files behind ``df`` are given
    back: nothing reads them once the rows are written, but Spark removes them
    only when the driver collects garbage, by default every 30 minutes, so a
    chain of staged steps would keep the files of all its steps on disk."""
    out = materialize(df, name, by)
    df.sparkSession._jvm.System.gc()
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is bound to the evaluated value, whereas a plain column
    reference inside a higher-order function may be inlined by the optimizer
    and then evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters are left alone (unlike ``lower``)."""
    return F.translate(c, UPPER, LOWER)


def lit_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-white-space; null and blank give []."""
    trimmed = F.btrim(lit_or_empty(text), F.lit(WHITESPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>"))
               .otherwise(F.split(t, "[ \\x09-\\x0D]+")))


def bounded_broadcast(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Broadcast a *staged* frame if its files are at most ``max_bytes``;
    beyond that it is returned as it is and the join shuffles."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name)


def text_slices(batch, column: int, max_bytes: int = 4 << 20):
    """Cuts an Arrow batch into slices of about ``max_bytes`` of text (one row
    at least), so that working arrays stay bounded whatever the row sizes."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def utf8(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    import pyarrow as pa
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
