"""Relational-database connectors (read and batched append).

Thin helpers over Spark's JDBC data source: a parallel range-partitioned
read (the chunked scan), and an append with 5,000-row batches.  They need a
JDBC driver on the classpath and a reachable database; nothing here is
exercised by the tests, which read Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_SIZE = 5000


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None, partitions: int = 8,
               fetch_size: int = 10_000, properties: dict | None = None) -> DataFrame:
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table) \
        .option("fetchsize", fetch_size)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", partitions))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def append_table(df: DataFrame, url: str, table: str, batch_size: int = BATCH_SIZE,
                 properties: dict | None = None) -> None:
    w = df.write.format("jdbc").option("url", url).option("dbtable", table) \
        .option("batchsize", batch_size).mode("append")
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()
