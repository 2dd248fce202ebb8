"""Repeatable loads of raw files into a star.

A star folder holds a folder per table and a folder of commits:

``{stores,products,transactions,rejected,files}/load=<id>``
    what a load adds; ``files`` is its part of the manifest, one row per file
    with the digest of its content;
``commits/<version>.json``
    the pointer: names the load of that version.

Readers see committed loads only.  A load writes all its folders first and
then commits by one rename that fails if the version is taken, so a load that
dies leaves nothing visible, and of two loads at a time one fails and may be
called again.  A file whose content any committed load has (under any name) is
skipped, so calling a load again adds nothing.

Cases: equal files in one call are loaded once (smallest path); files without
a line are ignored; a call without new files commits nothing; content is
compared as a bag of lines.  Rows are cleaned over the files of one call, as
one raw table; equal rows of different calls are sales of their own.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salescope.operators.clean import clean_sales
from salescope.operators.star_build import build_facts, build_products, build_stores
from salescope.session import materialize
from salescope.sources.raw import read_sales_csv
from salescope.sources.schema import TABLES
from salescope.sources.sinks import new_members, write_facts
from salescope.sources.star import Star

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("lines", T.LongType()),
                      T.StructField("digest", T.StringType())])


@dataclass
class FileLoad:
    version: int | None          # None: nothing new
    loaded: list[str]
    skipped: list[str]
    rejected: DataFrame | None


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, lines, digest) of every file with a line, in one distributed
    pass: lines are hashed twice and the hashes summed, so partial sums of a
    file's blocks combine whatever its size."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")

    def total(seed):
        return F.sum(F.xxhash64(F.lit(seed), "value").cast("decimal(20,0)"))

    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), total(1).alias("a"), total(2).alias("b")).select(
        "path", "lines", F.sha2(F.concat_ws(":", "lines", "a", "b"), 256).alias("digest"))


def committed_loads(spark: SparkSession, root: str, version: int | None = None) -> list[str]:
    """Ids of the committed loads in order (up to ``version``, if given)."""
    folder = _path(spark, os.path.join(root, "commits"))
    if not folder.getFileSystem(_conf(spark)).exists(folder):
        return []
    rows = spark.read.schema("version long, load string").json(folder.toString()).collect()
    return [r.load for r in sorted(rows, key=lambda r: r.version)
            if version is None or r.version <= version]


def read_loaded_star(spark: SparkSession, root: str, version: int | None = None) -> Star:
    """The star of all committed loads, or as it was at ``version``."""
    loads = committed_loads(spark, root, version)
    return Star(*[_read(spark, root, loads, name, TABLES[name])
                  for name in ("stores", "products", "transactions")])


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(path, lines, digest) of every file that has been loaded."""
    return _read(spark, root, committed_loads(spark, root, version), "files", FILES)


def load_files(spark: SparkSession, paths: list[str], root: str,
               read: Callable[[SparkSession, list[str]], DataFrame] = read_sales_csv,
               partitions: int | None = None) -> FileLoad:
    """Clean the files of ``paths`` (files or folders) that are not in the
    manifest and add them to the star at ``root``.  Stores and products
    already there keep their ids, new ones follow.  The names of the files of
    one call are held by the driver, as in any scan."""
    loads = committed_loads(spark, root)
    found = materialize(file_digests(spark, paths), "digests")
    known = _read(spark, root, loads, "files", FILES)
    fresh = materialize(
        found.join(known, "digest", "left_anti")
        .groupBy("digest").agg(F.min_by(F.struct("path", "lines"), "path").alias("f"))
        .select("f.path", "f.lines", "digest"), "new-files")
    loaded = sorted(r.path for r in fresh.select("path").collect())
    skipped = sorted(r.path for r in found.join(fresh, "path", "left_anti").select("path").collect())
    if not loaded:
        return FileLoad(None, [], skipped, None)
    clean = clean_sales(read(spark, loaded)).rows
    load = uuid.uuid4().hex
    dims = {}
    for name, key, build in (("stores", "store_id", build_stores),
                             ("products", "product_id", build_products)):
        have = _read(spark, root, loads, name, TABLES[name])
        new_members(build(clean), have, name, key).write.parquet(_folder(root, name, load))
        dims[name] = _read(spark, root, [*loads, load], name, TABLES[name])
    result = build_facts(clean, dims["stores"], dims["products"])
    old = _read(spark, root, loads, "transactions", TABLES["transactions"])
    last = old.agg(F.max("transaction_id")).first()[0]
    facts = result.star.transactions
    if last is not None:
        facts = facts.withColumn("transaction_id", F.col("transaction_id") + (last + 1))
    write_facts(facts, _folder(root, "transactions", load), "overwrite", partitions)
    rejected = _folder(root, "rejected", load)
    result.rejected.write.parquet(rejected)
    fresh.write.parquet(_folder(root, "files", load))
    version = len(loads) + 1
    commit(spark, root, version, load)
    return FileLoad(version, loaded, skipped,
                    spark.read.schema(result.rejected.schema).parquet(rejected))


def commit(spark: SparkSession, root: str, version: int, load: str) -> None:
    """Make ``load`` the given version: a hidden file, renamed; fails if that
    version exists."""
    folder = os.path.join(root, "commits")
    text = json.dumps({"version": version, "load": load})
    hidden = _path(spark, os.path.join(folder, f"_{load}"))
    fs = hidden.getFileSystem(_conf(spark))
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), _conf(spark))
    no_options = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    target = _path(spark, os.path.join(folder, f"{version:010d}.json"))
    files.rename(fs.makeQualified(hidden), fs.makeQualified(target), no_options)


def _conf(spark: SparkSession):
    return spark._jsc.hadoopConfiguration()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _folder(root: str, name: str, load: str) -> str:
    return os.path.join(root, name, f"load={load}")


def _read(spark: SparkSession, root: str, loads: list[str], name: str,
          schema: T.StructType) -> DataFrame:
    """One scan over the folders of the given loads."""
    if not loads:
        return spark.createDataFrame([], schema)
    found = T.StructType([*schema.fields, T.StructField("load", T.StringType())])
    return (spark.read.schema(found).option("basePath", os.path.join(root, name))
            .parquet(*[_folder(root, name, load) for load in loads]).select(*schema.names))
