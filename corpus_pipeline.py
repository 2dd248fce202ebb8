"""A training corpus in five stages: quality rules, near-duplicates,
benchmark decontamination, mixing and sharding.

Each stage gets all documents that its predecessor kept and its decisions take
effect: rejected, repeated and contaminated documents go, the mix repeats or
leaves out documents, the last stage returns every row's shard and slot.
Stages are written as Parquet and read again, so a lost executor costs at most
the running stage.  A stage deletes what the one before it had staged, unless
the given rows still read it.

Cases: those of the operators; the near-duplicate stage decides per row, so
rows that share a doc_id but not a text are documents of their own, null doc_ids
come last in the choice of the row that stays, and of rows equal in all columns
one stays; rows without words are linked with nothing there and all stay; an
empty table passes through all stages.
"""

from __future__ import annotations

import os
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm.common import bounded_broadcast, stage, table
from salescope.llm.decontaminate import drop_contaminated
from salescope.llm.fair_mix import mixed_corpus
from salescope.llm.kd_shards import shard_documents
from salescope.llm.shingle_join import near_duplicates
from salescope.llm.weak_quality import keep_quality
from salescope.session import delete_tables, recorded_tables

# Near-duplicates: five-word shingles, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


# Tables that the stage before has staged, by application.
_BEFORE: dict[str, list[str]] = {}


def step(stage_fn):
    """A stage that first deletes what the stage before had staged (its output
    is written when the next one starts) and records what it stages itself."""
    @wraps(stage_fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        before = _BEFORE.pop(app, [])
        files = docs.inputFiles() if before else []
        # What the given rows still read stays (a caller that has not written them).
        used = [p for p in before if any(f"/{os.path.basename(p)}/" in f for f in files)]
        if not used:
            delete_tables(spark, before)
        with recorded_tables() as paths:
            out = stage_fn(spark, docs, sf_dir)
        _BEFORE[app] = paths + (before if used else [])
        return out
    return run_stage


@step
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs)


@step
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group stays: that with the smallest doc_id, then the
    smallest row key.  Rows meet their decision by a key of all columns, so no
    row number has to be the same in two scans."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    filled = [x for c in columns for x in (c.isNull(), c)]     # hashes skip nulls
    keys = {"key_a": F.xxhash64(F.lit(1), *filled), "key_b": F.xxhash64(F.lit(2), *filled)}
    rows = near_duplicates(docs.select(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id",
        *[v.alias(k) for k, v in keys.items()]).alias("doc_id"), "text"), SHINGLE, PERCENT)
    other = " OR ".join(f"doc_id.{k} <> component_id.{k}" for k in keys)
    decided = stage(rows.where("n_shingles > 0")
                    .groupBy(*[F.col(f"doc_id.{k}").alias(k) for k in keys])
                    .agg(F.max(F.expr(other)).alias("gone"), F.count(F.lit(1)).alias("times"))
                    .where("gone OR times > 1").select(*keys, "gone"), "copies")
    keyed = docs.select(F.struct(*columns).alias("_row"),
                        *[v.alias(k) for k, v in keys.items()])
    known = keyed.join(bounded_broadcast(decided), list(keys), "left")
    once = known.where("gone IS NULL").select("_row.*")
    # Repeated rows that stay: equal rows collapse before they are dealt out.
    again = known.where("NOT gone").groupBy(*keys).agg(F.first("_row").alias("_row"))
    return once.unionByName(again.select("_row.*"))


@step
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@step
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_corpus(docs)


@step
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.col("shard"), F.col("slot"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate),
          ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

# Label model, signature trees and hashed shuffles have no SQL form: tested
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
