"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a hashed order, twice over (a
document may be used ``max_repeat`` times).  A copy's virtual finish time is
the number of tokens its source has sent up to and including it, divided by
the source's weight.  Serving copies in order of finish time and stopping at
the token budget gives every source tokens in proportion to its weight; a
source that runs out leaves its share to the others, which is the resharing
rule of the targets.

Cumulative tokens are prefix sums in two levels, (source, bucket of the hash)
and the rows of one bucket, so a source with a third of all rows is spread
over many tasks.  The global order is a range sort; the copy at which the
budget is reached is found from the sums of the ranges and a running sum in
the one range that holds it.  Taking is then a comparison with that copy's
key, without a join.

Cases: null text has size 0 and is taken 0 times; null source is a source of
its own, last; equal finish times are ordered by source, hash and pass;
repeated rows are separate documents; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import lit_or_empty, shuffle_partitions, stage, words
from salescope.operators.star_build import dense_index

WEIGHTS = [5.0, 2.0, 1.0]


def source_targets(meta: DataFrame, weights: list[float], share: float,
                   max_repeat: int) -> tuple[DataFrame, float]:
    """One row per source (rank, size, weight, target) and the budget.

    Targets: budget in proportion to weight; a source above ``max_repeat``
    times its size is held there and the rest is shared again, until none is
    above.  Each round is one aggregate over the small table of sources."""
    sizes = meta.groupBy("source").agg(F.sum("size").alias("source_size")) \
                .withColumn("_last", F.col("source").isNull())
    ranked = stage(dense_index(sizes, ["_last", "source"], "rank").drop("_last"), "mix-sources")
    n = F.pmod(F.col("rank") - 1, F.lit(len(weights)))
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(n == i, w).otherwise(weight)
    src = ranked.withColumn("weight", weight) \
                .withColumn("most", (max_repeat * F.col("source_size")).cast("double"))
    budget = share * float(src.agg(F.sum("source_size")).first()[0] or 0)
    rate, held = 0.0, -1
    while True:
        full = F.col("most") < F.col("weight") * F.lit(rate)
        row = src.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most"))),
                      F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == held:
            break
        held = row[0]
        rate = (budget - (row[1] or 0.0)) / row[2] if row[2] else rate
    target = F.least("most", F.col("weight") * F.lit(rate))
    return src.withColumn("target", target), budget


def numbered(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """rows + ``_copy``: equal rows numbered from 0, so that one repeated row
    is hashed apart like others, the same in every run.  Equal rows collapse
    before the shuffle and are dealt out again chunk by chunk."""
    per = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_rows"))
    parts = per.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_rows - 1) div {chunk})")))
    return parts.withColumn("_copy", F.explode(F.expr(
        f"sequence(_chunk * {chunk}, least(_rows, (_chunk + 1) * {chunk}) - 1)"))) \
        .drop("_rows", "_chunk")


def fair_queue(docs: DataFrame, size: Column, weights: list[float] = WEIGHTS, share: float = 1.5,
               max_repeat: int = 2, seed: int = 17, rows_per_bucket: int = 2048,
               keep: list[Column] | None = None) -> DataFrame:
    """One row per document: ``keep`` columns, size, source_size, target and
    ``copies`` (how often the mix takes it)."""
    keep = keep if keep is not None else [F.col("doc_id")]
    rows = docs.select(
        *keep, F.col("source").alias("_source"), size.cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h")) \
        .withColumnsRenamed({"_source": "source", "_size": "size"})
    names = [c for c in rows.columns if c not in ("source", "size", "_h")]
    meta = stage(numbered(rows).withColumn("_h", F.xxhash64("_h", "_copy")).drop("_copy"),
                 "mix-meta")
    src, budget = source_targets(meta, weights, share, max_repeat)
    buckets = max(256, -(-meta.count() // rows_per_bucket))
    meta = meta.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))

    # Tokens of the source in earlier buckets, next to the source's own row.
    per = meta.groupBy("source", "_b").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per.withColumnRenamed("source", "_s")
               .join(src, F.col("_s").eqNullSafe(F.col("source")))
               .select("_s", F.col("_b").alias("_ob"), "rank", "weight", "source_size", "target",
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("source", "_b").orderBy("_h", *names) \
                   .rowsBetween(Window.unboundedPreceding, 0)
    queued = stage(
        meta.join(offsets, F.col("source").eqNullSafe(F.col("_s"))
                  & (F.col("_b") == F.col("_ob")))
        .withColumn("_sent", F.col("offset") + F.sum("size").over(within))
        .withColumn("_n", F.row_number().over(within))
        .drop("_s", "_ob", "offset"), "mix-queue")

    def finish(k: Column) -> Column:
        """Virtual finish time of pass ``k`` over the source."""
        return (k * F.col("source_size") + F.col("_sent")) / F.col("weight")

    key = ["time", "rank", "_b", "_n", "pass"]
    copies = (queued.withColumn("pass", F.explode(F.array(*map(F.lit, range(max_repeat)))))
              .select(finish(F.col("pass")).alias("time"), "rank", "_b", "_n", "pass", "size"))
    n = shuffle_partitions(docs.sparkSession)
    ordered = stage(copies.repartitionByRange(n, *key).sortWithinPartitions(*key)
                    .withColumn("part", F.spark_partition_id()), "mix-order")
    last = last_within(ordered, key, budget)
    if last is None:
        taken = F.lit(0)
    else:
        def upto(k: int) -> Column:
            mine = F.struct(finish(F.lit(k)).alias("time"), "rank", "_b", "_n",
                            F.lit(k).alias("pass"))
            return (mine <= F.struct(*[F.lit(last[c]).cast(t).alias(c)
                                       for c, t in copies.dtypes if c in key])).cast("int")
        taken = sum((upto(k) for k in range(max_repeat)), F.lit(0))
    return queued.select(*names, "size", "source_size", "target", taken.alias("copies"))


def last_within(ordered: DataFrame, key: list[str], budget: float):
    """Key of the last copy whose running total of ``size`` is within the
    budget, or None.  ``ordered`` is staged, range-partitioned by ``key`` and
    carries its range number in ``part`` (one row per range is ranked)."""
    parts = ordered.groupBy("part").agg(F.sum("size").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.select("part", "n", F.sum("n").over(w).alias("end"))
    edge = ends.where(F.col("end") > F.lit(budget)).orderBy("part").limit(1).first()
    rows = ordered if edge is None else ordered.where(F.col("part") <= edge["part"])
    if edge is not None:
        inside = ordered.where(F.col("part") == edge["part"])
        run = F.sum("size").over(Window.partitionBy("part").orderBy(*key)
                                 .rowsBetween(Window.unboundedPreceding, 0))
        cut = (inside.withColumn("_run", run + F.lit(edge["end"] - edge["n"]))
               .where(F.col("_run") <= F.lit(budget)))
        best = cut.agg(F.max(F.struct(*key))).first()[0]
        if best is not None:
            return best
        rows = ordered.where(F.col("part") < edge["part"])
    return rows.agg(F.max(F.struct(*key))).first()[0]


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    mixed = fair_queue(docs, F.size(words(F.col("text"))))
    return mixed.select("doc_id", "size", "source_size",
                        F.col("target").cast("double").alias("target"),
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_corpus(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns, one row per copy taken.  The
    rows travel through the queue as a key and meet their texts again."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    mixed = fair_queue(docs, F.size(words(F.col("text"))), keep=[F.col("doc_id"), key.alias("_k")])
    # Equal rows are interchangeable: one of them stands for the copies of all.
    copies = mixed.where("copies > 0 AND size > 0").groupBy("doc_id", "_k").agg(
        F.sum("copies").cast("int").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col("doc_id").alias("_id"), key.alias("_key")) \
               .dropDuplicates(["_id", "_key"])
    return (rows.join(copies, F.col("_id").eqNullSafe(F.col("doc_id"))
                      & (F.col("_key") == F.col("_k")))
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_c"))
            .select("_row.*"))
