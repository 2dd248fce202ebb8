"""Sharding by a k-d tree of weighted medians.

The whole table is split recursively: a node with k shards is cut along the
dimension on which it is widest (its range relative to the range of the whole
table) at the weighted quantile floor(k/2)/k of its bytes (the median for even
k), until every leaf is one shard.  Leaves therefore reach the target of
total bytes / n_shards: the law is ``bytes``.

Only a narrow metadata table (coordinates, size, a tie breaker) is read.  The
quantiles of all nodes of a level are found together: a histogram of bytes
over the key range of each node, then a finer one inside the bin that holds
the cut, and so on.  What comes to the driver is bounded by
nodes x (bins + 1) rows, whatever the size of the table.  A level's node
numbers are written as a column; dimension, range and cut of a node are read
from literal arrays by that number, so rows are assigned without a join.

A key joins the coordinate on the dimension (31 bits) with a hash of the row
and its staged number (31 bits); so a value that holds a third of all rows is
split like any other, also one row that is repeated.  Copies of a text under
other ids are not kept together: the law is about bytes alone.

Cases: a null text has no bytes (size 8, crc32 of nothing: 0); null metadata
sorts first; repeated rows each get a slot; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import lit_or_empty, stage

DIMENSIONS = ["n_chars", "source", "lang", "doc_id"]
HALF = 1 << 31
KEYS = 1 << 62      # keys are below


def coordinates(df: DataFrame, dims: list[str]) -> DataFrame:
    """Adds ``k0``.. : order-preserving long keys in [0, 2^62), one per
    dimension.  Numbers are scaled to the table's range, strings placed by
    crc32; null is lowest."""
    numeric = {c for c, t in df.dtypes if t in ("bigint", "int", "double", "float", "smallint")}
    ends = df.agg(*[F.struct(F.min(d).cast("double"), F.max(d).cast("double")) for d in dims
                    if d in numeric] or [F.lit(0)]).first()
    out, i = {}, 0
    for j, d in enumerate(dims):
        if d in numeric:
            lo, hi = (x or 0.0 for x in ends[i])
            i += 1
            c = 1 + F.floor((F.col(d).cast("double") - lo) / max(hi - lo, 1.0) * (HALF - 2))
        else:
            c = 1 + F.shiftright(F.crc32(F.col(d)), 2)
        out[f"k{j}"] = F.coalesce(c, F.lit(0)).cast("long") * HALF + F.col("tie")
    return df.withColumns(out)


def _by_node(values: list, kind: str) -> Column:
    """``values[node]``.  The array is a literal, so that every pass has the
    same plan text and its code is generated once."""
    return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("node"))


def _key(dims: list[int], n_dims: int) -> Column:
    """The key of the dimension on which a row's node is cut."""
    return F.get(F.array(*[F.col(f"k{j}") for j in range(n_dims)]), _by_node(dims, "int"))


def _cuts(rows: DataFrame, shards: list[int], n_dims: int, bins: int, tolerance: float):
    """Dimension and cut of every node (one level): keys below the cut go left.
    Nodes of one shard, and those without rows, are not cut."""
    keys = [f"k{j}" for j in range(n_dims)]
    stats = {r["node"]: r for r in rows.groupBy("node").agg(
        F.sum("size").alias("bytes"), *[F.min(k).alias(f"lo{k}") for k in keys],
        *[F.max(k).alias(f"hi{k}") for k in keys]).collect()}
    dims, cuts, state = [0] * len(shards), [KEYS] * len(shards), {}
    for i, n in enumerate(shards):
        if n == 1 or i not in stats:
            continue
        s = stats[i]
        d = max(range(n_dims), key=lambda j: (s[f"hik{j}"] // HALF - s[f"lok{j}"] // HALF, -j))
        dims[i] = d
        state[i] = {"lo": s[f"lok{d}"], "hi": s[f"hik{d}"] + 1, "below": 0,
                    "target": s["bytes"] * ((n // 2) / n), "slack": tolerance * s["bytes"] / n}
    keyed = rows.select("node", "size", _key(dims, n_dims).alias("key"))
    while state:
        lo, hi, wide = [0] * len(shards), [0] * len(shards), [1] * len(shards)
        for i, s in state.items():      # other nodes: no key is inside [0, 0)
            lo[i], hi[i], wide[i] = s["lo"], s["hi"], max(1, -(-(s["hi"] - s["lo"]) // bins))
        hist = keyed.where((F.col("key") >= _by_node(lo, "long"))
                           & (F.col("key") < _by_node(hi, "long"))) \
            .withColumn("bin", F.floor((F.col("key") - _by_node(lo, "long"))
                                       / _by_node(wide, "long")).cast("long")) \
            .groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("key").alias("first"),
                                        F.max("key").alias("last")).collect()
        of = {i: [] for i in state}
        for r in sorted(hist, key=lambda r: (r["node"], r["bin"])):
            of[r["node"]].append(r)
        for i, found in of.items():
            s = state[i]
            run = s["below"]
            for r in found:
                if run + r["bytes"] >= s["target"]:
                    break
                run += r["bytes"]
            # The cut is inside [first, last] of bin r, or at one of its ends.
            under, over = s["target"] - run, run + r["bytes"] - s["target"]
            if min(under, over) <= s["slack"] or r["first"] == r["last"]:
                cuts[i] = r["first"] if under <= over else r["last"] + 1
                del state[i]
            else:
                state[i] = s | {"lo": r["first"], "hi": r["last"] + 1, "below": run}
    return dims, cuts


def kd_split(keyed: DataFrame, n_shards: int, n_dims: int, bins: int = 1024,
             tolerance: float = 0.0005) -> DataFrame:
    """keyed + ``shard``: each row's leaf.  A level's node numbers are staged
    as a column, so no plan holds the tree."""
    rows, first, shards = keyed.withColumn("node", F.lit(0)), [0], [n_shards]
    while max(shards) > 1:
        dims, cuts = _cuts(rows, shards, n_dims, bins, tolerance)
        base, below = [], []
        for a, n in zip(first, shards):
            base.append(len(below))
            below += [(a, n)] if n == 1 else [(a, n // 2), (a + n // 2, n - n // 2)]
        right = (_key(dims, n_dims) >= _by_node(cuts, "long")).cast("int")
        rows = stage(rows.withColumn("node", _by_node(base, "int") + right), "kd-level")
        first, shards = [a for a, _ in below], [n for _, n in below]
    return rows.withColumn("shard", _by_node(first, "int")).drop("node")


def shard_documents(docs: DataFrame, n_shards: int = 24, dims: list[str] = DIMENSIONS,
                    rows_per_bucket: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    dims = [d for d in dims if d in docs.columns]
    text = lit_or_empty(F.col("text"))
    meta = docs.select(
        "doc_id", *[d for d in dims if d != "doc_id"],
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    meta = stage(meta.withColumn("tie", F.pmod(
        F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id()),
        F.lit(HALF))), "kd-meta")
    n_rows = meta.count()
    # Slots: number the rows of (shard, bucket) on their own and add the rows
    # of the shard's earlier buckets, so that no task holds a whole shard.
    buckets = max(16, -(-n_rows // (n_shards * rows_per_bucket)))
    placed = kd_split(coordinates(meta, dims), n_shards, len(dims)).select(
        "doc_id", "size", "text_crc32", "tie", "shard",
        F.pmod(F.xxhash64("tie"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id", "text_crc32", "size")
    return (placed.join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.row_number().over(within) - 1).cast("long")
                    .alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
