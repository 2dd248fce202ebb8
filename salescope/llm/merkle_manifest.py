"""Merkle manifest of a dataset, its leaves placed by bitmap ranks.

Every row is a leaf: the digest of its columns.  Where a leaf stands in the
tree of its group (``lang``) is a rank query on a bitmap of the group's
doc_ids, so no group is ever sorted: partial bitmaps (32-bit words of a
compressed bitmap: empty words are not stored) are OR-merged per group by one
aggregate, a popcount directory of fan-out 4,096 gives the number of rows
before each word, and a row adds the bits below its own.  Ids that occur more
than once carry their numbers beside the bits; rows that share an id are ranked
in the same way by the first 60 bits of their digest.

Rank r is slot r mod 512 of block r div 512.  A block is one row with a slot
array, reduced three levels at once; blocks of digests are reduced further in
the same way.  A row's siblings are those of its block, then those of the block
in the next table, and so on, joined top down; no task holds more than one
block, however large a group is.

Cases: null columns count as ``-``; null doc_ids come first and are never
tampered with; rows with the same doc_id are ordered by their leaves, and equal
rows are leaves of their own; a single row is its own subroot, a single group's
subroot its own root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import ascii_lower, ship_package, stage
from salescope.operators.star_build import dense_index

RUN = 8                 # nodes below one parent
LEVELS = 3              # levels that one block of slots reduces
WORD_BITS, FAN_BITS = 5, 12
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


# ------------------------------------------------------------------ leaves

def leaf(columns: list[Column]) -> Column:
    """Digest of a row: ``-`` or length, colon and value of each column."""
    return F.sha2(F.concat(*[
        F.when(c.isNull(), F.lit("-"))
         .otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
        for c in (c.cast("string") for c in columns)]), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """g, doc_id, leaf, changed (the leaf after tampering, else null), n: equal
    rows once with their number."""
    columns = [F.col(c) for c in FIELDS]
    later = [*columns[:-1], ascii_lower(columns[-1])]
    return docs.select(
        group_key(F.col("lang")).alias("g"), "doc_id", leaf(columns).alias("leaf"),
        F.when(tampered(F.col("doc_id")), leaf(later)).alias("changed")) \
        .groupBy("g", "doc_id", "leaf", "changed").agg(F.count(F.lit(1)).alias("n"))


def group_key(lang: Column) -> Column:
    """Sorts like ``lang`` with null first, and joins null to null."""
    return F.coalesce(F.concat(F.lit("+"), lang), F.lit(""))


# ------------------------------------------------------- ranks from bitmaps

def bitmaps(rows: DataFrame, group: list[str], key: Column) -> DataFrame:
    """The bitmap of the keys of every group, one row per word that is not
    empty: bits, total (rows in it) and the keys that occur more than once.

    ``key`` may be null, which counts as lower than all; adds nothing to rows.
    """
    keys = rows.groupBy(*group, key.alias("key")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    low = F.col("key").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    repeat = F.struct(F.coalesce(low, F.lit(0)).alias("low"), (F.col("n") - 1).alias("more"),
                      F.col("kinds"))
    return keys.groupBy(*group, F.shiftright("key", WORD_BITS).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, coalesce(cast(key & 31 as int), 0))")).alias("bits"),
        F.sum("n").alias("total"),
        F.collect_list(F.when(F.col("n") > 1, repeat)).alias("repeats"))


def directory(words: DataFrame, group: list[str]) -> DataFrame:
    """words + ``before``: the rows of the group in earlier words.  Words of a
    fan of 4,096 are summed up tier by tier until one fan holds a whole group,
    so that no window holds more than a fan, however the ids are spread."""
    ends = words.agg(F.min("word"), F.max("word")).first()
    if ends[0] is None:     # no rows, or only null keys
        return words.withColumns({"word": F.lit(0).cast("long"),
                                  "before": F.lit(0).cast("long")})
    first, last = ends[0] - 1, ends[1]
    words = words.withColumn("word", F.coalesce("word", F.lit(first)))
    tiers = [words]
    while (last >> FAN_BITS * (len(tiers) - 1)) - (first >> FAN_BITS * (len(tiers) - 1)) \
            >= 1 << FAN_BITS:
        tiers.append(tiers[-1].groupBy(*group, F.shiftright("word", FAN_BITS).alias("word"))
                     .agg(F.sum("total").alias("total")))
    top = Window.partitionBy(*group).orderBy("word").rowsBetween(
        Window.unboundedPreceding, -1)
    above = tiers.pop().withColumn("before", F.coalesce(F.sum("total").over(top), F.lit(0)))
    while tiers:
        fan = Window.partitionBy(*group, "fan").orderBy("word").rowsBetween(
            Window.unboundedPreceding, -1)
        inside = tiers.pop().withColumn("fan", F.shiftright("word", FAN_BITS)) \
            .withColumn("inside", F.coalesce(F.sum("total").over(fan), F.lit(0)))
        above = inside.join(above.select(*group, F.col("word").alias("fan"), "before"),
                            [*group, "fan"]) \
            .withColumn("before", F.col("before") + F.col("inside")).drop("fan", "inside")
    return above


def with_rank(rows: DataFrame, group: list[str], key: Column, name: str) -> DataFrame:
    """rows + ``name`` (rows of the group whose key is lower) and ``kinds``
    (rows given that share the key)."""
    words = stage(bitmaps(rows, group, key), f"merkle-bitmap-{name}")
    words = directory(words, group)
    ends = words.agg(F.min("word")).first()[0] or 0
    low = F.coalesce(key.bitwiseAND((1 << WORD_BITS) - 1).cast("int"), F.lit(0))
    return (rows.withColumn("word", F.coalesce(F.shiftright(key, WORD_BITS), F.lit(ends)))
            .withColumn("low", low).join(words, [*group, "word"])
            .withColumn(name, F.expr(
                "before + bit_count(bits & ~shiftleft(-1L, low)) + aggregate(filter(repeats, "
                "x -> x.low < low), 0L, (s, x) -> s + x.more)"))
            .withColumn("kinds", F.expr("coalesce(try_element_at(filter(repeats, "
                                        "x -> x.low = low), 1).kinds, 1L)"))
            .drop("word", "low", "bits", "total", "repeats", "before"))


def placed(rows: DataFrame) -> DataFrame:
    """rows of :func:`leaves` + ``rank`` in their group."""
    ranked = stage(with_rank(rows, ["g"], F.col("doc_id").cast("long"), "rank"), "merkle-ranks")
    once = ranked.where("kinds = 1").drop("kinds")
    shared = ranked.where("kinds > 1").drop("kinds")
    if shared.isEmpty():
        return once
    # Ids of several rows: by the first 60 bits of the leaf, then by the leaf.
    prefix = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    shared = shared.withColumn("same", F.struct("g", "doc_id"))
    near = with_rank(shared, ["same"], prefix, "inside")
    equal = Window.partitionBy("same", prefix).orderBy("leaf").rowsBetween(
        Window.unboundedPreceding, -1)
    after = near.withColumn("rank", F.col("rank") + F.col("inside")
                            + F.coalesce(F.sum("n").over(equal), F.lit(0)))
    return once.unionByName(after.drop("inside", "kinds", "same"))


# -------------------------------------------------------------------- trees

def h(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def tree(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The nodes level by level: up to ``levels`` above the given ones, or
    until one is left."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([h("".join(out[-1][i:i + RUN])) for i in range(0, len(out[-1]), RUN)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The digests left and right of node i and of its parents."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % RUN
        run = nodes[first:first + RUN]
        out.append(("".join(run[:i - first]), "".join(run[i - first + 1:])))
        i //= RUN
    return out


def slot_blocks(nodes: DataFrame, levels: int, size: Column) -> DataFrame:
    """g, block, whole (the block is the whole group), slots: rows (g, rank,
    n, ...) dealt into slot arrays.  ``size`` is the number of nodes of g."""
    width = RUN ** levels
    other = [c for c in nodes.columns if c not in ("g", "rank", "n", "size")]
    spread = nodes.withColumn("whole", size <= width).withColumn("block", F.explode(F.expr(
        f"sequence(rank div {width}, (rank + n - 1) div {width})")))
    at = F.greatest(F.col("rank"), F.col("block") * width)
    end = F.least(F.col("rank") + F.col("n"), (F.col("block") + 1) * width)
    return spread.groupBy("g", "block", "whole").agg(F.collect_list(F.struct(
        (at - F.col("block") * width).cast("int").alias("slot"),
        (end - at).cast("int").alias("times"), *other)).alias("slots"))


def _filled(slots) -> list:
    """Slot array of a block (an Arrow list of structs): row numbers by slot."""
    at, times = slots.field("slot").to_pylist(), slots.field("times").to_pylist()
    out = [0] * sum(times)
    for row, (s, n) in enumerate(zip(at, times)):
        out[s:s + n] = [row] * n
    return out


def _block_rows(batch: pa.RecordBatch):
    lists = batch.column(batch.schema.get_field_index("slots"))
    for i in range(len(batch)):
        slots = lists[i].values
        rows = _filled(slots)
        digests = slots.field("digest").to_pylist()
        yield i, slots, rows, [digests[r] for r in rows]


def block_roots(blocks: DataFrame, levels: int) -> DataFrame:
    """g, rank, digest: the digest of every block as a node of the next table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(2).to_pylist()
            roots = [tree(d, None if whole[i] else levels)[-1][0]
                     for i, _, _, d in _block_rows(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(roots, pa.string())],
                                             names=["g", "rank", "digest"])
    return blocks.select("g", "block", "whole", "slots").mapInArrow(
        run, "g string, rank long, digest string")


PATH = "array<struct<left: string, right: string>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _pairs(path: list[dict]) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in path]


def child_paths(blocks: DataFrame, levels: int) -> DataFrame:
    """g, block, path, subroot, root of the children of blocks that have these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, block, whole, path, sub, root = (b.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6))
            for i, _, _, digests in _block_rows(b):
                nodes, up = tree(digests, None if whole[i] else levels), _pairs(path[i])
                n, first = len(digests), block[i] * RUN ** levels
                paths = [[{"left": x, "right": y} for x, y in siblings(nodes, k) + up]
                         for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[i]] * n), pa.array(range(first, first + n), pa.int64()),
                     pa.array(paths, PATH_TYPE), pa.array([sub[i]] * n), pa.array([root[i]] * n)],
                    names=["g", "block", "path", "subroot", "root"])
    return blocks.select("g", "block", "whole", "slots", "path", "subroot", "root").mapInArrow(
        run, f"g string, block long, path {PATH}, subroot string, root string")


def proofs(blocks: DataFrame, levels: int, id_type: str) -> DataFrame:
    """The rows of the contract, from leaf blocks with the paths above them."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, path, sub, root = (b.column(k).to_pylist() for k in (2, 4, 5, 6))
            for i, slots, rows, digests in _block_rows(b):
                nodes, up = tree(digests, None if whole[i] else levels), _pairs(path[i])
                changed = slots.field("changed").to_pylist()
                proof, folded = [], []
                for k, row in enumerate(rows):
                    pairs = siblings(nodes, k) + up
                    proof.append(h("".join([x + y for x, y in pairs])))
                    d = changed[row] or digests[k]
                    for x, y in pairs:
                        d = h(x + d + y)
                    folded.append(d)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [slots.field("doc_id").take(pa.array(rows, pa.int64())), pa.array(digests, pa.string()),
                     pa.array([sub[i]] * n, pa.string()), pa.array([root[i]] * n, pa.string()),
                     pa.array(proof, pa.string()), pa.array(folded, pa.string())], names=names)
    return blocks.select("g", "block", "whole", "slots", "path", "subroot", "root").mapInArrow(
        run, f"doc_id {id_type}, " + ", ".join(f"{c} string" for c in names[1:])) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def _reduced(nodes: DataFrame, size: DataFrame, levels: int):
    """Block tables from the leaves up, and each group's root (g, digest).
    ``size`` has the number of nodes of every group."""
    most = size.agg(F.max("size")).first()[0] or 0
    tables, roots, width = [], None, RUN ** levels
    while True:
        blocks = stage(slot_blocks(nodes.join(size, "g"), levels, F.col("size")),
                       f"merkle-blocks-{len(tables)}")
        up = stage(block_roots(blocks, levels), f"merkle-nodes-{len(tables)}")
        tables.append(blocks)
        size = size.select("g", F.ceil(F.col("size") / F.lit(width)).alias("size"))
        done = up.join(size.where("size = 1"), "g").select("g", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= width:
            return tables, roots
        most = -(-most // width)
        size = size.where("size > 1")
        nodes = up.join(size.select("g"), "g", "left_semi").withColumn("n", F.lit(1).cast("long"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of
    every row; blocks of RUN ** levels slots."""
    ship_package(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(leaves(docs), "merkle-leaves")
    size = stage(rows.groupBy("g").agg(F.sum("n").alias("size")), "merkle-sizes")
    nodes = placed(rows).withColumnRenamed("leaf", "digest")
    tables, roots = _reduced(nodes, size, levels)
    roots = stage(roots, "merkle-subroots")
    # The groups in order are the nodes of one more tree.
    top = dense_index(roots, ["g"], "rank").select(
        F.lit("").alias("g"), (F.col("rank") - 1).alias("rank"), F.lit(1).cast("long").alias("n"),
        "digest", F.col("g").alias("name"))
    top = stage(top, "merkle-top")
    one = top.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    above, root = _reduced(top.drop("name"), one, levels)
    empty = F.array().cast(PATH)
    paths = root.select("g", F.lit(0).cast("long").alias("block"), empty.alias("path"),
                        F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(above):
        paths = child_paths(blocks.join(paths, ["g", "block"]), levels)
    start = stage(top.join(paths.withColumnRenamed("block", "rank").drop("subroot"), ["g", "rank"])
                  .select(F.col("name").alias("g"), F.lit(0).cast("long").alias("block"), "path",
                          F.col("digest").alias("subroot"), "root"), "merkle-tops")
    # Top down: groups that end in a table enter there, others come from above.
    paths = None
    for blocks in reversed(tables):
        here = start.join(blocks.where("whole").select("g"), "g", "left_semi")
        paths = here if paths is None else here.unionByName(paths)
        known = blocks.join(paths, ["g", "block"])
        if blocks is tables[0]:
            return proofs(known, levels, id_type)
        paths = stage(child_paths(known, levels), "merkle-paths")
