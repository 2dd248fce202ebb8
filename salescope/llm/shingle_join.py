"""N-gram Jaccard self-join with signature trees.

A document's set holds its distinct n-word shingles.  Two documents are linked
when ``100 * |intersection| >= percent * |union|``; the result is the linked
component of every document.

1. Documents with equal sets collapse to one representative.
2. Buckets.  (a) Every representative enters the buckets of its SEEDS smallest
   shingles; near-copies almost always meet there.  (b) By the prefix
   principle, two linked sets share one of their first n - ceil(t n) + 1
   shingles in *any* common order, so the buckets of all prefix shingles find
   every remaining link; only buckets that still hold several components and
   members whose sizes and places of the shingle allow a link are opened.  Any order is exact; shingles met in many
   documents come last in it, so a common line or passage opens no buckets.
3. In a bucket, a signature tree: leaves are members in size order, nodes hold
   the OR of their token bitmaps, their size range and their largest bitmap
   collision count.  Pairs of nodes are traversed together and dropped when
   sizes or the largest possible overlap cannot reach the threshold, or when
   all members are already linked.  For (b) the trees run on stored bitmaps
   first, of a short prefix (of which half must be shared), then of all tokens,
   and only members of surviving pairs fetch their texts.  Surviving
   pairs are compared exactly and only links that join two components are
   returned (a spanning forest), so a group of m near-copies gives m - 1 links,
   not m^2.
4. Components by min-label propagation with pointer jumping over staged tables.

Buckets of (a) above BUCKET_ROWS members are dealt into chunks that share one
pivot member; what that leaves apart (b) still finds.

Cases: a null or wordless text has an empty set (n_shingles 0) and is linked
with nothing; fewer than n words make one shingle; texts are read whole; repeated rows and equal
texts are one component, named by the smallest doc_id; a null doc_id names
nothing (component_id is null only if all its members' ids are); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import bounded_broadcast, ship_package, stage, text_slices, utf8
from salescope.session import delete_tables, recorded_tables

SEEDS = 3
BUCKET_ROWS = 4096
LEAF = 16
SLICES = 8              # parts in which the prefixes are exploded and grouped
CELLS = 4               # size cells per largest ratio of linked sizes
SPAN = CELLS + 4         # (a reach of 0 to CELLS + 2 in the last digit)
HOT_DOCS = 2000         # a shingle in more than 1 / HOT_DOCS of the documents comes last
MOST_HOT = 100_000      # (bounds what is sent to tasks; the order alone depends on it)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                        0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                        0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordHash(dict):
    """64-bit hash by word, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], n: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole], np.uint64)
    return np.unique(runs(words, n, hashes))


def runs(words: list[bytes], n: int, hashes: WordHash) -> np.ndarray:
    """Hash of every n consecutive words."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    s = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        s += h[i:len(h) - n + 1 + i] * MULTIPLIERS[i % len(MULTIPLIERS)]
        s ^= s >> np.uint64(31)
    s *= MULTIPLIERS[0]
    return s ^ (s >> np.uint64(29))


def least_overlap(size, percent: int):
    """Shingles that a set of this size shares with any linked set, at least."""
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int) -> int:
    """Shingles among which a linked set must share one."""
    return size - least_overlap(size, percent) + 1


# Signatures hold so many times the prefix length of a set's first shingles.
SHORT, WHOLE = 2, 1 << 30


def signature_length(size: int, percent: int, times: int) -> tuple[int, int]:
    """(k, l): the first k shingles hold at least l of a linked set's (the
    prefix principle for l instead of one, at a greater length)."""
    p = prefix_length(size, percent)
    k = min(size, times * (p - 1) + 1)
    return k, k - p + 1


# ------------------------------------------------------------ frequent shingles

def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that occur more often than once in HOT_DOCS documents, by a
    lower bound: tasks report those that are frequent among their own
    documents.  Only hashes in the lowest quarter are counted, as prefixes are
    made of the smallest hashes.  (What is found changes the order of the
    prefixes, never the result.)"""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHash(), 0
        keys, sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        for big in batches:
            for batch in text_slices(big, 0):
                words = b" ".join(utf8(batch.column(0))).lower().split()
                rows += batch.num_rows
                if len(words) < n:
                    continue
                s = runs(words, n, hashes)
                k, c = np.unique(s[s < np.uint64(1 << 62)], return_counts=True)
                k, c = k[c > 1], c[c > 1]
                both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, c]), len(both)).astype(np.int64)
                keys = both
        often = sums >= max(3, rows // (HOT_DOCS // 4))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[often].view(np.int64)), pa.array(sums[often])], names=["s", "n"])

    total = docs.count()
    rows = (docs.select("text").mapInArrow(count, "s long, n long").groupBy("s")
            .agg(F.sum("n").alias("n")).where(F.col("n") * HOT_DOCS > total)
            .orderBy(F.desc("n"), "s").limit(MOST_HOT).select("s").toArrow())
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


# --------------------------------------------------------------------- entries

def entries(docs: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """Per row: row, doc_id, key (digest of its set), size, seeds, prefix,
    bitmaps of all its tokens and of a short prefix, and the compressed words."""
    late = docs.sparkSession.sparkContext.broadcast(hot)    # at most MOST_HOT numbers
    schema = "key binary, size int, seeds array<long>, prefix array<long>, bits binary, short binary, z binary"
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack, last = WordHash(), zstandard.ZstdCompressor(level=5), late.value
        for big in batches:
            for batch in text_slices(big, 2):
                keys, sizes, seeds, prefixes, bits, short, zs = [], [], [], [], [], [], []
                for t in utf8(batch.column(2)):
                    words = t.lower().split()
                    s = shingles(words, n, hashes)
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        seeds.append([])
                        prefixes.append([])
                        bits.append(None)
                        short.append(None)
                        zs.append(None)
                        continue
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    seeds.append(s[:SEEDS].view(np.int64))
                    if len(last):
                        at = np.searchsorted(last, s).clip(max=len(last) - 1)
                        common = last[at] == s
                        s = np.concatenate([s[~common], s[common]])
                    prefixes.append(s[:prefix_length(len(s), percent)].view(np.int64))
                    bits.append(bitmap(s).tobytes())
                    short.append(bitmap(s[:signature_length(len(s), percent, SHORT)[0]]).tobytes())
                    zs.append(pack.compress(b" ".join(words)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
                     pa.array(sizes, pa.int32()), pa.array(seeds, longs),
                     pa.array(prefixes, longs), pa.array(bits, pa.binary()),
                     pa.array(short, pa.binary()), pa.array(zs, pa.binary())],
                    names=["row", "doc_id", "key", "size", "seeds", "prefix", "bits", "short",
                           "z"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
                 .mapInArrow(run, f"row long, doc_id {id_type}, {schema}"), "join-entries")


# ------------------------------------------------------------- signature trees

class Forest:
    """Union-find over the members of one bucket."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


class Node:
    """Members [lo, hi): the OR of their bitmaps, their size range, the least
    overlap that one of them needs, the most tokens that one lost to bitmap
    collisions, and their component if it is one (else None)."""
    __slots__ = ("lo", "hi", "bits", "least", "most", "need", "lost", "label", "children")

    def __init__(self, lo, hi, bits, sizes, need, lost, labels, children=()):
        self.lo, self.hi, self.bits, self.children = lo, hi, bits, children
        self.least, self.most = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
        self.need, self.lost = int(need[lo:hi].min()), int(lost[lo:hi].max())
        one = (labels[lo:hi] == labels[lo]).all()
        self.label = int(labels[lo]) if one else None


def signature_tree(sizes, bitmaps, need, lost, labels) -> Node:
    level = [Node(i, min(i + LEAF, len(sizes)), np.bitwise_or.reduce(bitmaps[i:i + LEAF]),
                  sizes, need, lost, labels) for i in range(0, len(sizes), LEAF)]
    while len(level) > 1:
        level = [Node(p[0].lo, p[-1].hi, np.bitwise_or.reduce([x.bits for x in p]),
                      sizes, need, lost, labels, p)
                 for p in (level[i:i + LEAF] for i in range(0, len(level), LEAF))]
    return level[0]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bitmap (64-bit words) of a set, 4 to 8 bits per token."""
    width = max(6, (4 * len(s) - 1).bit_length())
    bits = np.zeros(1 << width, bool)
    bits[(s & np.uint64((1 << width) - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def aligned(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width: longer ones are folded (a bit is the low part of
    the hash, so halves are OR-combined)."""
    least = min(map(len, bitmaps))
    return np.stack([np.bitwise_or.reduce(b.reshape(-1, least)) for b in bitmaps])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def possible_pairs(sizes: np.ndarray, bitmaps: np.ndarray, tokens: np.ndarray, need: np.ndarray,
                   labels: np.ndarray, percent: int, done):
    """Pairs (i < j) of members of different components whose sizes and
    bitmaps allow a link, by dual traversal of their signature tree.  A bitmap
    holds ``tokens[i]`` tokens of its set, of which a linked set's has at
    least the smaller ``need`` of the two (and where bitmaps hold whole sets, the
    overlap that the two sizes ask for).  ``done(x, y)`` tells that pairs
    among the members of two nodes need no look."""
    lost = tokens - np.bitwise_count(bitmaps).sum(1).astype(np.int64)
    root = signature_tree(sizes, bitmaps, need, lost, labels)
    whole = percent if (tokens == sizes).all() else 0
    stack = [(root, root)]
    while stack:
        x, y = stack.pop()
        if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least \
                or (x.label is not None and x.label == y.label):
            continue
        # An overlap lies on common bits, but for tokens lost to collisions.
        room = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.lost, y.lost)
        if room < min(x.need, y.need) \
                or (100 + whole) * room < whole * (x.least + y.least) or done(x, y):
            continue
        if x.children:
            kids = [(a, b) for a in x.children for b in y.children if y is not x or a.lo <= b.lo]
            stack += kids[::-1]
            continue
        bx, by, nx, ny, tx, ty, lx, ly = (v[n.lo:n.hi] for v in (bitmaps, sizes, tokens, need)
                                          for n in (x, y))
        # Tokens of one side on no bit of the other are not shared.
        only_x = np.bitwise_count(bx[:, None] & ~by[None]).sum(2, dtype=np.int64)
        only_y = np.bitwise_count(by[None] & ~bx[:, None]).sum(2, dtype=np.int64)
        room = np.minimum(tx[:, None] - only_x, ty[None] - only_y)
        fits = (room >= np.minimum(lx[:, None], ly[None])) \
            & ((100 + whole) * room >= whole * (nx[:, None] + ny[None])) \
            & (100 * np.minimum(nx[:, None], ny[None]) >= percent * np.maximum(nx[:, None], ny[None])) \
            & (labels[x.lo:x.hi, None] != labels[None, y.lo:y.hi])
        for i, j in zip(*np.nonzero(fits)):
            if x.lo + i < y.lo + j:
                yield int(x.lo + i), int(y.lo + j)


def bucket_links(sets: list[np.ndarray], labels: list[int], percent: int):
    """Pairs of members (indices) that join two components."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sets = [sets[i] for i in order]
    label = np.array([labels[i] for i in order], np.int64)
    forest = Forest(label.tolist())
    if len(sets) <= LEAF:
        pairs = ((i, j) for j in range(len(sets)) for i in range(j)
                 if 100 * len(sets[i]) >= percent * len(sets[j]))
    else:
        def done(x: Node, y: Node) -> bool:
            at = forest.root(x.lo)
            return all(forest.root(i) == at for n in (x, y) for i in range(n.lo, n.hi))

        sizes = np.array([len(s) for s in sets])
        pairs = possible_pairs(sizes, aligned([bitmap(s) for s in sets]), sizes,
                               least_overlap(sizes, percent), label, percent, done)
    for i, j in pairs:
        if forest.root(i) != forest.root(j) and linked(sets[i], sets[j], percent):
            forest.join(forest.root(i), forest.root(j))
            yield order[i], order[j]


def bucket_candidates(sizes: list[int], bitmaps: list[np.ndarray], labels: list[int],
                      percent: int, times: int) -> list[int]:
    """Members (indices) that may be linked to a member of another component.
    Members lie in component order, so that nodes are mostly of one."""
    order = sorted(range(len(sizes)), key=lambda i: (labels[i], sizes[i], i))
    marked = np.zeros(len(order), bool)

    def done(x: Node, y: Node) -> bool:
        return marked[x.lo:x.hi].all() and marked[y.lo:y.hi].all()

    tokens, need = np.array([signature_length(sizes[i], percent, times) for i in order]).T
    for i, j in possible_pairs(np.array([sizes[i] for i in order]),
                               aligned([bitmaps[i] for i in order]), tokens, need,
                               np.array([labels[i] for i in order]), percent, done):
        marked[i] = marked[j] = True
    return [order[i] for i in np.flatnonzero(marked)]


def by_bucket(batches: Iterator[pa.RecordBatch], work, schema: dict) -> Iterator[pa.RecordBatch]:
    """Calls ``work(bucket, rows)`` for each run of equal buckets (first
    column) and yields the rows it returns."""
    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())],
            names=list(schema))

    group, at, out = [], None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != at:
                out += work(at, group) if group else []
                group, at = [], bucket
            group.append(row)
        yield batch_of(out)
        out = []
    yield batch_of(list(work(at, group)) if group else [])


def link_buckets(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) links found in the buckets of ``rows`` (bucket, row, label, z)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHash(), zstandard.ZstdDecompressor()

        def links(_, group):
            sets = [shingles(unpack.decompress(z).split(b" "), n, hashes) for _, _, z in group]
            return [(group[i][0], group[j][0])
                    for i, j in bucket_links(sets, [x for _, x, _ in group], percent)]

        yield from by_bucket(batches, links, {"a": pa.int64(), "b": pa.int64()})

    return (rows.select("bucket", "row", "label", "z").repartition("bucket")
            .sortWithinPartitions("bucket", "row").mapInArrow(run, "a long, b long"))


def candidate_members(rows: DataFrame, bits: str, percent: int, times: int) -> DataFrame:
    """The (bucket, row, label) of ``rows`` that may, by their sizes and
    signatures ``bits``, be linked to a member of another component in their
    bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members(bucket, group):
            found = bucket_candidates([g[2] for g in group],
                                      [np.frombuffer(g[3], np.uint64) for g in group],
                                      [g[1] for g in group], percent, times)
            return [(bucket, group[i][0], group[i][1]) for i in found]

        yield from by_bucket(batches, members,
                             {"bucket": pa.int64(), "row": pa.int64(), "label": pa.int64()})

    return (rows.select("bucket", "row", "label", "size", bits).repartition("bucket")
            .sortWithinPartitions("bucket", "row")
            .mapInArrow(run, "bucket long, row long, label long"))


# ------------------------------------------------------------------ components

def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(row, label): the smallest row of the component, for linked rows."""
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
                   .withColumnRenamed("a", "row"), "labels")
    for _ in range(most_rounds):
        around = edges.join(labels.select(F.col("row").alias("b"), "label"), "b") \
                      .groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around, F.col("row") == F.col("a"), "left") \
                      .select("row", F.col("label").alias("old"),
                              F.least("label", "near").alias("label"))
        jump = labels.select(F.col("row").alias("_r"), F.col("label").alias("_l"))
        new = stage(lower.join(jump, F.col("label") == F.col("_r"), "left")
                    .select("row", "old", F.least("label", "_l").alias("label")), "labels")
        labels = new.select("row", "label")
        if new.where("old <> label").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def with_labels(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """``reps`` with the label of their component (their own row if alone).
    Labels grow with the documents, so the join shuffles at every size."""
    return reps.join(labels.withColumnRenamed("row", "_r").hint("merge"),
                     F.col("row") == F.col("_r"), "left") \
               .withColumn("label", F.coalesce("label", "row")).drop("_r")


def size_cell(size, percent: int):
    """Number of a size on a scale of CELLS steps per largest ratio of linked
    sizes (it never falls as sizes grow)."""
    if percent >= 100:
        return size.cast("long")
    return F.floor(F.log(size.cast("double")) * (CELLS / math.log(100.0 / percent)))


def most_partner(size, place, percent: int):
    """Size of the largest set linked to one of this size, if their first
    common shingle is in this (0-based) place: the overlap is at most the
    ``size - place`` shingles from there on, and must reach
    percent / (100 + percent) of the sum of sizes."""
    return F.floor((100 * size - (100 + percent) * place) / F.lit(percent))


def placed_cells(size, place, percent: int):
    """One number for a set's own size cell and how many more its partners may
    reach if it is the smaller one (a last digit of 0: it cannot be)."""
    own, most = size_cell(size, percent), most_partner(size, place, percent)
    more = F.when(most >= size, size_cell(most, percent) - own + 1)
    return (own * SPAN + F.coalesce(more, F.lit(0))).cast("int")


def open_buckets(prefixes: DataFrame) -> DataFrame:
    """(bucket, row, label) from (s, cells, row, label).

    Of two linked sets the smaller enters the size cells from its own up to
    that of its largest partner, the larger its own cell, so they meet in the
    cell of the larger one under their first common shingle.  A cell is opened
    if one that came as the smaller and one in its own cell differ in label."""
    reach = F.col("cells") % SPAN
    entered = (prefixes.withColumn("_reach", reach)
               .select("*", F.floor(F.col("cells") / SPAN).alias("_own"))
               .withColumn("cell", F.explode(F.sequence(
                   "_own", F.col("_own") + F.greatest(F.col("_reach") - 1, F.lit(0))))))
    by_cell = Window.partitionBy("s", "cell")
    small, large = (F.when(c, F.col("label")) for c in
                    (F.col("_reach") > 0, F.col("cell") == F.col("_own")))
    return (entered
            .withColumn("_low", F.least(F.min(small).over(by_cell), F.min(large).over(by_cell)))
            .withColumn("_high", F.greatest(F.max(small).over(by_cell), F.max(large).over(by_cell)))
            .withColumn("_both", F.count(small).over(by_cell) * F.count(large).over(by_cell))
            .withColumn("_who", members(by_cell))
            .where("_both > 0 AND _low <> _high")
            .select(F.xxhash64("_who").alias("bucket"), "row", "label").distinct())


def prefix_rows(ent: DataFrame, kept: DataFrame, labels: DataFrame, i: int,
                percent: int) -> DataFrame:
    """(s, cells, row, label) of the ``kept`` rows for one slice of the
    shingles, where rows of several labels have the shingle.  A shingle is in
    one slice as a whole, so slices are looked at one after the other and only
    a part of the exploded prefixes is on disk at a time."""
    placed = F.transform("prefix", lambda s, at: F.struct(at.alias("place"), s.alias("s")))
    part = ent.select("row", "size", F.filter(
        placed, lambda x: F.pmod(x["s"], F.lit(SLICES)) == i).alias("prefix"))
    rows = (with_labels(part.where(F.size("prefix") > 0).join(kept, "row", "left_semi"), labels)
            .select(F.inline("prefix"), "row", "size", "label")
            .select("s", placed_cells(F.col("size"), F.col("place"), percent).alias("cells"),
                    "row", "label"))
    by_shingle = Window.partitionBy("s")
    return rows.withColumn("_several", F.min("label").over(by_shingle)
                           != F.max("label").over(by_shingle)).where("_several")


def members(window=None):
    """Digest of the rows of a bucket: buckets with the same members, as two
    near-copies have for most of their shingles, are opened once."""
    parts = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64("row", F.lit(1)))]
    return F.struct(*[p.over(window) if window is not None else p for p in parts])


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """row, doc_id, n_shingles, component_id for every row of ``docs``."""
    ship_package(docs.sparkSession)
    ent = entries(docs, n, percent, frequent_shingles(docs, n))
    # One representative of every distinct set.
    classes = stage(ent.where("key IS NOT NULL").groupBy("key")
                    .agg(F.min("row").alias("rep")), "classes")
    reps = ent.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    texts = ent.select("row", "z")      # only representatives are in buckets

    with recorded_tables() as dealt_out:
        seeds = stage(reps.select(F.explode("seeds").alias("s"), "row"), "seeds")
        shared = seeds.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("pivot"),
                                        members().alias("who")).where("m > 1")
        chunks = F.ceil(F.col("m") / BUCKET_ROWS).cast("int")
        dealt = seeds.join(shared, "s").select("row", F.explode(
            F.when(F.col("row") == F.col("pivot"), F.sequence(F.lit(0), chunks - 1))
            .otherwise(F.array(F.pmod(F.xxhash64("row"), chunks).cast("int")))).alias("chunk"), "who")
        dealt = stage(dealt.select(F.xxhash64("who", "chunk").alias("bucket"), "row",
                                   F.col("row").alias("label")).distinct(), "seed-buckets")
    near = link_buckets(texts.join(bounded_broadcast(dealt), "row"), n, percent)
    near = stage(near, "links-seeds")
    delete_tables(docs.sparkSession, dealt_out)     # seeds and their buckets: read no more
    labels = components(near)

    kept = classes.select(F.col("rep").alias("row"))
    opened = [stage(open_buckets(prefix_rows(ent, kept, labels, i, percent)), "open-buckets")
              for i in range(SLICES)]
    maybe = stage(reduce(DataFrame.unionByName, opened).distinct(), "open-buckets")
    for bits, times in (("short", SHORT), ("bits", WHOLE)):
        maybe = stage(candidate_members(maybe.join(ent.select("row", "size", bits), "row"),
                                        bits, percent, times), "candidates")
    rest = link_buckets(texts.join(bounded_broadcast(maybe), "row"), n, percent)
    labels = components(near.union(stage(rest, "links-prefix")))

    named = with_labels(classes.withColumnRenamed("rep", "row"), labels)
    rows = ent.select("row", "doc_id", "size", "key").join(
        named.select("key", "label"), "key", "left") \
        .withColumn("label", F.coalesce("label", "row"))
    rows = stage(rows.select("row", "doc_id", "size", "label"), "labelled")
    smallest = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "label").select(
        "row", "doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")


def component_of(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
