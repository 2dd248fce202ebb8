"""Exact top-k search with segment statistics at several resolutions.

A vector cut into segments of length l with means a and deviations s is mapped
to the features sqrt(l) * a and sqrt(l) * s.  The distance of two feature
vectors is a lower bound of the distance of the vectors (Cauchy-Schwarz within
each segment), and both have the same length.  As
``score = (|q|^2 + |c|^2 - distance^2) / 2``, a candidate can reach a query's
k-th best score only if its lower bound is at most
``|q|^2 + |c|^2 - 2 * threshold``.  Candidates are tested from one segment to
many, those left are scored exactly in whole numbers, and the threshold rises
from tile to tile.  Nothing is approximate: a bound is rounded towards keeping.

All rows are read by every block of queries, in parts: a (query block, part)
pair is a key of one shuffle, which streams the part's candidates past the
queries in tiles.  So a task holds one block of queries and one tile, however
many rows there are; a pair returns at most k rows per query, which a window
merges.  The number of parts only serves the number of tasks.

Cases: vectors that are null or hold null or non-finite components, and rows
without a vec_id, take no part; rows are told apart by row, so repeated rows
find each other and a repeated query is answered once per row; ties go to the
smaller vec_id; queries meet vectors of their own number of components; scores
beyond a long are cut to its ends; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm.common import ship_package, stage

SCALE = 64
RESOLUTIONS = (1, 4, 16)
TILE = 1024
EXACT = float(1 << 53)


def scaled(x: np.ndarray) -> np.ndarray:
    """Whole-number components, as doubles (which hold them exactly)."""
    return np.floor(SCALE * x.astype(np.float64))


def features(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted by the segment length."""
    cuts = np.linspace(0, v.shape[1], segments + 1).astype(int)
    starts, size = cuts[:-1], np.diff(cuts)
    sums = np.add.reduceat(v, starts, axis=1)
    spread = np.maximum(np.add.reduceat(v * v, starts, axis=1) - sums ** 2 / size, 0.0)
    return np.hstack([sums / np.sqrt(size), np.sqrt(spread)])


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as int64."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1)
    if most < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object) for m in (q, c)]
    ends = np.iinfo(np.int64)
    return np.clip(whole[0] @ whole[1].T, ends.min, ends.max).astype(np.int64)


class QueryBlock:
    """Queries with their k best candidates so far."""

    def __init__(self, row: np.ndarray, name: np.ndarray, v: np.ndarray, k: int):
        self.row, self.name, self.v, self.k = row, name, v, k
        self.steps = [r for r in RESOLUTIONS if r < v.shape[1]]
        self.seen = [features(v, r) for r in self.steps]
        self.length = np.einsum("ij,ij->i", v, v)
        # Best rows, flat: query number, score and candidate, sorted.
        self.q = self.score = self.id = np.zeros(0, np.int64)
        self.least = np.full(len(v), -np.inf)    # k-th best score

    def survivors(self, c: np.ndarray) -> np.ndarray:
        """Which candidates some query may want."""
        length = np.einsum("ij,ij->i", c, c)
        left = np.arange(len(c))
        for r, q in zip(self.steps, self.seen):
            f = features(c[left], r)
            both = self.length[:, None] + length[left][None, :]
            # Squared distance of the features, and the most that is allowed.
            bound = np.maximum(both - 2.0 * (q @ f.T), 0.0)
            most = both - 2.0 * self.least[:, None]
            # Told apart by "not more", so that what overflows is kept.
            left = left[~(bound > most + 1e-9 * (1.0 + both)).all(axis=0)]
            if not len(left):
                break
        return left

    def meet(self, row: np.ndarray, name: np.ndarray, c: np.ndarray):
        left = self.survivors(c)
        if not len(left):
            return
        row, name = row[left], name[left]
        score = inner(self.v, c[left])
        wanted = (score >= self.least[:, None]) & (self.row[:, None] != row[None, :])
        if len(left) > self.k and np.isinf(self.least).any():
            # First tiles: only what is among the tile's own k best (the own row may be).
            tile = np.partition(score, len(left) - self.k - 1, axis=1)[:, len(left) - self.k - 1]
            wanted &= score >= tile[:, None]
        q, i = np.nonzero(wanted)
        q, s, n = (np.concatenate(x) for x in
                   ((self.q, q), (self.score, score[q, i]), (self.id, name[i])))
        order = np.lexsort((n, -s, q))
        q, s, n = q[order], s[order], n[order]
        first = np.searchsorted(q, np.arange(len(self.v)))
        place = np.arange(len(q)) - first[q]
        keep = place < self.k
        self.q, self.score, self.id = q[keep], s[keep], n[keep]
        last = place[keep] == self.k - 1
        self.least[self.q[last]] = self.score[last]

    def best(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.row[self.q]), pa.array(self.name[self.q]), pa.array(self.id),
             pa.array(self.score)], names=["row", "query_id", "vec_id", "score"])


def _search(k: int):
    """Kernel over rows (pair, role, row, vec_id, vector) sorted by pair and
    role: the queries (role 0) of a pair, then its candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, queries = None, None, []
        for b in batches:
            pair, role, row, name = (b.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((np.diff(pair) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pair)]):
                if lo == hi:
                    continue
                if pair[lo] != at:
                    if block is not None:
                        yield block.best()
                    at, block, queries = pair[lo], None, []
                for lo in range(lo, hi, TILE):
                    end = min(lo + TILE, hi)
                    part = b.column(4).slice(lo, end - lo)
                    v = scaled(part.flatten().to_numpy()).reshape(end - lo, -1)
                    if role[lo] == 0:
                        queries.append((row[lo:end], name[lo:end], v))
                        continue
                    if block is None and not queries:
                        break       # no query was dealt into this block
                    if block is None:
                        block = QueryBlock(*(np.concatenate(x) for x in zip(*queries)), k)
                    block.meet(row[lo:end], name[lo:end], v)
        if block is not None:
            yield block.best()
    return run


def top_k(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id",
          vector: str = "embedding", queries_per_block: int = 4096, part_rows: int = 8192,
          most_part_rows: int = 1 << 20, pairs: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose
    id is divisible by ``every``.  Parts have ``part_rows`` candidates, or more
    where ``pairs`` tasks are reached without, up to ``most_part_rows``."""
    spark = rows.sparkSession
    ship_package(spark)
    x = F.col(vector)
    valid = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = stage(rows.where(valid).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"),
        F.size(x).alias("dim"), x.alias("v")), "topk-vectors")
    asks = F.col("vec_id") % every == 0
    size = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asked"))
    blocks = F.ceil(F.col("asked") / F.lit(queries_per_block))
    parts = F.greatest(F.ceil(F.col("n") / F.lit(most_part_rows)),
                       F.least(F.ceil(F.col("n") / F.lit(part_rows)), F.ceil(F.lit(pairs) / blocks)))
    size = size.where("asked > 0").select("dim", blocks.cast("int").alias("blocks"),
                                          parts.cast("int").alias("parts"))
    size = stage(size, "topk-sizes")
    total = size.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0] or 1
    dealt = vectors.join(size, "dim").withColumns({
        "block": F.pmod(F.xxhash64(F.lit(1), "row"), F.col("blocks")),
        "part": F.pmod(F.xxhash64(F.lit(2), "row"), F.col("parts"))})
    of = lambda role, df: df.select(
        (F.shiftleft(F.col("dim").cast("long"), 40) + F.col("block") * F.col("parts")
         + F.col("part")).alias("pair"), F.lit(role).alias("role"), "row", "vec_id", "v")
    asked = of(0, dealt.where(asks).withColumn("part", F.explode(
        F.expr("sequence(0L, parts - 1L)"))))
    met = of(1, dealt.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)"))))
    n = int(min(total, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = asked.unionByName(met).repartition(n, "pair").sortWithinPartitions("pair", "role") \
        .mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
