"""Leaf-wise boosted regression trees on Spark.

Columns are coded once: numbers by quantile bins, strings by a distributed
dictionary of levels (a level list never comes to the driver, whatever the
width of a column).  A split sends bins up to a bound to the left, or one level
to the right: the same splits as on one 0/1 column per level, without these.

Rows with equal codes get equal predictions, so they are collapsed to (codes,
number of rows, sum of the target) by one aggregate; all later passes read
these vectors.  Their number is bounded by the product of the bins and levels,
not by the rows.

A tree grows best-first: of all leaves that with the largest gain is split
next.  Vectors that fill a table of up to TASK_CELLS cells (the codes of the
widest column against the combinations of the others, both counted), or else up
to TASK_VECTORS distinct vectors, are sufficient statistics that one task holds,
and it runs all rounds without a job per pass.  Beyond, a
pass over the distributed vectors computes histograms of gradients per (node, column, code) in
Arrow batches, sums them by one shuffle and finds each node's best split on
executors; what comes to the driver is one row per node and column.  One pass
serves all leaves that could still be split, so a tree takes about as many
passes as it is deep, and its first pass also applies the tree before.

Cases: null numbers are below all bins, null strings at no level; columns with
one value and levels with too few rows are not split on; no rows raise an error.
"""

from __future__ import annotations

import heapq
import json
import math
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescope.operators.star_build import dense_index
from salescope.session import materialize, ship_package

MAX_BINS = 255
MIN_ROWS = 20           # fewest rows of a leaf
CUT_EVERY = 20          # trees between two written copies of the state
TASK_VECTORS = 1 << 20  # most distinct vectors that one task may hold
TASK_CELLS = 1 << 22    # most cells of a table of vectors that one task may hold
CELLS_PER_VECTOR = 16   # a table with more cells for each vector is too sparse


# ------------------------------------------------------------------- coding

def value_counts(df: DataFrame, numeric: list[str]) -> DataFrame:
    """column, v, n: the distinct numbers of each column."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("v"))
        for i, c in enumerate(numeric)])).alias("x")).select("x.*")
    return pairs.where(F.col("v").isNotNull()).groupBy("column", "v").agg(
        F.count(F.lit(1)).alias("n"))


def running_totals(df: DataFrame, group: str, order: str, weight: str) -> DataFrame:
    """df + ``before``: the weight of the group's rows earlier in the order.
    Rows are sorted in ranges; a window holds one range of a group, and the
    ranges' sums (one row each) are ranked together."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(n, group, order)
                       .withColumn("_p", F.spark_partition_id()), "running")
    inside = Window.partitionBy("_p", group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_p").agg(F.sum(weight).alias("_s"))
    earlier = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    return (rows.withColumn("_i", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .join(offsets, [group, "_p"])
            .withColumn("before", F.col("_i") + F.col("_o")).drop("_i", "_o", "_p"))


def bin_edges(df: DataFrame, numeric: list[str], max_bins: int = MAX_BINS) -> DataFrame:
    """column, bin (from 1), upper, n: bins of about equal numbers of rows.  A
    column of at most ``max_bins`` values has a bin for each."""
    counts = value_counts(df, numeric)
    placed = running_totals(counts, "column", "v", "n")
    size = placed.groupBy("column").agg(F.sum("n").alias("total"),
                                        F.count(F.lit(1)).alias("values"))
    slot = F.floor(F.col("before") * max_bins / F.col("total"))
    bins = placed.join(size, "column").groupBy(
        "column", F.when(F.col("values") <= max_bins, F.col("v")).otherwise(slot).alias("slot")) \
        .agg(F.max("v").alias("upper"), F.sum("n").alias("n"))
    order = Window.partitionBy("column").orderBy("upper")    # at most max_bins rows
    return bins.select("column", F.row_number().over(order).alias("bin"), "upper", "n")


def level_dictionary(df: DataFrame, strings: list[str]) -> DataFrame:
    """column, level, id (from 0, in the order of column and level) and first
    (the column's first level, which is no feature)."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("level"))
        for i, c in enumerate(strings)])).alias("x")).select("x.*")
    levels = pairs.where(F.col("level").isNotNull()).distinct()
    ids = materialize(dense_index(levels, ["column", "level"], "id"), "levels")
    low = ids.groupBy("column").agg(F.min("id").alias("low"))
    return ids.join(low, "column").select(
        "column", "level", (F.col("id") - 1).cast("int").alias("id"),
        (F.col("id") == F.col("low")).alias("first"))


def edge_groups(edges: list[float]) -> list[list[float]]:
    """The edges in groups of about the root of their number."""
    step = math.isqrt(max(len(edges) - 1, 0)) + 1
    return [edges[i:i + step] for i in range(0, len(edges), step)]


def _number_below(edges: list[float], x: Column) -> Column:
    """How many of the sorted edges are below x: only the group that x falls
    into is looked at, after the groups' last edges."""
    if not edges:
        return F.lit(0)
    groups = edge_groups(edges)
    every = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    lasts = F.array(*[F.lit(g[-1]) for g in groups[:-1]]).cast("array<double>")
    at = F.size(F.filter(lasts, lambda e: e < x))
    # A lambda variable, so that the group is looked for once.
    return F.transform(F.array(at), lambda k: k * len(groups[0]) + F.size(
        F.filter(F.get(every, k), lambda e: e < x)))[0]


@dataclass
class Coding:
    """How rows are coded: ``numeric`` columns by ``uppers`` (at most MAX_BINS
    bounds each), ``strings`` by the staged ``levels`` dictionary."""
    numeric: list[str]
    strings: list[str]
    uppers: list[list[float]]
    levels: DataFrame
    firsts: list[int]           # id of the first level of each string column

    @property
    def codes(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.numeric) + len(self.strings))]

    def encode(self, df: DataFrame) -> DataFrame:
        """df + one int code per column: 0 for a null number, -1 for a null or
        unknown level."""
        out = df
        for i, (c, up) in enumerate(zip(self.numeric, self.uppers)):
            x = F.col(c).cast("double")
            out = out.withColumn(f"c{i}", F.when(x.isNull(), F.lit(0)).otherwise(
                F.least(_number_below(up, x), F.lit(max(len(up) - 1, 0))) + 1).cast("int"))
        for j, c in enumerate(self.strings):
            name = f"c{len(self.numeric) + j}"
            mine = self.levels.where(F.col("column") == j).select(
                F.col("level").alias("_level"), F.col("id").alias(name))
            out = out.join(mine, F.col(c).cast("string") == F.col("_level"), "left") \
                     .drop("_level").withColumn(name, F.coalesce(name, F.lit(-1)))
        return out

    def features(self) -> DataFrame:
        """feature_index, feature, source, level, column, id: every feature a
        one-hot matrix would have (without first levels), never collected."""
        spark = self.levels.sparkSession
        n = len(self.numeric)
        schema = ("feature_index int, feature string, source string, level string, "
                  "column int, id int")
        plain = spark.createDataFrame(
            [(i, c, c, None, i, None) for i, c in enumerate(self.numeric)], schema)
        if not self.strings:
            return plain
        source = F.get(F.array(*map(F.lit, self.strings)), F.col("column"))
        return plain.unionByName(self.levels.where("NOT first").select(
            (F.lit(n - 1) + F.col("id") - F.col("column")).cast("int").alias("feature_index"),
            F.concat(source, F.lit("_"), "level").alias("feature"), source.alias("source"),
            "level", (F.col("column") + n).cast("int").alias("column"), "id"))


def fit_coding(df: DataFrame, numeric: list[str], strings: list[str],
               max_bins: int = MAX_BINS) -> Coding:
    edges = bin_edges(df, numeric, max_bins).collect() if numeric else []
    uppers = [sorted(r["upper"] for r in edges if r["column"] == i) for i in range(len(numeric))]
    if not strings:
        empty = df.sparkSession.createDataFrame([], "column int, level string, id int, first boolean")
        return Coding(numeric, strings, uppers, empty, [])
    levels = materialize(level_dictionary(df, strings), "level-ids")
    firsts = {r["column"]: r["id"] for r in levels.where("first").collect()}
    return Coding(numeric, strings, uppers, levels,
                  [firsts.get(j, -1) for j in range(len(strings))])


def collapse(coded: DataFrame, codes: list[str], label: str) -> DataFrame:
    """Distinct code vectors with their number of rows and sum of the target."""
    return coded.groupBy(*codes).agg(F.count(F.lit(1)).cast("double").alias("n"),
                                     F.sum(F.col(label).cast("double")).alias("y"))


# -------------------------------------------------------------------- trees

@dataclass
class Tree:
    """Nodes in order of their making; leaves have ``left`` -1."""
    column: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("column", 0), ("code", 0), ("left", -1), ("right", -1),
                        ("value", value), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.left) - 1

    def walk(self, codes: np.ndarray, n_numeric: int) -> np.ndarray:
        """Leaf (so far) of every row of ``codes``."""
        column, code, left, right = (np.array(x) for x in
                                     (self.column, self.code, self.left, self.right))
        at = np.zeros(len(codes), np.int64)
        rows = np.flatnonzero(left[at] >= 0)
        while len(rows):
            a = at[rows]
            c = column[a]
            x = codes[rows, c]
            low = np.where(c < n_numeric, x <= code[a], x != code[a])
            at[rows] = np.where(low, left[a], right[a])
            rows = rows[left[at[rows]] >= 0]
        return at


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy() for i in range(n)]).astype(np.int64)


def _advance(state: DataFrame, tree: Tree, n_codes: int, n_numeric: int) -> DataFrame:
    """The state (codes, n, y, pred) after a tree."""
    def run(batches):
        value = np.array(tree.value)
        for b in batches:
            pred = b.column(n_codes + 2).to_numpy() + value[tree.walk(_matrix(b, n_codes), n_numeric)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred)], schema=b.schema)
    return state.mapInArrow(run, state.schema)


def _histograms(state: DataFrame, tree: Tree, wanted: list[int], n_codes: int,
                n_numeric: int) -> DataFrame:
    """node, column, code, g, n: gradient and row sums of the wanted nodes, one
    row per batch and code met there."""
    def run(batches):
        place = np.full(len(tree.left), -1)
        place[wanted] = np.arange(len(wanted))
        back = np.array(wanted, dtype=np.int32)
        for b in batches:
            codes = _matrix(b, n_codes)
            n, y, pred = (b.column(n_codes + i).to_numpy() for i in range(3))
            node = place[tree.walk(codes, n_numeric)]
            rows = node >= 0
            if not rows.any():
                continue
            codes, node, n = codes[rows], node[rows], n[rows]
            g = y[rows] - n * pred[rows]
            out = []
            for c in range(n_codes):
                key = (node << 32) + codes[:, c] + 1
                keys, inverse = np.unique(key, return_inverse=True)
                out.append((back[keys >> 32], np.full(len(keys), c, np.int32),
                            ((keys & 0xFFFFFFFF) - 1).astype(np.int32),
                            np.bincount(inverse, g), np.bincount(inverse, n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in zip(*out)],
                names=["node", "column", "code", "g", "n"])
    return state.mapInArrow(run, "node int, column int, code int, g double, n double")


def _is_open(seed: int, tree: int, column: np.ndarray, name: np.ndarray,
             fraction: float) -> np.ndarray:
    """Whether a tree may use a feature, by a hash of its number."""
    with np.errstate(over="ignore"):
        x = (np.uint64(seed * 1_000_003 + tree) * np.uint64(0x9E3779B97F4A7C15)
             + column.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
             + name.astype(np.int64).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        for shift in (30, 27, 31):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) < fraction


def split_candidates(column: np.ndarray, code: np.ndarray, g: np.ndarray, n: np.ndarray,
                     n_numeric: int, firsts: list[int], min_rows: int) -> tuple:
    """gain, gl, nl of every code of one node (sorted by column and code): the
    gain in squared error of "at most this code" for numbers and "not this
    level" for strings; -1 where a side is too small or the level no feature."""
    start = np.flatnonzero(np.diff(column, prepend=-1))
    size = np.diff(np.append(start, len(column)))
    gs, ns = (np.repeat(np.add.reduceat(x, start), size) for x in (g, n))
    gu, nu = (np.cumsum(x) for x in (g, n))
    gu, nu = (u - np.repeat(u[start] - x[start], size) for u, x in ((gu, g), (nu, n)))
    number = column < n_numeric
    gl, nl = np.where(number, gu, gs - g), np.where(number, nu, ns - n)
    gr, nr = gs - gl, ns - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / nl + gr * gr / nr - gs * gs / ns
    dropped = np.array([-1] * n_numeric + list(firsts))[column]
    feature = number | ((code >= 0) & (code != dropped))
    return np.where((nl >= min_rows) & (nr >= min_rows) & feature, gain, -1.0), gl, nl


def best_splits(hist: DataFrame, n_numeric: int, firsts: list[int], min_rows: int,
                number: int, fraction: float, seed: int, partitions: int) -> DataFrame:
    """node, column, g, n, gain, code, gl, nl: one row per node and column, its
    sums and the split of the largest gain (-1 without a valid one).  One
    shuffle by (node, column) brings the partial histograms together."""
    def run(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        node, column, code, g, n = (np.concatenate([b.column(i).to_numpy() for b in parts])
                                    for i in range(5))
        # Sum the batches' histograms: one key per node, column and code.
        order = np.lexsort((code, column, node))
        node, column, code, g, n = (x[order] for x in (node, column, code, g, n))
        new = np.flatnonzero((np.diff(node, prepend=-1) != 0) | (np.diff(column, prepend=-1) != 0)
                             | (np.diff(code, prepend=-2) != 0))
        g, n = np.add.reduceat(g, new), np.add.reduceat(n, new)
        node, column, code = node[new], column[new], code[new]
        out = []
        cut = [*np.flatnonzero(np.diff(node, prepend=-1)), len(node)]
        for lo, hi in zip(cut, cut[1:]):
            c, k = column[lo:hi], code[lo:hi]
            gain, gl, nl = split_candidates(c, k, g[lo:hi], n[lo:hi], n_numeric, firsts, min_rows)
            free = _is_open(seed, number, c, np.where(c < n_numeric, -2, k), fraction)
            gain = np.where(free, gain, -1.0)
            for col in np.unique(c):
                mine = np.flatnonzero(c == col)
                at = mine[np.argmax(gain[mine])]        # ties: the smallest code
                out.append((node[lo], col, g[lo:hi][mine].sum(), n[lo:hi][mine].sum(), gain[at],
                            k[at], gl[at], nl[at]))
        types = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(),
                 pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)],
                                         names=["node", "column", "g", "n", "gain", "code", "gl", "nl"])
    return hist.repartition(partitions, "node", "column").mapInArrow(
        run, "node int, column int, g double, n double, gain double, code int, gl double, nl double")


@dataclass
class LeafwiseModel:
    coding: Coding
    base: float
    trees: list[Tree]
    spark: SparkSession

    def predict(self, coded: DataFrame, out: str = "prediction") -> DataFrame:
        """Rows with codes + their prediction."""
        if not self.trees:
            raise ValueError("the model has no trees; fit it first")
        codes, trees, base = self.coding.codes, self.trees, self.base
        n_numeric = len(self.coding.numeric)
        ship_package(self.spark)
        schema = coded.drop(out).schema.add(out, "double")
        order = codes + [c for c in coded.columns if c not in codes and c != out]

        def run(batches):
            for b in batches:
                m = _matrix(b, len(codes))
                total = np.full(len(m), base)
                for t in trees:
                    total += np.array(t.value)[t.walk(m, n_numeric)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
                    + [pa.array(total)], names=[f.name for f in schema.fields])
        return coded.select(*order).mapInArrow(run, schema)

    def node_frame(self) -> DataFrame:
        """tree, node, column, code, left, right, value, cover, gain."""
        return self.spark.createDataFrame(_node_rows(self.trees), NODES)

    def importance(self, kind: str = "split") -> DataFrame:
        """Feature, Importance of every feature: number of splits, or their
        share of all gain."""
        splits = self.node_frame().where("left >= 0").groupBy(
            "column", F.when(F.col("column") >= len(self.coding.numeric), F.col("code"))
            .alias("id")).agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
        f = self.coding.features().alias("f").join(
            splits.alias("s"), (F.col("f.column") == F.col("s.column"))
            & F.col("f.id").eqNullSafe(F.col("s.id")), "left")
        if kind == "split":
            value = F.coalesce("splits", F.lit(0)).cast("long")
        else:
            total = self.node_frame().where("left >= 0").agg(F.sum("gain")).first()[0] or 1.0
            value = F.coalesce("gain", F.lit(0.0)) / F.lit(total)
        return f.select(F.col("feature").alias("Feature"), value.alias("Importance")) \
                .orderBy(F.desc("Importance"), "Feature")

    def save(self, path: str) -> None:
        self.node_frame().write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        self.coding.levels.write.mode("overwrite").parquet(os.path.join(path, "levels"))
        c = self.coding
        head = json.dumps({"base": self.base, "numeric": c.numeric, "strings": c.strings,
                           "uppers": c.uppers, "firsts": c.firsts})
        self.spark.createDataFrame([(head,)], "head string").write.mode("overwrite") \
            .json(os.path.join(path, "head"))


def load_leafwise(spark: SparkSession, path: str) -> LeafwiseModel:
    head = json.loads(spark.read.json(os.path.join(path, "head")).first()["head"])
    levels = spark.read.parquet(os.path.join(path, "levels"))
    nodes = spark.read.parquet(os.path.join(path, "nodes")).collect()   # bounded by the model
    coding = Coding(head["numeric"], head["strings"], head["uppers"], levels, head["firsts"])
    return LeafwiseModel(coding, head["base"], _read_trees(nodes), spark)


def _grow(engine, leaves: int, step: float) -> Tree | None:
    """One tree, best-first.  ``engine.root()`` gives the root's sums and best
    split, ``engine.children(tree, parents, known)`` those of the children of
    leaves.  None if the root cannot be split."""
    tree = Tree()
    tree.add(0.0, 0.0)
    known = {0: engine.root(tree)}
    if known[0] is None or known[0]["gain"] is None:
        return None
    tree.cover[0] = known[0]["n"]
    heap, ready, made = [(-known[0]["gain"], 0)], {}, 1
    while heap and made < leaves:
        i = heap[0][1]
        last = leaves - made == 1       # nothing below the last split is needed
        if i not in ready and not last:
            # Every leaf that may still be split, if a pass is dear.
            ahead = [j for _, j in heapq.nsmallest(leaves - made, heap) if j not in ready] \
                if engine.ahead else [i]
            ready.update(engine.children(tree, ahead, known))
            continue
        heapq.heappop(heap)
        k = known[i]
        tree.column[i], tree.code[i], tree.gain[i] = k["column"], k["code"], k["gain"]
        pair = [tree.add(step * g / n, n) for g, n in
                ((k["gl"], k["nl"]), (k["g"] - k["gl"], k["n"] - k["nl"]))]
        tree.left[i], tree.right[i] = pair
        made += 1
        for side, (child, k) in enumerate(zip(pair, ready.pop(i, (None, None)))):
            if k is not None:
                known[child] = k
                engine.opened(i, side, child)
                if k["gain"] is not None:
                    heapq.heappush(heap, (-k["gain"], child))
    return tree


def distinct_rows(columns) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct combination of the integer ``columns``, and the
    number of every row's combination."""
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for x in columns:
        low = int(x.min())
        width = int(x.max()) - low + 1
        if size * width >= 1 << 62:
            kinds, key = np.unique(key, return_inverse=True)
            size = len(kinds)
        key, size = key * width + (x - low), size * width
    if size > 8 * len(key) + 1024:
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        return first, place.ravel()
    first = np.full(size, -1)
    first[key] = np.arange(len(key))
    met = first >= 0
    return first[met], (np.cumsum(met) - 1)[key]


class Passes:
    """Sums by passes over a distributed state (codes, n, y, pred)."""
    ahead = True

    def __init__(self, state: DataFrame, number: int, n_codes: int, n_numeric: int,
                 firsts: list[int], min_rows: int, fraction: float, seed: int, partitions: int):
        self.state, self.shape = state, (n_codes, n_numeric)
        self.rest = (n_numeric, firsts, min_rows, number, fraction, seed, partitions)

    def _splits(self, tree: Tree, nodes: list[int]) -> dict:
        rows = best_splits(_histograms(self.state, tree, nodes, *self.shape), *self.rest).collect()
        out = {}
        for x in sorted(rows, key=lambda x: (x["node"], x["column"])):
            k = out.setdefault(x["node"], {"gain": None, "g": x["g"], "n": x["n"]})
            if x["gain"] > (k["gain"] or 0.0):
                k.update(x.asDict() | {"g": k["g"], "n": k["n"]})
        return out

    def root(self, tree: Tree):
        return self._splits(tree, [0]).get(0)

    def children(self, tree: Tree, parents: list[int], known: dict) -> dict:
        trial = Tree(*[list(getattr(tree, f)) for f in tree.__dataclass_fields__])
        asked = {}
        for j in parents:
            trial.column[j], trial.code[j] = known[j]["column"], known[j]["code"]
            asked[j] = trial.add(0.0, 0.0), trial.add(0.0, 0.0)
            trial.left[j], trial.right[j] = asked[j]
        found = self._splits(trial, [x for pair in asked.values() for x in pair])
        return {j: tuple(found.get(x) for x in pair) for j, pair in asked.items()}

    def opened(self, parent: int, side: int, child: int) -> None:
        pass


class Arrays:
    """Sums over vectors held by one task: the rows and the histogram of every
    leaf are kept, and the larger child's histogram is its parent's less the
    smaller child's."""
    ahead = False

    def __init__(self, codes: np.ndarray, n: np.ndarray, y: np.ndarray, n_numeric: int,
                 firsts: list[int], min_rows: int, fraction: float, seed: int):
        low = codes.min(axis=0)
        width = codes.max(axis=0) - low + 1
        start = np.concatenate([[0], np.cumsum(width)])
        self.size = int(start[-1])
        self.flat = [np.ascontiguousarray(codes[:, i] - low[i] + start[i])
                     for i in range(codes.shape[1])]
        self.column = np.repeat(np.arange(codes.shape[1]), width)
        self.code = np.concatenate([np.arange(w) + b for w, b in zip(width, low)])
        self.codes, self.n, self.y = codes, n, y
        self.n_numeric, self.firsts, self.min_rows = n_numeric, firsts, min_rows
        self.fraction, self.seed = fraction, seed

    def start(self, number: int, pred: np.ndarray) -> None:
        self.g = self.y - self.n * pred
        names = np.where(self.column < self.n_numeric, -2, self.code)
        self.open = _is_open(self.seed, number, self.column, names, self.fraction)
        self.rows, self.hist, self.next = {}, {}, {}

    def _low(self, rows: np.ndarray, column: int, code: int) -> np.ndarray:
        x = self.codes[rows, column]
        return x <= code if column < self.n_numeric else x != code

    def values(self, tree: Tree) -> np.ndarray:
        """The tree's value for every vector, from the rows kept per leaf."""
        out = np.empty(len(self.n))
        for i, rows in self.rows.items():
            if tree.left[i] < 0:
                out[rows] = tree.value[i]
            else:       # the last split, whose children were not counted
                low = self._low(rows, tree.column[i], tree.code[i])
                out[rows] = np.where(low, tree.value[tree.left[i]], tree.value[tree.right[i]])
        return out

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        g, n, out = self.g[rows], self.n[rows], np.zeros((2, self.size))
        for column in self.flat:
            at = column[rows]
            out[0] += np.bincount(at, g, self.size)
            out[1] += np.bincount(at, n, self.size)
        return out

    def _best(self, rows: np.ndarray, hist: np.ndarray) -> dict:
        return self._choose(float(self.g[rows].sum()), float(self.n[rows].sum()), hist)

    def _choose(self, g: float, n: float, hist: np.ndarray) -> dict:
        out = {"gain": None, "g": g, "n": n}
        gain, gl, nl = split_candidates(self.column, self.code, hist[0], hist[1], self.n_numeric,
                                        self.firsts, self.min_rows)
        at = int(np.argmax(np.where(self.open, gain, -1.0)))
        if self.open[at] and gain[at] > 0:
            out.update(gain=float(gain[at]), column=int(self.column[at]), code=int(self.code[at]),
                       gl=float(gl[at]), nl=float(nl[at]))
        return out

    def _root(self, rows) -> dict:
        self.rows[0], self.hist[0] = rows, self._sums(rows)
        return self._best(rows, self.hist[0])

    def root(self, tree: Tree):
        return self._root(np.arange(len(self.n)))

    def _split(self, rows: np.ndarray, column: int, code: int) -> tuple:
        low = self._low(rows, column, code)
        return rows[low], rows[~low]

    @staticmethod
    def _weight(rows: np.ndarray) -> int:
        return len(rows)

    def children(self, tree: Tree, parents: list[int], known: dict) -> dict:
        out = {}
        for j in parents:
            k = known[j]
            pair = self._split(self.rows.pop(j), k["column"], k["code"])
            small = 0 if self._weight(pair[0]) <= self._weight(pair[1]) else 1
            sums = self._sums(pair[small])
            rest = self.hist.pop(j) - sums
            hists = (sums, rest) if small == 0 else (rest, sums)
            self.next[j] = list(zip(pair, hists))
            out[j] = tuple(self._best(*x) for x in self.next[j])
        return out

    def opened(self, parent: int, side: int, child: int) -> None:
        self.rows[child], self.hist[child] = self.next[parent][side]


class Cells(Arrays):
    """The same sums over a dense table: a row for each combination of the
    other columns' codes that is met, a column for each code of the ``wide``
    column.  A node is a set of rows and a set of wide codes, so its histogram
    is the row and column sums of a part of the table."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, y: np.ndarray, wide: int, *args):
        self.wide = wide
        others = np.delete(codes, wide, axis=1)
        first, place = distinct_rows(others.T)
        kinds, low = others[first], codes[:, wide].min()
        width = int(codes[:, wide].max() - low + 1)
        # One vector per row and one per wide code: the ranges of all columns.
        ends = np.insert(kinds, wide, low, axis=1)
        super().__init__(np.concatenate([ends, np.insert(kinds[:1].repeat(width, axis=0), wide,
                                                         low + np.arange(width), axis=1)]),
                         n, y, *args)
        self.codes = ends
        self.flat = [x[:len(ends)] for x in self.flat]
        self.wide_codes = low + np.arange(width)
        self.wide_at = int(np.flatnonzero(self.column == wide)[0])
        at = place * width + codes[:, wide] - low
        self.n, self.y = (np.bincount(at, x, len(ends) * width).reshape(-1, width)
                          for x in (n, y))

    def _part(self, table: np.ndarray, node: tuple) -> np.ndarray:
        rows, cols = node
        if len(cols) and cols[-1] - cols[0] + 1 == len(cols):
            table, cols = table[:, cols[0]:cols[-1] + 1], None
        if len(rows) < len(table):
            table = table[rows]
        return table if cols is None else table[:, cols]

    def _split(self, node: tuple, column: int, code: int) -> tuple:
        rows, cols = node
        x = self.wide_codes[cols] if column == self.wide else self.codes[rows, column]
        low = x <= code if column < self.n_numeric else x != code
        if column == self.wide:
            return (rows, cols[low]), (rows, cols[~low])
        return (rows[low], cols), (rows[~low], cols)

    def values(self, tree: Tree) -> np.ndarray:
        out = np.empty(self.n.shape)

        def put(node, value):
            rows, cols = node
            out[rows[:, None], cols] = value
        for i, node in self.rows.items():
            if tree.left[i] < 0:
                put(node, tree.value[i])
            else:
                for part, child in zip(self._split(node, tree.column[i], tree.code[i]),
                                       (tree.left[i], tree.right[i])):
                    put(part, tree.value[child])
        return out

    def _sums(self, node: tuple) -> np.ndarray:
        rows, cols = node
        out = np.zeros((2, self.size))
        for k, table in enumerate((self.g, self.n)):
            part = self._part(table, node)
            by_row = part.sum(axis=1)
            for c, column in enumerate(self.flat):
                if c != self.wide:
                    out[k] += np.bincount(column[rows], by_row, self.size)
            out[k, self.wide_at + cols] = part.sum(axis=0)
        return out

    def _best(self, node: tuple, hist: np.ndarray) -> dict:
        hist[0][hist[1] == 0] = 0.0     # what a difference of sums leaves over
        mine = self.column == self.wide
        return self._choose(float(hist[0][mine].sum()), float(hist[1][mine].sum()), hist)

    def root(self, tree: Tree):
        return self._root((np.arange(len(self.codes)), np.arange(len(self.wide_codes))))

    @staticmethod
    def _weight(node: tuple) -> int:
        return len(node[0]) * len(node[1])


def _fit_in_task(engine: Arrays, base: float, rounds: int, step: float, leaves: int) -> list[Tree]:
    pred, trees = np.full(engine.n.shape, base), []
    for r in range(rounds):
        engine.start(r, pred)
        tree = _grow(engine, leaves, step)
        if tree is not None:
            trees.append(tree)
            pred = pred + engine.values(tree)
    return trees


NODES = ("tree int, node int, column int, code int, left int, right int, value double, "
         "cover double, gain double")


def _node_rows(trees: list[Tree]) -> list[tuple]:
    return [(t, i, int(x.column[i]), int(x.code[i]), x.left[i], x.right[i], float(x.value[i]),
             float(x.cover[i]), float(x.gain[i]))
            for t, x in enumerate(trees) for i in range(len(x.left))]


def _read_trees(rows) -> list[Tree]:
    trees: dict[int, Tree] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        t = trees.setdefault(r["tree"], Tree())
        i = t.add(r["value"], r["cover"])
        for c in ("column", "code", "left", "right", "gain"):
            getattr(t, c)[i] = r[c]
    return [trees[i] for i in sorted(trees)]


def fit_leafwise(coding: Coding, vectors: DataFrame, rounds: int = 500, step: float = 0.05,
                 leaves: int = 31, min_rows: int = MIN_ROWS, fraction: float = 0.8,
                 seed: int = 42, partitions: int = 4, most_vectors: int = TASK_VECTORS,
                 most_cells: int = TASK_CELLS) -> LeafwiseModel:
    """Boosts regression trees (squared loss) on staged ``vectors`` (codes, n,
    y).  ``fraction`` of the features, chosen by hash, are open to a tree.  If
    the vectors fill a table of at most ``most_cells`` cells, or are at most
    ``most_vectors`` (both counted), one task runs all rounds; beyond, every
    pass is a job over the distributed vectors.  All give the same trees, up to
    the rounding of sums."""
    spark = vectors.sparkSession
    ship_package(spark)
    codes, n_numeric = coding.codes, len(coding.numeric)
    n_codes = len(codes)
    kinds, n, y, *widths = vectors.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("y"),
        *[F.max(c) - F.min(c) + 1 for c in codes]).first()
    if not kinds:
        raise ValueError("no rows to fit on")
    base, args = y / n, (coding.firsts, min_rows, fraction, seed)
    wide = int(np.argmax(widths))
    most = min(most_cells, CELLS_PER_VECTOR * kinds)
    others = [c for c in codes if c != codes[wide]]
    table = bool(others) and widths[wide] <= most \
        and vectors.select(*others).distinct().count() * widths[wide] <= most
    if table or kinds <= most_vectors:
        def run(batches):
            got = [b for b in batches if len(b)]
            m = np.concatenate([_matrix(b, n_codes) for b in got])
            w, t = (np.concatenate([b.column(n_codes + i).to_numpy() for b in got]) for i in (0, 1))
            # One order, however the vectors were written.
            order = np.lexsort(m.T)
            m, w, t = m[order], w[order], t[order]
            engine = Cells(m, w, t, wide, n_numeric, *args) if table \
                else Arrays(m, w, t, n_numeric, *args)
            trees = _fit_in_task(engine, base, rounds, step, leaves)
            rows = _node_rows(trees)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int32() if i < 6 else pa.float64())
                     for i, x in enumerate(zip(*rows))],
                    names=[f.split()[0] for f in NODES.split(", ")])
        nodes = vectors.select(*codes, "n", "y").repartition(1).mapInArrow(run, NODES)
        return LeafwiseModel(coding, base, _read_trees(nodes.collect()), spark)
    # The passes are many and small: their own session without re-planning.
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    files = vectors.inputFiles()
    start = own.read.schema(vectors.schema).parquet(*files) if files else vectors
    state = start.select(*codes, "n", "y", F.lit(base).alias("pred"))
    model, held = LeafwiseModel(coding, base, [], spark), None
    for r in range(rounds):
        if r and r % CUT_EVERY == 0:
            state = materialize(state, "boost-state")
        state = state.persist()
        tree = _grow(Passes(state, r, n_codes, n_numeric, *args, partitions), leaves, step)
        if held is not None:
            held.unpersist()
        held = state
        if tree is not None:
            model.trees.append(tree)
            state = _advance(state, tree, n_codes, n_numeric)
    if held is not None:
        held.unpersist()
    return model
