"""Exact path-dependent Tree SHAP by path weights, over codes.

For a leaf reached through distinct features with fractions z (share of the
parent's rows that follow the path where the feature is unknown) and o (0 or 1:
the row itself follows it), the weights of all subset sizes are one polynomial,
extended by a feature at a time; a feature's contribution is the sum of the
weights with that feature unwound (Lundberg, Erion & Lee, "Consistent
individualized feature attribution for tree ensembles").  The work grows with
the square of the path's length, not with the number of subsets, so trees may
be of any depth; rows that follow the same conditions of a leaf share one
result.

Rows with equal codes have equal contributions, so means over all rows are
taken over the collapsed vectors with their numbers of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators.leafwise import LeafwiseModel, Tree, _matrix, distinct_rows
from salescope.session import ship_package

BASE = "__base__"
TABLE_FEATURES = 8      # a leaf of more features has only met patterns worked out
CHUNK = 1 << 16         # rows explained together


@dataclass
class Path:
    """A leaf: its value, distinct features, their z and conditions."""
    value: float
    features: list[int]
    zero: np.ndarray
    conditions: list[list[tuple[int, bool]]]    # (node, goes left) per feature


def used_features(trees: list[Tree], n_numeric: int) -> list[tuple[int, int]]:
    """(column, code) of the features that are split on; code -2 for numbers."""
    return sorted({(c, -2 if c < n_numeric else k) for t in trees
                   for c, k, left in zip(t.column, t.code, t.left) if left >= 0})


def leaf_paths(tree: Tree, index: dict[tuple[int, int], int], n_numeric: int) -> list[Path]:
    out, stack = [], [(0, [])]
    while stack:
        i, path = stack.pop()
        if tree.left[i] < 0:
            features = sorted({f for f, *_ in path})
            zero = np.ones(len(features))
            conditions = [[] for _ in features]
            for f, node, left, share in path:
                zero[features.index(f)] *= share
                conditions[features.index(f)].append((node, left))
            out.append(Path(tree.value[i], features, zero, conditions))
            continue
        c = tree.column[i]
        f = index[c, -2 if c < n_numeric else tree.code[i]]
        for child, left in ((tree.left[i], True), (tree.right[i], False)):
            stack.append((child, path + [(f, i, left, tree.cover[child] / tree.cover[i])]))
    return out


def path_weights(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """For rows of ``one`` (0/1 per feature): the summed weights of all subsets
    without each feature.  ``zero`` is that of one leaf, or has a row per leaf;
    then the result is leaves x rows x features."""
    rows, m = one.shape
    zero = np.asarray(zero)
    shape = zero.shape[:-1]
    zero = zero[..., None, :]
    w = np.zeros((*shape, rows, m + 1))
    w[..., 0] = 1.0
    for size in range(1, m + 1):        # extend by feature size - 1
        o, z = one[:, size - 1], zero[..., size - 1:size]
        k = np.arange(size)
        grown = w[..., :size] * (o[:, None] * (k + 1) / (size + 1))
        w[..., :size] *= z * (size - k) / (size + 1)
        w[..., 1:size + 1] += grown
    total = np.zeros((*shape, rows, m))
    for f in range(m):                  # unwind it
        o, z = one[:, f] > 0, zero[..., f]
        n = w[..., m].copy()
        for j in range(m - 1, -1, -1):
            with_it = n * (m + 1) / (j + 1)
            total[..., f] += np.where(o, with_it, w[..., j] * (m + 1) / (z * (m - j)))
            n = w[..., j] - with_it * z * (m - j) / (m + 1)
    return total


def patterns(m: int) -> np.ndarray:
    """Every 0/1 row of m features; row i has the bits of i."""
    return ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)


def _alike(codes: np.ndarray, tree: Tree, n_numeric: int, ranks: list) -> tuple:
    """A row of each kind that the tree's conditions tell apart, and the number
    of every row's kind.  ``ranks``: per column its distinct codes and where
    every row's code stands among them."""
    column, code, inner = (np.array(x) for x in (tree.column, tree.code, tree.left))
    classes = []
    for c in np.unique(column[inner >= 0]):
        cuts = np.unique(code[(inner >= 0) & (column == c)])
        values, place = ranks[c]
        k = np.searchsorted(cuts, values)
        if c >= n_numeric:      # a level of its own, or one of the others
            k = np.where(cuts[np.minimum(k, len(cuts) - 1)] == values, k + 1, 0)
        classes.append(k[place])
    return distinct_rows(classes)


def explain(codes: np.ndarray, trees: list[Tree], paths: list[list[Path]], width: int,
            n_numeric: int) -> tuple[np.ndarray, np.ndarray]:
    """SHAP values, features x rows, and the sum of the trees' values.  Each
    tree is worked out for one row of every kind that it tells apart."""
    phi, total = np.zeros((width, len(codes))), np.zeros(len(codes))
    if not len(codes):
        return phi, total
    ranks = [np.unique(x, return_inverse=True) for x in codes.T]
    for tree, leaves in zip(trees, paths):
        if tree.left[0] < 0:
            total += tree.value[0]
            continue
        first, kind = _alike(codes, tree, n_numeric, ranks)
        few = codes[first]
        total += np.array(tree.value)[tree.walk(few, n_numeric)][kind]
        for f, x in _tree_values(few, tree, leaves, n_numeric).items():
            phi[f] += x[kind]
    return phi, total


def contributions(codes: np.ndarray, trees: list[Tree], paths: list[list[Path]], width: int,
                  n_numeric: int) -> np.ndarray:
    """SHAP values, features x rows."""
    return explain(codes, trees, paths, width, n_numeric)[0]


def _tree_values(codes: np.ndarray, tree: Tree, leaves: list[Path], n_numeric: int) -> dict:
    """SHAP values of one tree, by feature."""
    column, code = np.array(tree.column), np.array(tree.code)
    inner = np.flatnonzero(np.array(tree.left) >= 0)
    low = {i: codes[:, column[i]] <= code[i] if column[i] < n_numeric
           else codes[:, column[i]] != code[i] for i in inner}
    # Leaves with equally many features share the work on all their patterns.
    by_size: dict[int, list[Path]] = {}
    for leaf in leaves:
        by_size.setdefault(len(leaf.features), []).append(leaf)
    phi = {f: np.zeros(len(codes)) for leaf in leaves for f in leaf.features}
    for m, alike in by_size.items():
        shared = None
        if m <= TABLE_FEATURES:
            one = patterns(m)
            zero = np.array([leaf.zero for leaf in alike])
            shared = path_weights(one, zero) * (one - zero[:, None]) \
                * np.array([leaf.value for leaf in alike])[:, None, None]
        for number, leaf in enumerate(alike):
            followed = np.ones((m, len(codes)), bool)
            for k, conditions in enumerate(leaf.conditions):
                for node, left in conditions:
                    followed[k] &= low[node] if left else ~low[node]
            if shared is not None:
                at, value = np.zeros(len(codes), np.int64), shared[number]
                for k in range(m):
                    at += followed[k].astype(np.int64) << k
            else:               # the patterns that are met
                kinds, at = distinct_rows(followed.astype(np.int64))
                one = followed[:, kinds].T.astype(float)
                value = path_weights(one, leaf.zero) * (one - leaf.zero) * leaf.value
            for k, f in enumerate(leaf.features):
                phi[f] += value[:, k].take(at)
    return phi


def chunks(batches, rows: int | None = None):
    """The batches, joined to at least ``rows`` rows where there are as many."""
    rows = rows or CHUNK
    held = []
    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(len(x) for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class PathExplainer:
    """Distributed SHAP values of a leaf-wise model."""

    def __init__(self, model: LeafwiseModel):
        ship_package(model.spark)
        self.model, self.n_numeric = model, len(model.coding.numeric)
        self.used = used_features(model.trees, self.n_numeric)
        index = {f: i for i, f in enumerate(self.used)}
        # Bounded by the model: one path per leaf.
        self.paths = [leaf_paths(t, index, self.n_numeric) for t in model.trees]
        self.base_value = model.base + sum(
            v * c / t.cover[0] for t in model.trees
            for v, c, left in zip(t.value, t.cover, t.left) if left < 0)
        self.shared = model.spark.sparkContext.broadcast((model.trees, self.paths))

    def _spread(self, rows: DataFrame, staged: bool = True) -> DataFrame:
        """Spread by ranges of the codes, so that rows of a task are alike.  A
        task works out every tree for each kind of row that it meets, which are
        about as many for few rows as for a chunk: a task per chunk of rows that
        are ``staged`` and so can be counted, whatever the setting for shuffles."""
        tasks = -(-rows.count() // CHUNK) if staged \
            else int(self.model.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(max(1, tasks), *self.model.coding.codes)

    def _named(self) -> DataFrame:
        """number, feature of the features that are split on."""
        spark = self.model.spark
        mine = spark.createDataFrame([(i, c, None if k == -2 else k)
                                      for i, (c, k) in enumerate(self.used)],
                                     "number int, column int, id int").alias("u")
        f = self.model.coding.features().alias("f")
        return f.join(mine, (F.col("f.column") == F.col("u.column"))
                      & F.col("f.id").eqNullSafe(F.col("u.id")), "left") \
            .select("f.feature_index", "f.feature", "f.source", "f.level", "u.number")

    def feature_stats(self, vectors: DataFrame) -> DataFrame:
        """feature_index, feature, source, level, mean_shap, mean_abs_shap over
        all rows that the vectors stand for; features that are never split on
        have 0.  A task emits one row per feature and batch."""
        codes, shared, width, n_numeric = (self.model.coding.codes, self.shared, len(self.used),
                                           self.n_numeric)

        def run(batches):
            trees, paths = shared.value
            for b in chunks(batches):
                n = b.column(len(codes)).to_numpy()
                phi = contributions(_matrix(b, len(codes)), trees, paths, width, n_numeric)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width, dtype=np.int32)), pa.array(phi @ n),
                     pa.array(np.abs(phi) @ n), pa.array(np.full(width, n.sum()))],
                    names=["number", "plain", "absolute", "n"])
        sums = self._spread(vectors.select(*codes, "n")).mapInArrow(
            run, "number int, plain double, absolute double, n double") \
            .groupBy("number").agg((F.sum("plain") / F.sum("n")).alias("mean_shap"),
                                   (F.sum("absolute") / F.sum("n")).alias("mean_abs_shap"))
        zero = F.lit(0.0)
        return self._named().join(sums, "number", "left").select(
            "feature_index", "feature", "source", "level",
            F.coalesce("mean_shap", zero).alias("mean_shap"),
            F.coalesce("mean_abs_shap", zero).alias("mean_abs_shap"))

    def row_values(self, coded: DataFrame, id_col: str, keep: list[str] = (),
                   vectors: DataFrame | None = None) -> DataFrame:
        """id, ``keep`` columns, prediction, base_value and ``values``: a row's
        contribution of each feature that is split on, by the feature's number.
        Rows with equal codes share them, so they are worked out once for each
        distinct vector of codes and joined to the rows.  ``vectors``: these,
        where they are known, staged."""
        codes, shared, width, n_numeric = (self.model.coding.codes, self.shared, len(self.used),
                                           self.n_numeric)
        start = self.model.base
        types = ", ".join(f"{c} {coded.schema[c].dataType.simpleString()}" for c in codes)

        def run(batches):
            trees, paths = shared.value
            for b in chunks(batches):
                phi, total = explain(_matrix(b, len(codes)), trees, paths, width, n_numeric)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(b) + 1, dtype=np.int32) * width), pa.array(phi.T.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total + start), lists],
                                                 names=[*codes, "prediction", "values"])
        distinct = coded.select(*codes).distinct() if vectors is None else vectors.select(*codes)
        kinds = self._spread(distinct, vectors is not None).mapInArrow(
            run, f"{types}, prediction double, values array<double>")
        return coded.select(*codes, id_col, *keep).join(kinds.hint("shuffle_hash"), codes).select(
            id_col, *keep, "prediction", F.lit(self.base_value).alias("base_value"), "values")

    def long(self, coded: DataFrame, id_col: str, vectors: DataFrame | None = None) -> DataFrame:
        """id, feature, shap_value, with a ``__base__`` row per id.  The base
        follows a row's values, so that the rows are read once."""
        rows = self.row_values(coded, id_col, vectors=vectors).select(id_col, F.posexplode(
            F.concat("values", F.array("base_value"))).alias("number", "shap_value"))
        # One row per feature that the model splits on.
        names = self._named().where("number IS NOT NULL").select("number", "feature").unionByName(
            self.model.spark.createDataFrame([(len(self.used), BASE)], "number int, feature string"))
        return rows.join(F.broadcast(names), "number").select(id_col, "feature", "shap_value")
