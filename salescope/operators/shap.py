"""Exact path-dependent Tree SHAP for MLlib tree ensembles, on executors.

For one leaf with value v reached through the distinct split features S,
let h_i (0/1) say whether a row satisfies every split on feature i along the
path and c_i be the product of child/parent cover ratios of those splits.
The leaf's contribution to feature i is

    v · (h_i − c_i) · Σ_{U ⊆ S∖{i}, U ⊆ hot} |U|!(|S|−|U|−1)!/|S|! · Π_{j ∈ S∖U∖{i}} c_j

(Lundberg, Erion & Lee, "Consistent individualized feature attribution for
tree ensembles", path-dependent expectation).  It depends on a row only
through its hot pattern, a |S|-bit number, so the driver tabulates every
leaf once (2^|S| × |S| values, |S| ≤ depth) and executors do one table
lookup per leaf per row.  The tables grow with the model, never with the
data; rows are processed in Arrow batches by ``mapInPandas``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators.trees import TreeModel
from salescope.session import ship_package


@dataclass
class Leaf:
    features: np.ndarray     # distinct split features on the path (|S|,)
    slots: list              # per feature slot: [(node position, goes_left), ...]
    table_t: np.ndarray      # (|S|, 2^|S|) contributions, tree weight included


@dataclass
class Tree:
    node_feat: np.ndarray    # internal nodes of the tree: split feature
    node_thr: np.ndarray     # and threshold (row goes left when x <= thr)
    leaves: list


def _leaf_table(v: float, cold: np.ndarray) -> np.ndarray:
    s = len(cold)
    patterns = np.arange(1 << s)
    out = np.zeros((1 << s, s))
    w = [factorial(k) * factorial(s - k - 1) / factorial(s) for k in range(s)]
    for i in range(s):
        others = [j for j in range(s) if j != i]
        masks, weights = [], []
        for k in range(len(others) + 1):
            for u in combinations(others, k):
                m = 0
                for j in u:
                    m |= 1 << j
                rest = [j for j in others if j not in u]
                masks.append(m)
                weights.append(w[k] * float(np.prod(cold[rest])) if rest else w[k])
        masks = np.array(masks)
        inside = (patterns[:, None] & masks[None, :]) == masks[None, :]
        hot_i = (patterns >> i) & 1
        out[:, i] = v * (hot_i - cold[i]) * (inside @ np.array(weights))
    return out


def build_leaves(nodes: pd.DataFrame, weights: list[float]):
    """Per-tree split arrays and leaf tables for the whole ensemble, and the
    base value (Σ tree weight × cover-weighted mean leaf value)."""
    trees: list[Tree] = []
    base = 0.0
    for tree_id, t in nodes.groupby("tree_id"):
        w = float(weights[int(tree_id)])
        t = t.set_index("node_id")
        internal = [int(i) for i in t.index if int(t.loc[i, "left"]) >= 0]
        pos = {nid: k for k, nid in enumerate(internal)}
        tree = Tree(np.array([int(t.loc[i, "feature"]) for i in internal], dtype=np.int64),
                    np.array([float(t.loc[i, "threshold"]) for i in internal]), [])
        root = int(t.index.min())
        root_cover = float(t.loc[root, "cover"])
        stack = [(root, [])]
        while stack:
            nid, path = stack.pop()
            n = t.loc[nid]
            if int(n["left"]) < 0:
                v = w * float(n["prediction"])
                base += v * float(n["cover"]) / root_cover
                feats = sorted({p[0] for p in path})
                slot = {f: k for k, f in enumerate(feats)}
                cold = np.ones(len(feats))
                conds = [[] for _ in feats]
                for f, node, left, ratio in path:
                    cold[slot[f]] *= ratio
                    conds[slot[f]].append((pos[node], left))
                if feats:
                    tree.leaves.append(Leaf(np.array(feats, dtype=np.int64), conds,
                                            np.ascontiguousarray(_leaf_table(v, cold).T)))
                continue
            f, cover = int(n["feature"]), float(n["cover"])
            for child, left in ((int(n["left"]), True), (int(n["right"]), False)):
                ratio = float(t.loc[child, "cover"]) / cover if cover > 0 else 0.0
                stack.append((child, path + [(f, nid, left, ratio)]))
        trees.append(tree)
    return trees, base


def shap_matrix(x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """SHAP values (rows × features) for a dense batch.

    Works on feature-major, contiguous arrays: each internal node is compared
    once per row, each leaf ANDs its path decisions into a hot pattern and
    gathers its contributions from its table.
    """
    n, m = x.shape
    xt = np.ascontiguousarray(x.T)
    phi = np.zeros((m, n))
    for tree in trees:
        go_left = xt[tree.node_feat] <= tree.node_thr[:, None]
        go_right = ~go_left
        for lf in tree.leaves:
            pattern = np.zeros(n, dtype=np.int64)
            for k, conds in enumerate(lf.slots):
                node, left = conds[0]
                hot = go_left[node] if left else go_right[node]
                for node, left in conds[1:]:
                    hot = hot & (go_left[node] if left else go_right[node])
                pattern |= hot.astype(np.int64) << k
            for k, f in enumerate(lf.features):
                phi[f] += lf.table_t[k][pattern]
    return phi.T


MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def table_bytes(trees: list) -> int:
    return int(sum(t.node_feat.nbytes + t.node_thr.nbytes
                   + sum(lf.table_t.nbytes + lf.features.nbytes for lf in t.leaves)
                   for t in trees))


def index_lookup(values: list, index):
    """``values[index]`` as an expression over a literal map."""
    m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(i), F.lit(v))])
    return F.element_at(m, index.cast("int"))


class TreeExplainer:
    """Distributed SHAP for a :class:`TreeModel`."""

    def __init__(self, tm: TreeModel):
        self.tm = tm
        ship_package(tm.spark)
        leaves, base = build_leaves(tm.nodes(), tm.weights)
        self.base_value = float(base)
        # Broadcast once.  The size is bounded by the model (trees × leaves ×
        # 2^depth × depth doubles), never by the data; checked all the same.
        size = table_bytes(leaves)
        if size > MAX_BROADCAST_BYTES:
            raise ValueError(f"SHAP tables take {size} bytes (> {MAX_BROADCAST_BYTES}); "
                             "use fewer rounds or shallower trees")
        self.table_bytes = size
        self._bc = tm.spark.sparkContext.broadcast(leaves)

    def _dense(self, pdf: pd.DataFrame) -> np.ndarray:
        return pdf[self.tm.features].to_numpy(dtype=np.float64, na_value=np.nan)

    def feature_stats(self, df: DataFrame) -> DataFrame:
        """Per feature over all rows of ``df``: mean SHAP and mean |SHAP|.

        Each task folds its rows into one partial row per feature, so the
        shuffle carries (tasks × features) rows whatever the data size.
        """
        names = self.tm.features
        bc = self._bc

        def kernel(batches):
            acc_s = np.zeros(len(names))
            acc_a = np.zeros(len(names))
            count = 0
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                phi = shap_matrix(pdf[names].to_numpy(dtype=np.float64), bc.value)
                acc_s += phi.sum(axis=0)
                acc_a += np.abs(phi).sum(axis=0)
                count += len(pdf)
            if count:
                yield pd.DataFrame({"feature_index": np.arange(len(names)),
                                    "sum_shap": acc_s, "sum_abs": acc_a,
                                    "n": np.full(len(names), count, dtype=np.int64)})

        parts = df.select(*names).mapInPandas(
            kernel, "feature_index long, sum_shap double, sum_abs double, n long")
        agg = (parts.groupBy("feature_index")
               .agg((F.sum("sum_shap") / F.sum("n")).alias("mean_shap"),
                    (F.sum("sum_abs") / F.sum("n")).alias("mean_abs_shap")))
        # Feature names are model metadata (one per feature): a literal map,
        # not a join.
        return agg.select("feature_index", index_lookup(names, F.col("feature_index"))
                          .alias("feature"), "mean_shap", "mean_abs_shap")

    def shap_long(self, df: DataFrame, id_col: str) -> DataFrame:
        """Per-row attributions in long form (id, feature, shap_value) plus
        one ``__base__`` row per id carrying the base value."""
        names = self.tm.features
        bc = self._bc
        base = self.base_value
        id_type = df.schema[id_col].dataType.simpleString()

        def kernel(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                phi = shap_matrix(pdf[names].to_numpy(dtype=np.float64), bc.value)
                ids = pdf[id_col].to_numpy()
                k = len(names)
                yield pd.DataFrame({
                    id_col: np.concatenate([np.repeat(ids, k), ids]),
                    "feature": np.concatenate([np.tile(np.array(names, dtype=object), len(ids)),
                                               np.full(len(ids), "__base__", dtype=object)]),
                    "shap_value": np.concatenate([phi.reshape(-1), np.full(len(ids), base)])})

        return df.select(id_col, *names).mapInPandas(
            kernel, f"{id_col} {id_type}, feature string, shap_value double")

    def shap_wide(self, df: DataFrame, prefix: str = "shap_") -> DataFrame:
        """``df`` plus one ``shap_<feature>`` column per feature."""
        names = self.tm.features
        bc = self._bc
        out_schema = df.schema
        from pyspark.sql.types import DoubleType, StructField, StructType
        out_schema = StructType(list(df.schema.fields)
                                + [StructField(prefix + n, DoubleType()) for n in names])

        def kernel(batches):
            for pdf in batches:
                phi = (shap_matrix(pdf[names].to_numpy(dtype=np.float64), bc.value)
                       if len(pdf) else np.zeros((0, len(names))))
                extra = pd.DataFrame(phi, columns=[prefix + n for n in names], index=pdf.index)
                yield pd.concat([pdf, extra], axis=1)

        return df.mapInPandas(kernel, out_schema)
