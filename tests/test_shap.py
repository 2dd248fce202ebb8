"""SHAP kernel against brute-force subset enumeration on a tiny ensemble."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from salescope.operators.shap import TreeExplainer, build_leaves, shap_matrix
from salescope.operators.trees import fit_trees


def cond_expectation(t, x, known, node):
    n = t.loc[node]
    if int(n["left"]) < 0:
        return float(n["prediction"])
    f, thr = int(n["feature"]), float(n["threshold"])
    left, right = int(n["left"]), int(n["right"])
    if f in known:
        return cond_expectation(t, x, known, left if x[f] <= thr else right)
    cl, cr = float(t.loc[left, "cover"]), float(t.loc[right, "cover"])
    return (cl * cond_expectation(t, x, known, left)
            + cr * cond_expectation(t, x, known, right)) / (cl + cr)


def brute_shap(nodes, weights, x, m):
    phi = np.zeros(m)
    for tid, t in nodes.groupby("tree_id"):
        t = t.set_index("node_id")
        root = int(t.index.min())
        w = weights[int(tid)]
        for i in range(m):
            others = [j for j in range(m) if j != i]
            for k in range(m):
                for s in combinations(others, k):
                    wt = factorial(k) * factorial(m - k - 1) / factorial(m)
                    phi[i] += w * wt * (cond_expectation(t, x, set(s) | {i}, root)
                                        - cond_expectation(t, x, set(s), root))
    return phi


@pytest.fixture(scope="module")
def tiny(spark):
    df = spark.range(400).selectExpr(
        "cast(id % 10 as double) a", "cast((id * 7) % 13 as double) b",
        "cast((id * 3) % 5 as double) c",
        "cast(id % 10 as double) * 2 + cast((id * 7) % 13 as double) * cast((id * 3) % 5 as double) y")
    return df, fit_trees(df, ["a", "b", "c"], "y", rounds=4, max_depth=3, min_instances=1)


def test_matches_brute_force(tiny):
    _, tm = tiny
    nodes = tm.nodes()
    leaves, _ = build_leaves(nodes, tm.weights)
    rng = np.random.default_rng(0)
    xs = np.column_stack([rng.integers(0, 10, 6), rng.integers(0, 13, 6),
                          rng.integers(0, 5, 6)]).astype(float)
    fast = shap_matrix(xs, leaves)
    for r in range(len(xs)):
        np.testing.assert_allclose(fast[r], brute_shap(nodes, tm.weights, xs[r], 3), atol=1e-9)


def test_additivity_distributed(tiny):
    from pyspark.sql import functions as F
    df, tm = tiny
    ex = TreeExplainer(tm)
    w = ex.shap_wide(tm.predict(df))
    err = w.select(F.max(F.abs(F.col("shap_a") + F.col("shap_b") + F.col("shap_c")
                               + F.lit(ex.base_value) - F.col("prediction")))).first()[0]
    assert err < 1e-8
    st = ex.feature_stats(df).collect()
    assert len(st) == 3 and all(r.mean_abs_shap >= abs(r.mean_shap) for r in st)


def test_forest_additivity(spark, tiny):
    from pyspark.sql import functions as F
    df, _ = tiny
    tm = fit_trees(df, ["a", "b", "c"], "y", rounds=5, max_depth=3, min_instances=1,
                   algorithm="forest", feature_fraction="all")
    ex = TreeExplainer(tm)
    w = ex.shap_wide(tm.predict(df))
    err = w.select(F.max(F.abs(F.col("shap_a") + F.col("shap_b") + F.col("shap_c")
                               + F.lit(ex.base_value) - F.col("prediction")))).first()[0]
    assert err < 1e-8
