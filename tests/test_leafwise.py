"""Leaf-wise boosting and path-weight SHAP against plain versions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.operators import leafwise as lw
from salescope.operators.path_shap import PathExplainer, contributions, leaf_paths, used_features
from salescope.session import materialize


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(3000).selectExpr(
        "id", "IF(id % 97 = 0, NULL, cast(id % 40 AS double)) a", "cast(id * 7 % 13 AS double) b",
        "IF(id % 89 = 0, NULL, concat('g', id * 2 % 9)) g", "concat('w', id * 11 % 1500) w",
        "cast(id % 40 AS double) * 2 + cast(id * 7 % 13 AS double) * (id * 2 % 9) "
        "+ IF(id * 11 % 1500 < 40, 300, 0) + (id * id * 31 % 17) AS y")
    coding = lw.fit_coding(df, ["a", "b"], ["g", "w"], max_bins=16)
    coded = materialize(coding.encode(df), "coded")
    return df, coding, coded, materialize(lw.collapse(coded, coding.codes, "y"), "vectors")


def test_bins_and_levels(data, spark):
    df, coding, coded, vectors = data
    assert len(coding.uppers[0]) <= 16 and len(coding.uppers[1]) == 13
    rows = df.select("id", "a", "b", "g", "w").collect()
    code = {r["id"]: r for r in coded.collect()}
    levels = {(r["column"], r["level"]): r["id"] for r in coding.levels.collect()}
    assert sorted(levels.values()) == list(range(9 + 1500))     # a column of 1,500 levels
    assert [k for k, _ in sorted(levels.items(), key=lambda x: x[1])] == sorted(levels)
    for r in rows:
        c = code[r["id"]]
        assert c["c0"] == (0 if r["a"] is None else 1 + sum(u < r["a"] for u in coding.uppers[0]))
        assert c["c2"] == levels.get((0, r["g"]), -1) and c["c3"] == levels[1, r["w"]]
    assert vectors.agg(F.sum("n")).first()[0] == 3000
    f = coding.features()
    assert f.count() == 2 + 8 + 1499 and f.agg(F.max("feature_index")).first()[0] == 1508
    many = lw.bin_edges(spark.range(10000).selectExpr("cast(id * 7919 % 10007 AS double) v"), ["v"], 10)
    assert [r["n"] for r in many.orderBy("bin").collect()] == [1000] * 10


def plain_tree(codes, g, n, coding, leaves, min_rows):
    """Best-first growth with sums from scratch for every leaf."""
    k = len(coding.numeric)

    def best(rows):
        out = (0.0, None)
        gs, ns = g[rows].sum(), n[rows].sum()
        for c in range(codes.shape[1]):
            for v in np.unique(codes[rows, c]):
                if c >= k and v in (-1, coding.firsts[c - k]):
                    continue
                low = codes[rows, c] <= v if c < k else codes[rows, c] != v
                nl, gl = n[rows][low].sum(), g[rows][low].sum()
                if min(nl, ns - nl) < min_rows:
                    continue
                gain = gl ** 2 / nl + (gs - gl) ** 2 / (ns - nl) - gs ** 2 / ns
                if gain > out[0] + 1e-9 * abs(out[0]):
                    out = (gain, (c, v))
        return out

    open_leaves = [(np.arange(len(g)), best(np.arange(len(g))))]
    while len(open_leaves) < leaves:
        i = max(range(len(open_leaves)), key=lambda i: open_leaves[i][1][0])
        rows, (gain, cut) = open_leaves[i]
        if cut is None:
            break
        low = codes[rows, cut[0]] <= cut[1] if cut[0] < k else codes[rows, cut[0]] != cut[1]
        del open_leaves[i]
        open_leaves += [(rows[low], best(rows[low])), (rows[~low], best(rows[~low]))]
    value = np.zeros(len(g))
    for rows, _ in open_leaves:
        value[rows] = g[rows].sum() / n[rows].sum()
    return value


def arrays(data):
    _, coding, _, vectors = data
    p = vectors.toPandas()
    return p[coding.codes].to_numpy().astype(np.int64), p["n"].to_numpy(), p["y"].to_numpy()


def test_trees_equal_plain_growth(data):
    _, coding, _, vectors = data
    codes, n, y = arrays(data)
    m = lw.fit_leafwise(coding, vectors, rounds=3, step=0.5, leaves=9, min_rows=5, fraction=1.0)
    pred = np.full(len(n), m.base)
    for t in m.trees:
        want = 0.5 * plain_tree(codes, y - n * pred, n, coding, 9, 5)
        got = np.array(t.value)[t.walk(codes, 2)]
        np.testing.assert_allclose(got, want, atol=1e-7)
        pred = pred + got
        assert sum(x < 0 for x in t.left) == 9


def test_passes_equal_one_task(data):
    _, coding, coded, vectors = data
    a, b = (lw.fit_leafwise(coding, vectors, rounds=2, leaves=6, most_vectors=most, seed=3)
            for most in (lw.TASK_VECTORS, 0))
    for s, t in zip(a.trees, b.trees, strict=True):
        assert (s.column, s.code, s.left) == (t.column, t.code, t.left)
        np.testing.assert_allclose(s.value, t.value)
    p = a.predict(coded.select(*coding.codes, "id"))
    assert p.count() == 3000 and p.columns[-2:] == ["id", "prediction"]


def test_save_and_load(data, spark, tmp_path):
    _, coding, coded, vectors = data
    m = lw.fit_leafwise(coding, vectors, rounds=4, leaves=6)
    m.save(str(tmp_path / "m"))
    back = lw.load_leafwise(spark, str(tmp_path / "m"))
    rows = coded.drop(*coding.codes)

    def run(x):
        return x.predict(x.coding.encode(rows).select(*coding.codes, "id")).orderBy("id").collect()
    assert [r["prediction"] for r in run(m)] == [r["prediction"] for r in run(back)]
    splits = m.importance("split")
    assert splits.count() == 1509 and splits.agg(F.sum("Importance")).first()[0] == 4 * 5
    assert m.importance("gain").agg(F.sum("Importance")).first()[0] == pytest.approx(1.0)


def test_unfitted_and_empty(data):
    _, coding, coded, vectors = data
    with pytest.raises(ValueError, match="no trees"):
        lw.LeafwiseModel(coding, 0.0, [], coded.sparkSession).predict(coded)
    with pytest.raises(ValueError, match="no rows"):
        lw.fit_leafwise(coding, vectors.limit(0))


def expectation(t, row, known, k, i=0):
    if t.left[i] < 0:
        return t.value[i]
    f = (t.column[i], -2 if t.column[i] < k else t.code[i])
    low, high = t.left[i], t.right[i]
    if f in known:
        x = row[t.column[i]]
        return expectation(t, row, known, k, low if (
            x <= t.code[i] if t.column[i] < k else x != t.code[i]) else high)
    return (t.cover[low] * expectation(t, row, known, k, low)
            + t.cover[high] * expectation(t, row, known, k, high)) / t.cover[i]


def test_shap_equals_enumeration_of_subsets(data):
    """Deep, narrow trees: paths longer than ten splits."""
    _, coding, _, _ = data
    codes, n, y = arrays(data)
    engine = lw.Arrays(codes, n, y, 2, coding.firsts, 1, 1.0, 0)
    engine.start(0, np.full(len(n), y.sum() / n.sum()))
    tree = lw._grow(engine, 24, 1.0)
    used = used_features([tree], 2)[:]
    paths = leaf_paths(tree, {f: i for i, f in enumerate(used)}, 2)
    depth = max(sum(len(c) for c in p.conditions) for p in paths)
    assert depth >= 10
    few = codes[[0, 7, 500, len(codes) - 1]]
    got = contributions(few, [tree], [paths], len(used), 2)
    m = len(used)
    if m > 12:      # enumerate over a tree of at most twelve features
        tree = lw.Tree(*[list(getattr(tree, f)) for f in tree.__dataclass_fields__])
        for i in reversed(range(len(tree.left))):
            if len(used_features([tree], 2)) > 12 and tree.left[i] >= 0 \
                    and tree.left[tree.left[i]] < 0 and tree.left[tree.right[i]] < 0:
                tree.left[i] = tree.right[i] = -1
        used = used_features([tree], 2)
        m = len(used)
        got = contributions(few, [tree], [leaf_paths(tree, {f: i for i, f in enumerate(used)}, 2)], m, 2)
    for r, row in enumerate(few):
        memo = {s: expectation(tree, row, set(s), 2) for k in range(m + 1)
                for s in combinations(used, k)}
        for i, f in enumerate(used):
            rest = [x for x in used if x != f]
            want = sum(factorial(k) * factorial(m - k - 1) / factorial(m)
                       * (memo[tuple(sorted((*s, f)))] - memo[s])
                       for k in range(m) for s in combinations(rest, k))
            assert got[i, r] == pytest.approx(want, abs=1e-8)


def test_shap_over_vectors_equals_over_rows(data):
    _, coding, coded, vectors = data
    m = lw.fit_leafwise(coding, vectors, rounds=5, leaves=8)
    ex = PathExplainer(m)
    st = {r["feature"]: r for r in ex.feature_stats(vectors).collect()}
    assert len(st) == 1509
    rows = ex.long(coded, "id")
    per = {r["feature"]: r for r in rows.groupBy("feature").agg(
        F.avg("shap_value").alias("m"), F.avg(F.abs("shap_value")).alias("a")).collect()}
    for f, r in per.items():
        if f != "__base__":
            assert r["m"] == pytest.approx(st[f]["mean_shap"], abs=1e-8)
            assert r["a"] == pytest.approx(st[f]["mean_abs_shap"], abs=1e-8)
    off = rows.groupBy("id").agg(F.sum("shap_value").alias("s")).join(
        m.predict(coded.select(*coding.codes, "id")), "id")
    assert off.where("abs(s - prediction) > 1e-7").count() == 0


def test_sample_does_not_clump(spark):
    from salescope.operators.drivers import sample_by_id
    df = spark.range(4000).selectExpr("id AS transaction_id", "1.0 AS revenue").repartition(5)
    got = sample_by_id(df, 100)
    assert got.count() == 100
    assert got.exceptAll(sample_by_id(df.repartition(3), 100)).count() == 0


def test_lookup_reads_one_row_group(ref_star):
    from salescope.operators import drivers as drv
    from salescope.operators.filters import FilterSpec
    dm = drv.fit_drivers(ref_star, FilterSpec(), rounds=3)
    one = dm.lookup([77])
    assert "PushedFilters: [In(transaction_id" in one._jdf.queryExecution().executedPlan().toString() \
        or "EqualTo(transaction_id,77)" in one._jdf.queryExecution().executedPlan().toString()
    out = drv.local_explanation(dm, [77]).collect()
    assert {r["transaction_id"] for r in out} == {77} and "__base__" in {r["feature"] for r in out}
