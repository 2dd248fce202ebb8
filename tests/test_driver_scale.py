"""Training and SHAP whose work follows the codes' combinations, not the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.operators import leafwise as lw
from salescope.operators import path_shap as ps
from salescope.session import materialize


@pytest.fixture(scope="module")
def dense(spark):
    """Every combination of the codes but some: 20 x 6 x 5 x 4."""
    df = spark.range(9600).where("id % 7 <> 3").selectExpr(
        "id", "cast(id % 20 AS double) a", "cast(floor(id / 20) % 6 AS double) b",
        "concat('g', floor(id / 120) % 5) g", "concat('w', floor(id / 600) % 4) w",
        "cast(id % 20 AS double) * (1 + floor(id / 120) % 5) + (id * id * 31 % 57) AS y")
    coding = lw.fit_coding(df, ["a", "b"], ["g", "w"])
    coded = materialize(coding.encode(df), "coded")
    return coding, coded, materialize(lw.collapse(coded, coding.codes, "y"), "vectors")


def test_table_of_cells_gives_the_same_trees_without_passes(dense, monkeypatch):
    coding, _, vectors = dense
    args = dict(rounds=6, leaves=12, step=0.3, seed=5)
    one = lw.fit_leafwise(coding, vectors, most_cells=0, **args)
    passes = lw.fit_leafwise(coding, vectors, most_cells=0, most_vectors=0, **args | {"rounds": 2})

    def refuse(*_):
        raise AssertionError("a job per pass")
    monkeypatch.setattr(lw, "Passes", refuse)
    cells = lw.fit_leafwise(coding, vectors, most_vectors=0, **args)
    for want in (one, passes):
        for s, t in zip(want.trees, cells.trees):
            assert (s.column, s.code, s.left, s.right) == (t.column, t.code, t.left, t.right)
            np.testing.assert_allclose(s.value, t.value, atol=1e-9)
            np.testing.assert_allclose(s.cover, t.cover)
    assert len(cells.trees) == 6


@pytest.mark.parametrize("wide", [0, 1, 2, 3])
def test_any_column_may_be_the_wide_one(dense, wide):
    coding, _, vectors = dense
    p = vectors.toPandas()
    codes, n, y = p[coding.codes].to_numpy().astype(np.int64), p["n"].to_numpy(), p["y"].to_numpy()
    args = (2, coding.firsts, 3, 0.9, 1)
    base = y.sum() / n.sum()
    want, got = (lw._fit_in_task(e, base, 3, 0.5, 10) for e in (
        lw.Arrays(codes, n, y, *args), lw.Cells(codes, n, y, wide, *args)))
    for s, t in zip(want, got, strict=True):
        assert (s.column, s.code, s.left) == (t.column, t.code, t.left)
        np.testing.assert_allclose(s.value, t.value, atol=1e-9)


def test_distinct_rows_of_wide_codes():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (5, 300)) * (1 << 30) - 5
    first, place = lw.distinct_rows(x)
    assert len(first) == len(np.unique(x, axis=1).T)
    np.testing.assert_array_equal(x[:, first][:, place], x)


def test_patterns_by_table_equal_patterns_met(dense, monkeypatch):
    coding, _, vectors = dense
    m = lw.fit_leafwise(coding, vectors, rounds=4, leaves=16)
    ex = ps.PathExplainer(m)
    codes = vectors.select(*coding.codes).toPandas().to_numpy().astype(np.int64)
    phi, total = ps.explain(codes, m.trees, ex.paths, len(ex.used), 2)
    monkeypatch.setattr(ps, "TABLE_FEATURES", 0)
    again = ps.contributions(codes, m.trees, ex.paths, len(ex.used), 2)
    np.testing.assert_allclose(phi, again, atol=1e-10)
    np.testing.assert_allclose(phi.sum(axis=0) + ex.base_value, total + m.base, atol=1e-8)


def test_equal_rows_are_explained_once(dense, spark):
    """The explained rows are the distinct vectors, however often a row repeats."""
    coding, coded, vectors = dense
    m = lw.fit_leafwise(coding, vectors, rounds=3, leaves=8)
    ex = ps.PathExplainer(m)
    many = coded.crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    rows = ex.row_values(many, "id", ["copy", "y"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate [c0")
    off = F.abs(F.aggregate("values", F.col("base_value"), lambda s, x: s + x) - F.col("prediction"))
    got = rows.agg(F.count(F.lit(1)), F.countDistinct("id", "copy"), F.max(off)).first()
    assert got[0] == got[1] == 3 * coded.count() and got[2] < 1e-8


def test_coding_reads_the_joined_rows_once(spark):
    """Bins, levels and codes read a staged copy, without the joins."""
    from salescope.plans.registry import _coded
    coding, plain = _coded(spark, "/root/testdata/sf0.001")
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plain.count() > 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 16, 17, 212, 255])
def test_codes_look_at_one_group_of_edges(spark, n):
    """A row is compared with some 2 sqrt(n) of n edges, and gets the number of
    all that are below it."""
    edges = [float(i * i) for i in range(n)]
    groups = lw.edge_groups(edges)
    assert sum(groups, []) == edges and len(groups) + max(map(len, groups), default=0) <= 33
    xs = sorted({x + d for x in edges for d in (-0.5, 0.0, 0.5)} | {-1.0, 1e9, float("inf")})
    got = spark.createDataFrame([(x,) for x in [*xs, float("nan")]], "x double").select(
        "x", lw._number_below(edges, F.col("x")).alias("k")).collect()
    assert [r["k"] for r in got] == [sum(e < x for e in edges) for x in xs] + [n]


def test_rows_are_ordered_by_id_only_for_lookups(ref_star):
    """The model and the means of its SHAP values write the vectors, not a copy
    of every row; the sample is coded after it is taken."""
    from salescope.operators import drivers as drv
    from salescope.operators.filters import FilterSpec
    from salescope.session import recorded_tables
    with recorded_tables() as paths:
        dm = drv.fit_drivers(ref_star, FilterSpec(), rounds=3)
        assert dm.model.importance("split").count() > 0 and drv.explain_entries(dm).count() > 0
        sampled = drv.shap_stats(dm, 50)
        assert sampled.count() == dm.feature_frame().count()
        assert not [p for p in paths if "driver-matrix" in p]
        kept = drv.sample_by_id(dm.matrix, 50).select(drv.ID).collect()
        assert [p for p in paths if "driver-matrix" in p]
    assert sorted(kept) == sorted(drv.sample_by_id(dm.plain, 50).select(drv.ID).collect())
    assert dm.matrix.count() == dm.plain.count() == dm.vectors.agg(F.sum("n")).first()[0]


def test_every_row_is_explained_from_one_read(ref_star):
    """The given vectors' values and the base are joined to the rows in one
    pass: as many rows as by looking each up, and the same values."""
    from salescope.operators import drivers as drv
    from salescope.operators.filters import FilterSpec
    dm = drv.fit_drivers(ref_star, FilterSpec(), rounds=3)
    out = drv.all_explanations(dm)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transaction_id#") and len(
        [x for x in plan.splitlines() if "Relation [" in x and "transaction_id#" in x]) == 1
    width = len(dm.explainer.used) + 1
    assert out.count() == width * dm.plain.count()
    ids = [r[0] for r in dm.plain.select(drv.ID).distinct().limit(20).collect()]
    one = drv.local_explanation(dm, ids)
    got = out.where(F.col(drv.ID).isin(ids)).groupBy(drv.ID, "feature").agg(F.sum("shap_value").alias("v"))
    want = one.groupBy(drv.ID, "feature").agg(F.sum("shap_value").alias("w"))
    both = got.join(want, [drv.ID, "feature"], "full")
    assert both.count() == want.count()
    assert both.where("v IS NULL OR w IS NULL OR abs(v - w) > 1e-9").count() == 0


def test_a_task_explains_a_chunk_of_rows(dense, spark):
    """Not one task per shuffle partition: each works out every tree anew."""
    coding, coded, vectors = dense
    m = lw.fit_leafwise(coding, vectors, rounds=3, leaves=8)
    ex = ps.PathExplainer(m)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert ex._spread(vectors).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
