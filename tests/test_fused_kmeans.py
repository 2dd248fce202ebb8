"""All restarts in one job per iteration, against plain Lloyd steps."""

import numpy as np
import pytest

from salescope.operators.fused_kmeans import fused_kmeans, step_sums
from salescope.session import materialize

COLS = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [5, 0], [0, 5], [6, 6]])
    p = np.concatenate([c + rng.normal(size=(100, 2)) * 0.4 for c in centres])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(p)]
    df = spark.createDataFrame(rows + [(1000, None, 1.0)], "id long, x double, y double")
    return p, centres, materialize(df, "points")


def test_finds_the_groups(points):
    p, centres, df = points
    fits = fused_kmeans(df, COLS, "id", 4, restarts=5)
    best = min(fits, key=lambda f: f.inertia)
    got = np.array(sorted(best.centres.tolist()))
    np.testing.assert_allclose(got, np.array(sorted(centres.tolist())), atol=0.2)
    d = ((p[:, None] - best.centres[None]) ** 2).sum(axis=2)
    assert best.inertia == pytest.approx(d.min(axis=1).sum())
    # A fixed point of the plain step.
    moved = np.array([p[d.argmin(axis=1) == j].mean(axis=0) for j in range(4)])
    np.testing.assert_allclose(moved, best.centres, atol=1e-4)
    assert all(f.inertia >= best.inertia for f in fits)


def test_same_result_on_any_partitioning(points):
    _, _, df = points
    a = fused_kmeans(df, COLS, "id", 3, restarts=3)
    b = fused_kmeans(materialize(df.repartition(7), "points"), COLS, "id", 3, restarts=3)
    for s, t in zip(a, b):
        np.testing.assert_allclose(s.centres, t.centres, rtol=1e-9)
        assert s.inertia == pytest.approx(t.inertia)


def test_step_serves_all_restarts(points):
    p, _, df = points
    given = {0: p[:3], 1: p[10:12]}
    rows = step_sums(df, COLS, given).collect()
    for r, c in given.items():
        d = ((p[:, None] - c[None]) ** 2).sum(axis=2)
        mine = [x for x in rows if x["restart"] == r]
        assert sum(x["n"] for x in mine) == len(p)
        assert sum(x["cost"] for x in mine) == pytest.approx(d.min(axis=1).sum())


def test_more_clusters_than_points(spark):
    df = materialize(spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "id long, x double, y double"), "p")
    fit = fused_kmeans(df, COLS, "id", 3, restarts=2)[0]
    assert fit.inertia == 0 and fit.centres.shape == (3, 2)


def test_inertia_for_several_k_reads_the_facts_once(spark, monkeypatch):
    """The metrics per store are worked out once for all numbers of segments,
    and give the inertia of a fit on its own."""
    from salescope.operators import segments as seg
    from salescope.operators.filters import FilterSpec
    from salescope.plans.registry import segment_inertia
    from salescope.sources.star import star_from_tpch
    calls, plain = [], seg.store_metrics

    def counted(*args):
        calls.append(args)
        return plain(*args)
    monkeypatch.setattr(seg, "store_metrics", counted)
    got = {r["n_clusters"]: r["inertia"] for r in segment_inertia(spark, "/root/testdata/sf0.001").collect()}
    assert len(calls) == 1 and sorted(got) == [2, 4, 8]
    alone = seg.segment_stores(star_from_tpch(spark, "/root/testdata/sf0.001"), n_clusters=4).inertia
    assert abs(alone - got[4]) < 1e-9 * max(1.0, alone)
