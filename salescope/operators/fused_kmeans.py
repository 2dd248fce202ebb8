"""k-means with all restarts in one job per iteration.

Every pass over the points serves all restarts: Arrow batches give partial sums
keyed (restart, cluster), one aggregate adds them up, and restarts x k rows
come back.  Seeding oversamples by weight (k-means||): in each of a few rounds
a point joins a restart's candidates with a chance in proportion to its squared
distance from them, decided by a hash of (seed, restart, round, id), so the
choice does not depend on the partitioning.  Candidates are weighted by the
points nearest to them and reduced to k; both are bounded by the restarts, the
rounds and the oversampling, not by the points.

Cases: fewer distinct points than k leave clusters empty, which keep their
centre; equal distances go to the smaller cluster number; a point with a null
component is nearest to no centre and takes no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.session import ship_package

ROUNDS, OVERSAMPLE = 4, 2.0


@dataclass
class Fit:
    centres: np.ndarray     # k x features
    inertia: float
    iterations: int


def _points(batch: pa.RecordBatch, width: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(float)
                         for i in range(width)])
    return x, ~np.isnan(x).any(axis=1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def step_sums(points: DataFrame, cols: list[str], centres: dict[int, np.ndarray]) -> DataFrame:
    """restart, cluster, n, cost, s0..: sums of the points nearest to every
    centre, for all given restarts."""
    width = len(cols)
    names = ["restart", "cluster", "n", "cost", *[f"s{i}" for i in range(width)]]

    def run(batches):
        for b in batches:
            x, ok = _points(b, width)
            x = x[ok]
            rows = []
            for r, c in centres.items():
                d = _distances(x, c)
                at = d.argmin(axis=1) if len(x) else np.zeros(0, int)
                n = np.bincount(at, minlength=len(c))
                cost = np.bincount(at, d[np.arange(len(x)), at], len(c))
                sums = [np.bincount(at, x[:, i], len(c)) for i in range(width)]
                rows += [(r, k, float(n[k]), cost[k], *[s[k] for s in sums])
                         for k in range(len(c)) if n[k]]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int32() if i < 2 else pa.float64())
                     for i, v in enumerate(zip(*rows))], names=names)
    return points.select(*cols).mapInArrow(
        run, "restart int, cluster int, " + ", ".join(f"{n} double" for n in names[2:])) \
        .groupBy("restart", "cluster").agg(*[F.sum(n).alias(n) for n in names[2:]])


def _chance(*parts: np.ndarray | int) -> np.ndarray:
    """Uniform numbers in [0, 1) from whole numbers."""
    with np.errstate(over="ignore"):
        x = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            x = (x ^ np.asarray(p).astype(np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(29))
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _candidates(points: DataFrame, cols: list[str], id_col: str, found: dict[int, np.ndarray],
                cost: dict[int, float], k: int, seed: int, number: int) -> dict[int, np.ndarray]:
    """Points that join the candidates of each restart in a round."""
    width = len(cols)

    def run(batches):
        for b in batches:
            x, ok = _points(b, width, 1)
            ids, x = b.column(0).to_numpy()[ok], x[ok]
            for r, c in found.items():
                p = OVERSAMPLE * k * _distances(x, c).min(axis=1) / cost[r] if len(x) else np.zeros(0)
                take = _chance(seed, r, number, ids) < p
                if take.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(take.sum(), r, np.int32)), pa.array(ids[take].astype(np.int64)),
                         *[pa.array(x[take, i]) for i in range(width)]],
                        names=["restart", "id", *[f"x{i}" for i in range(width)]])
    rows = points.select(F.col(id_col).cast("long"), *cols).mapInArrow(
        run, "restart int, id long, " + ", ".join(f"x{i} double" for i in range(width))).collect()
    out = {r: [c] for r, c in found.items()}
    for r in sorted(rows, key=lambda r: (r["restart"], r["id"])):
        out[r["restart"]].append(np.array([[r[f"x{i}"] for i in range(width)]]))
    return {r: np.concatenate(c) for r, c in out.items()}


def _reduce(c: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates: each next one by weight times squared
    distance, then a few weighted steps."""
    rng = np.random.default_rng(seed)
    weight = np.maximum(weight, 1e-12)
    out = [c[rng.choice(len(c), p=weight / weight.sum())]]
    while len(out) < k:
        p = weight * _distances(c, np.array(out)).min(axis=1)
        out.append(c[rng.choice(len(c), p=p / p.sum()) if p.sum() > 0 else len(out) % len(c)])
    centres = np.array(out)
    for _ in range(10):
        at = _distances(c, centres).argmin(axis=1)
        for j in range(k):
            if (at == j).any():
                centres[j] = np.average(c[at == j], axis=0, weights=weight[at == j])
    return centres


def fused_kmeans(points: DataFrame, cols: list[str], id_col: str, k: int, restarts: int = 10,
                 seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> list[Fit]:
    """One fit per restart over staged ``points``; each pass serves them all."""
    ship_package(points.sparkSession)
    whole = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
    starts = whole.select(F.col(id_col).cast("long").alias("id"), *cols).select("*", *[
        F.xxhash64(F.lit(seed + r), "id").alias(f"h{r}") for r in range(restarts)])
    row = starts.agg(*[F.min_by(F.struct(*cols), F.struct(f"h{r}", "id")).alias(f"p{r}")
                       for r in range(restarts)]).first()
    found = {r: np.array([list(row[f"p{r}"])], float) for r in range(restarts)}
    for number in range(ROUNDS):
        sums = step_sums(points, cols, found).groupBy("restart").agg(F.sum("cost")).collect()
        cost = {r[0]: r[1] for r in sums if r[1] > 0}
        live = {r: c for r, c in found.items() if r in cost}
        if live:
            found = found | _candidates(points, cols, id_col, live, cost, k, seed, number)
    weight = {r: np.zeros(len(c)) for r, c in found.items()}
    for s in step_sums(points, cols, found).collect():
        weight[s["restart"]][s["cluster"]] = s["n"]
    centres = {r: _reduce(c, weight[r], k, seed + r) for r, c in found.items()}
    fits, moving = {}, dict(centres)
    for i in range(max_iter + 1):
        sums = step_sums(points, cols, moving).collect()
        after = {r: c.copy() for r, c in moving.items()}
        cost = dict.fromkeys(moving, 0.0)
        for s in sums:
            after[s["restart"]][s["cluster"]] = [s[f"s{j}"] / s["n"] for j in range(len(cols))]
            cost[s["restart"]] += s["cost"]
        still = {}
        for r, c in moving.items():
            if i == max_iter or ((after[r] - c) ** 2).sum(axis=1).max() <= tol ** 2:
                fits[r] = Fit(c, cost[r], i)
            else:
                still[r] = after[r]
        if not still:
            break
        moving = still
    return [fits[r] for r in range(restarts)]
