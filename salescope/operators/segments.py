"""Store segmentation: per-store metrics → min-max → k-means → labels."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.operators.features import assemble, min_max_bounds, min_max_scale
from salescope.operators.filters import FilterSpec, enriched
from salescope.operators.fused_kmeans import fused_kmeans
from salescope.session import checkpoint_dir
from salescope.sources.star import Star

FEATURES = ["avg_revenue", "store_rating", "avg_discount", "transaction_count"]
SCALED = [f + "_scaled" for f in FEATURES]

# Segment names by rank of centroid revenue (rank 0 = highest).
SEGMENT_LABELS = {
    0: "Premium Performer",
    1: "Growth Potential",
    2: "Stable Average",
    3: "Underperformer",
}


def label_expr(cluster_id):
    """Label for a cluster id; ids without a name become ``Cluster n``."""
    m = F.create_map(*[x for k, v in SEGMENT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, cluster_id),
                      F.concat(F.lit("Cluster "), cluster_id.cast("string")))


def store_metrics(star: Star, spec: FilterSpec) -> DataFrame:
    """One row per store with sales under the look-back and category filters
    (segmentation ignores the store filter).  A store's rating is a dimension
    attribute, so it is a grouping key rather than a mean of copies."""
    f = enriched(star, spec.without("store"),
                 ["store_id", "store_location", "store_rating", "revenue",
                  "discount_percentage"])
    m = (f.groupBy("store_id", "store_location", "store_rating")
          .agg((F.sum("revenue").cast("double") / F.count("revenue")).alias("avg_revenue"),
               F.sum("revenue").cast("double").alias("total_revenue"),
               F.avg("discount_percentage").alias("avg_discount"),
               F.count("revenue").cast("double").alias("transaction_count")))
    return m.select("store_id", "store_location", "avg_revenue", "total_revenue",
                    "store_rating", "avg_discount", "transaction_count").fillna(0.0, FEATURES)


def assign_to_centres(scaled: DataFrame, centres: list[list[float]],
                      cols: list[str] = SCALED) -> DataFrame:
    """Nearest centre per row (squared Euclidean), as a row-wise expression.

    The k centres are model parameters (k × d numbers), inlined into the
    expression: no join with the centre table, no pairs materialised.
    """
    if not centres:
        raise ValueError("no centres")
    cands = []
    for cid, c in enumerate(centres):
        d = None
        for col, v in zip(cols, c):
            term = (F.col(col) - F.lit(float(v))) * (F.col(col) - F.lit(float(v)))
            d = term if d is None else d + term
        cands.append(F.struct(d.alias("d"), F.lit(cid).alias("id")))
    best = F.array_min(F.array(*cands)) if len(cands) > 1 else cands[0]
    return scaled.withColumn("cluster_id", best.getField("id"))


def summarize(assigned: DataFrame, digits: int = 6) -> DataFrame:
    """Per label: store count, mean store avg_revenue, mean rating (unweighted
    over stores), at display precision so the result does not depend on the
    order in which partial sums were merged."""
    return (assigned.groupBy("cluster_label")
            .agg(F.count("store_id").alias("store_count"),
                 F.round(F.avg("avg_revenue"), digits).alias("avg_revenue"),
                 F.round(F.avg("store_rating"), digits).alias("avg_rating")))


@dataclass
class SegmentResult:
    assignments: DataFrame
    summary: DataFrame
    centers: DataFrame
    inertia: float
    scaled_centres: list | None = None   # ranked, in scaled space
    bounds: dict | None = None           # feature -> (min, max) of the fit data


def scale_with(df: DataFrame, bounds: dict, cols: list[str] = FEATURES) -> DataFrame:
    """Min-max scale with fixed bounds (those of the data a model was fitted on)."""
    out = []
    for c in cols:
        lo, hi = bounds[c]
        width = (hi - lo) if hi is not None and lo is not None else 0.0
        out.append((F.lit(0.0) if not width else (F.col(c) - F.lit(lo)) / F.lit(width))
                   .alias(c + "_scaled"))
    return df.select("*", *out)


def assign_saved(metrics: DataFrame, centres: list, bounds: dict) -> DataFrame:
    """Assign per-store metrics to a saved model's clusters and label them."""
    a = assign_to_centres(scale_with(metrics, bounds), centres)
    return a.withColumn("cluster_label", label_expr(F.col("cluster_id")))


def default_estimator(k: int, seed: int, max_iter: int):
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features",
                  predictionCol="raw_cluster")


def staged_metrics(star: Star, spec: FilterSpec) -> DataFrame:
    """One row per store, read by the bounds, every restart and the assignment
    of each fit: written once to the shared checkpoint folder so the fact join
    and aggregation run a single time."""
    checkpoint_dir(star.transactions.sparkSession)
    return store_metrics(star, spec).checkpoint(eager=True)


def segment_stores(star: Star, n_clusters: int = 4, days: int = 0,
                   category: str | None = None, n_init: int = 10, seed: int = 42,
                   max_iter: int = 300, make_estimator=None,
                   metrics: DataFrame | None = None) -> SegmentResult:
    """Fit k-means ``n_init`` times (all restarts share each pass, k-means||
    initialisation), keep the lowest cost, then rename clusters so that id 0
    has the highest centroid revenue before labelling.

    ``make_estimator(k, seed, max_iter)`` may return any MLlib clustering
    estimator whose model has ``clusterCenters()`` and ``summary.trainingCost``
    (e.g. ``BisectingKMeans``).  ``metrics``: those of the same filters, where
    ``staged_metrics`` has worked them out."""
    if n_clusters < 1:
        raise ValueError("n_clusters must be >= 1")
    if metrics is None:
        metrics = staged_metrics(star, FilterSpec(days=days, category=category))
    scaled = assemble(min_max_scale(metrics, FEATURES), SCALED).persist()
    n = scaled.count()
    if n == 0:
        raise ValueError("no data for segmentation")
    if n_clusters > n:
        raise ValueError(f"n_clusters={n_clusters} exceeds {n} stores")
    if make_estimator is None:
        best = min(fused_kmeans(scaled, SCALED, "store_id", n_clusters, n_init, seed, max_iter),
                   key=lambda f: f.inertia)
        cost, centres = best.inertia, best.centres.tolist()
    else:
        def fit(i):
            m = make_estimator(n_clusters, seed + i, max_iter).fit(scaled)
            return m.summary.trainingCost, i, m

        # Restarts are independent Spark jobs: submit them together so the
        # scheduler overlaps them instead of running n_init chains back to back.
        with ThreadPoolExecutor(max_workers=max(1, min(n_init, 16))) as pool:
            fits = list(pool.map(fit, range(n_init)))
        cost, _, model = min(fits, key=lambda r: (r[0], r[1]))
        centres = [list(map(float, c)) for c in model.clusterCenters()]
    # Rank ids by centroid avg_revenue (descending), ties by old id.
    order = sorted(range(len(centres)), key=lambda i: (-centres[i][0], i))
    ranked = [centres[old] for old in order]
    assigned = assign_to_centres(scaled.drop("features"), ranked)
    assigned = assigned.withColumn("cluster_label", label_expr(F.col("cluster_id")))
    assignments = assigned.select("store_id", "store_location", "cluster_id",
                                  "cluster_label", *FEATURES)
    b = min_max_bounds(metrics, FEATURES).first()
    centre_rows = [
        [new] + [c * (b[f"{f}_max"] - b[f"{f}_min"]) + b[f"{f}_min"]
                 for f, c in zip(FEATURES, ranked[new])]
        for new in range(len(ranked))]
    spark = metrics.sparkSession
    centers = spark.createDataFrame(
        centre_rows, "cluster_id int, " + ", ".join(f"{f} double" for f in FEATURES))
    centers = centers.withColumn("cluster_label", label_expr(F.col("cluster_id")))
    bounds = {f: (b[f"{f}_min"], b[f"{f}_max"]) for f in FEATURES}
    return SegmentResult(assignments, summarize(assigned), centers, float(cost), ranked, bounds)
