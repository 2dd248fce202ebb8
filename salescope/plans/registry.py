"""Named queries over the driver tables and their SQL oracles.

Each entry of :data:`QUERIES` takes ``(spark, sf_dir)`` and returns a lazy
DataFrame built from the library; :data:`ORACLE` holds, for the same name,
ANSI SQL that DuckDB runs over the same Parquet tables.  Column names are
identical on both sides.  Model outputs (k-means fits, boosted trees, SHAP,
forecasts) have no SQL form and are registered without an oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salescope.operators import overview as ov
from salescope.operators.filters import FilterSpec
from salescope.sources.star import STAR_CTES, star_from_tpch

# Fixed parameters of the registered variants.
STORE = "Supplier#000000003"
CATEGORY = "PROMO"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            body = sql.lstrip()
            sep = "\n" if body.upper().startswith("SELECT") else ",\n"
            ORACLE[name] = "WITH " + STAR_CTES.rstrip() + sep + body
        return fn
    return deco


JOINED = ("FROM transactions t JOIN stores s ON t.store_id = s.store_id "
          "JOIN products p ON t.product_id = p.product_id")


def lookback_sql(days: int) -> str:
    return f"t.ts >= (SELECT max(ts) FROM transactions) - INTERVAL {days} DAY"


def where(days=0, store=None, category=None) -> str:
    preds = []
    if days:
        preds.append(lookback_sql(days))
    if store:
        preds.append(f"s.store_location = '{store}'")
    if category:
        preds.append(f"p.category = '{category}'")
    return ("WHERE " + " AND ".join(preds)) if preds else ""


def kpi_sql(days=0, store=None, category=None) -> str:
    return f"""
SELECT coalesce(cast(sum(t.revenue) AS double), 0.0) AS total_revenue,
       count(t.transaction_id) AS transaction_count,
       round(coalesce(cast(sum(t.revenue) AS double) / count(t.revenue), 0.0), 2) AS avg_order_value,
       (SELECT count(*) FROM stores) AS store_count,
       (SELECT count(*) FROM products) AS product_count
{JOINED} {where(days, store, category)}"""


def trend_sql(days=0, store=None, category=None) -> str:
    return f"""
SELECT cast(t.ts AS date) AS date, cast(sum(t.revenue) AS double) AS revenue
{JOINED} {where(days, store, category)}
GROUP BY 1 ORDER BY 1"""


def top_sql(key: str, days=0, store=None, category=None) -> str:
    return f"""
SELECT {key}, cast(sum(t.revenue) AS double) AS revenue
{JOINED} {where(days, store, category)}
GROUP BY {key} ORDER BY revenue DESC, {key} ASC LIMIT 5"""


# ---------------------------------------------------------------- overview
@register("kpi_summary", kpi_sql(days=30))
def kpi_summary(spark, sf_dir):
    return ov.kpis(star_from_tpch(spark, sf_dir), FilterSpec(days=30))


@register("kpi_summary_filtered", kpi_sql(365, STORE, CATEGORY))
def kpi_summary_filtered(spark, sf_dir):
    return ov.kpis(star_from_tpch(spark, sf_dir), FilterSpec(365, STORE, CATEGORY))


@register("kpi_summary_all_time", kpi_sql())
def kpi_summary_all_time(spark, sf_dir):
    return ov.kpis(star_from_tpch(spark, sf_dir), FilterSpec(days=0))


@register("dimension_counts", """
SELECT (SELECT count(*) FROM stores) AS store_count,
       (SELECT count(*) FROM products) AS product_count""")
def dimension_counts(spark, sf_dir):
    return ov.dimension_counts(star_from_tpch(spark, sf_dir))


@register("daily_revenue", trend_sql())
def daily_revenue(spark, sf_dir):
    return ov.revenue_trend(star_from_tpch(spark, sf_dir), FilterSpec())


@register("daily_revenue_filtered", trend_sql(365, None, CATEGORY))
def daily_revenue_filtered(spark, sf_dir):
    return ov.revenue_trend(star_from_tpch(spark, sf_dir), FilterSpec(365, None, CATEGORY))


@register("daily_revenue_store", trend_sql(0, STORE, None))
def daily_revenue_store(spark, sf_dir):
    return ov.revenue_trend(star_from_tpch(spark, sf_dir), FilterSpec(0, STORE, None))


@register("top_stores", top_sql("store_location", days=30))
def top_stores(spark, sf_dir):
    return ov.top_stores(star_from_tpch(spark, sf_dir), FilterSpec(days=30, store=STORE))


@register("top_stores_category", top_sql("store_location", 365, None, CATEGORY))
def top_stores_category(spark, sf_dir):
    return ov.top_stores(star_from_tpch(spark, sf_dir), FilterSpec(365, STORE, CATEGORY))


@register("top_categories", top_sql("category"))
def top_categories(spark, sf_dir):
    return ov.top_categories(star_from_tpch(spark, sf_dir), FilterSpec(0, None, CATEGORY))


@register("top_categories_store", top_sql("category", 365, STORE, None))
def top_categories_store(spark, sf_dir):
    return ov.top_categories(star_from_tpch(spark, sf_dir), FilterSpec(365, STORE, CATEGORY))


@register("filter_options", """
SELECT 'store' AS kind, store_location AS value FROM stores
UNION SELECT 'category' AS kind, category AS value FROM products
ORDER BY kind, value""")
def filter_options(spark, sf_dir):
    return ov.filter_options(star_from_tpch(spark, sf_dir))


@register("lookback_cutoff", """
SELECT max(ts) AS newest_ts, max(ts) - INTERVAL 30 DAY AS cutoff_ts,
       count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM transactions) - INTERVAL 30 DAY) AS rows_in_window
FROM transactions""")
def lookback_cutoff(spark, sf_dir):
    from pyspark.sql import functions as F
    from salescope.operators.filters import lookback_predicate
    tx = star_from_tpch(spark, sf_dir).narrow      # no look-up joins
    return tx.agg(
        F.max("ts").alias("newest_ts"),
        (F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("cutoff_ts"),
        F.count_if(lookback_predicate(tx, 30)).alias("rows_in_window"))


# ---------------------------------------------------------------- segments
from salescope.operators import segments as seg  # noqa: E402
from salescope.operators.features import min_max_scale  # noqa: E402

# Fixed centres (scaled space) for the assignment variants.
CENTRES = [[0.8, 0.8, 0.5, 0.8], [0.6, 0.5, 0.5, 0.6],
           [0.4, 0.5, 0.5, 0.4], [0.2, 0.2, 0.5, 0.2]]


def store_metrics_sql(days=0, category=None) -> str:
    return f"""
SELECT s.store_id, s.store_location,
       coalesce(cast(sum(t.revenue) AS double) / count(t.revenue), 0.0) AS avg_revenue,
       cast(sum(t.revenue) AS double) AS total_revenue,
       coalesce(s.store_rating, 0.0) AS store_rating,
       coalesce(avg(t.discount_percentage), 0.0) AS avg_discount,
       cast(count(t.revenue) AS double) AS transaction_count
{JOINED} {where(days, None, category)}
GROUP BY s.store_id, s.store_location, s.store_rating"""


def scaled_sql(days=0, category=None) -> str:
    feats = seg.FEATURES
    bounds = ", ".join(f"min({f}) AS {f}_min, max({f}) AS {f}_max" for f in feats)
    scaled = ", ".join(
        f"coalesce((m.{f} - b.{f}_min) / nullif(b.{f}_max - b.{f}_min, 0), 0.0) AS {f}_scaled"
        for f in feats)
    return f"""m AS ({store_metrics_sql(days, category)}),
b AS (SELECT {bounds} FROM m)
SELECT m.*, {scaled} FROM m, b"""


def centres_sql() -> str:
    vals = ", ".join("(" + ", ".join([str(i)] + [f"CAST({v} AS DOUBLE)" for v in c]) + ")"
                     for i, c in enumerate(CENTRES))
    return f"c(cluster_id, {', '.join(f + '_c' for f in seg.FEATURES)}) AS (VALUES {vals})"


def label_sql(col: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in seg.SEGMENT_LABELS.items())
    return f"CASE {col} {cases} ELSE concat('Cluster ', CAST({col} AS VARCHAR)) END"


def assign_sql(days=0, category=None) -> str:
    dist = " + ".join(f"(x.{f}_scaled - c.{f}_c) * (x.{f}_scaled - c.{f}_c)" for f in seg.FEATURES)
    base = scaled_sql(days, category)
    head, tail = base.rsplit("SELECT m.*", 1)
    return f"""{head}, x AS (SELECT m.*{tail}),
{centres_sql()},
a AS (SELECT x.store_id, x.store_location, x.avg_revenue, x.store_rating,
             first(c.cluster_id ORDER BY {dist}, c.cluster_id) AS cluster_id
      FROM x, c GROUP BY x.store_id, x.store_location, x.avg_revenue, x.store_rating)"""


def _fixed_assign(spark, sf_dir, days=0, category=None):
    from salescope.session import checkpoint_dir
    checkpoint_dir(spark)
    # One row per store, read twice (bounds and rows): written once.
    m = seg.store_metrics(star_from_tpch(spark, sf_dir),
                          FilterSpec(days=days, category=category)).checkpoint(eager=True)
    a = seg.assign_to_centres(min_max_scale(m, seg.FEATURES), CENTRES)
    return a.withColumn("cluster_label", seg.label_expr(a["cluster_id"]))


@register("store_metrics", store_metrics_sql())
def store_metrics(spark, sf_dir):
    return seg.store_metrics(star_from_tpch(spark, sf_dir), FilterSpec())


@register("store_metrics_filtered", store_metrics_sql(365, CATEGORY))
def store_metrics_filtered(spark, sf_dir):
    return seg.store_metrics(star_from_tpch(spark, sf_dir), FilterSpec(365, STORE, CATEGORY))


@register("store_metrics_scaled", scaled_sql(365))
def store_metrics_scaled(spark, sf_dir):
    m = seg.store_metrics(star_from_tpch(spark, sf_dir), FilterSpec(days=365))
    return min_max_scale(m, seg.FEATURES)


@register("assign_to_centroids", assign_sql() + f"""
SELECT store_id, store_location, cluster_id, {label_sql('cluster_id')} AS cluster_label FROM a""")
def assign_to_centroids(spark, sf_dir):
    return _fixed_assign(spark, sf_dir).select("store_id", "store_location", "cluster_id",
                                               "cluster_label")


@register("segment_summary_fixed_centroids", assign_sql(0, CATEGORY) + f"""
SELECT {label_sql('cluster_id')} AS cluster_label, count(store_id) AS store_count,
       round(avg(avg_revenue), 6) AS avg_revenue, round(avg(store_rating), 6) AS avg_rating
FROM a GROUP BY 1""")
def segment_summary_fixed_centroids(spark, sf_dir):
    return seg.summarize(_fixed_assign(spark, sf_dir, 0, CATEGORY))


@register("segment_stores")
def segment_stores(spark, sf_dir):
    return seg.segment_stores(star_from_tpch(spark, sf_dir), n_clusters=4).assignments


@register("segment_summary")
def segment_summary(spark, sf_dir):
    return seg.segment_stores(star_from_tpch(spark, sf_dir), n_clusters=4, days=365).summary


@register("segment_summary_all")
def segment_summary_all(spark, sf_dir):
    return seg.segment_stores(star_from_tpch(spark, sf_dir), n_clusters=4).summary


@register("store_metrics_scaled_all", scaled_sql())
def store_metrics_scaled_all(spark, sf_dir):
    m = seg.store_metrics(star_from_tpch(spark, sf_dir), FilterSpec())
    return min_max_scale(m, seg.FEATURES)


def lloyd_sql() -> str:
    dist = " + ".join(f"(x.{f}_scaled - c.{f}_c) ** 2" for f in seg.FEATURES)
    base = scaled_sql()
    head, tail = base.rsplit("SELECT m.*", 1)
    moved = ", ".join(f"round(avg({f}_scaled), 6) AS {f}" for f in seg.FEATURES)
    return f"""{head}, x AS (SELECT m.*{tail}),
{centres_sql()},
d AS (SELECT x.*, c.cluster_id, {dist} AS d FROM x, c),
a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY d, cluster_id) = 1)
SELECT cluster_id, count(*) AS n_stores, round(sum(d), 6) AS inertia, {moved} FROM a GROUP BY cluster_id"""


@register("lloyd_step", lloyd_sql())
def lloyd_step(spark, sf_dir):
    """One pass from fixed centres: sizes, inertia and moved centres."""
    import numpy as np
    from pyspark.sql import functions as F

    from salescope.operators.fused_kmeans import step_sums
    from salescope.session import ship_package
    ship_package(spark)
    m = min_max_scale(seg.store_metrics(star_from_tpch(spark, sf_dir), FilterSpec()), seg.FEATURES)
    sums = step_sums(m, seg.SCALED, {0: np.array(CENTRES)})
    return sums.select(
        F.col("cluster").alias("cluster_id"), F.col("n").cast("long").alias("n_stores"),
        F.round("cost", 6).alias("inertia"),
        *[F.round(F.col(f"s{i}") / F.col("n"), 6).alias(f) for i, f in enumerate(seg.FEATURES)])


@register("segment_inertia")
def segment_inertia(spark, sf_dir):
    """Inertia of the best of ten restarts for two to eight segments."""
    star = star_from_tpch(spark, sf_dir)
    metrics = seg.staged_metrics(star, FilterSpec())
    rows = [(k, seg.segment_stores(star, n_clusters=k, metrics=metrics).inertia) for k in (2, 4, 8)]
    return spark.createDataFrame(rows, "n_clusters int, inertia double")


@register("cluster_centers")
def cluster_centers(spark, sf_dir):
    return seg.segment_stores(star_from_tpch(spark, sf_dir), n_clusters=3,
                              category=CATEGORY).centers


# ---------------------------------------------------------------- drivers / explain
from salescope.functions.text import feature_display_name  # noqa: E402
from salescope.operators import drivers as drv  # noqa: E402

# The level domains of the encoded columns in the driver tables
# (market segments, order priorities, part types), used by the SQL oracle.
LEVELS = {
    "customer_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "payment_mode": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "category": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
}
def _driver_model(spark, sf_dir):
    """The model on every row: 500 rounds at 0.05 with 31 leaves."""
    return drv.fit_drivers(star_from_tpch(spark, sf_dir), FilterSpec())


def title_sql(expr: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(" + expr +
            r", '(\p{L}+|[^\p{L}]+)'), lambda x: upper(x[1]) || lower(x[2:])), '')")


def onehot_sql() -> str:
    cols = ["t.discount_percentage", "CAST(t.promotion_applied AS INTEGER) AS promotion_applied",
            "CAST(t.holiday_flag AS INTEGER) AS holiday_flag",
            "CAST(t.revenue AS DOUBLE) AS revenue", "s.store_rating"]
    src = {"customer_type": "t.customer_type", "payment_mode": "t.payment_mode",
           "category": "p.category"}
    for c, levels in LEVELS.items():
        for lv in levels[1:]:
            cols.append(f"CASE WHEN {src[c]} = '{lv}' THEN 1 ELSE 0 END AS \"{c}_{lv}\"")
    return f"SELECT {', '.join(cols)} {JOINED}"


@register("onehot_drop_first", onehot_sql())
def onehot_drop_first(spark, sf_dir):
    m, _ = drv.driver_matrix(drv.driver_rows(star_from_tpch(spark, sf_dir), FilterSpec()))
    return m


def display_sql() -> str:
    parts = []
    for c, src in (("customer_type", "t.customer_type"), ("payment_mode", "t.payment_mode"),
                   ("category", "p.category")):
        parts.append(f"SELECT DISTINCT '{c}' AS source, {src} AS level, '{c}_' || {src} AS feature "
                     f"{JOINED}")
    name = "f.feature"
    plain = title_sql(f"replace({name}, '_', ' ')")
    head = f"regexp_extract({name}, '^(.*)_([^_]*)$', 1)"
    tail = f"regexp_extract({name}, '^(.*)_([^_]*)$', 2)"
    split = f"{title_sql(f'replace({head}, {chr(39)}_{chr(39)}, {chr(39)} {chr(39)})')} || ' = ' || {title_sql(tail)}"
    return (f"f AS ({' UNION '.join(parts)})\n"
            f"SELECT f.source, f.level, f.feature, CASE WHEN length({name}) - length(replace({name}, '_', '')) > 1 "
            f"THEN {split} ELSE {plain} END AS display_name FROM f")


@register("display_names", display_sql())
def display_names(spark, sf_dir):
    from pyspark.sql import functions as F
    rows = drv.driver_rows(star_from_tpch(spark, sf_dir), FilterSpec())
    # One pass: every row emits its (column, level) pairs, then one distinct.
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("level"))
                                for c in drv.CATEGORICAL]))
    f = rows.select(pairs.alias("p")).select("p.source", "p.level").distinct()
    f = f.withColumn("feature", F.concat_ws("_", "source", "level"))
    return f.withColumn("display_name", feature_display_name(F.col("feature")))


@register("category_revenue_share", f"""
r AS (SELECT p.category AS category, cast(sum(t.revenue) AS double) AS revenue {JOINED} GROUP BY 1),
k AS (SELECT category, revenue, row_number() OVER (ORDER BY revenue DESC, category) AS "Rank" FROM r)
SELECT category, revenue, "Rank",
       CASE WHEN sum(revenue) OVER () > 0 THEN round(revenue * 100 / sum(revenue) OVER (), 1) ELSE 0.0 END
         AS pct_contribution
FROM k WHERE "Rank" <= 10""")
def category_revenue_share(spark, sf_dir):
    from pyspark.sql import functions as F
    from salescope.operators.filters import enriched
    f = enriched(star_from_tpch(spark, sf_dir), FilterSpec(), ["category", "revenue"])
    r = f.groupBy("category").agg(F.sum("revenue").cast("double").alias("revenue"))
    return drv.rank_and_share(r, "revenue", "category", 10)


@register("driver_importance")
def driver_importance(spark, sf_dir):
    return drv.global_importance(_driver_model(spark, sf_dir))


@register("split_importance")
def split_importance(spark, sf_dir):
    return _driver_model(spark, sf_dir).model.importance("split")


@register("explain_entries")
def explain_entries(spark, sf_dir):
    return drv.sorted_entries(drv.explain_entries(_driver_model(spark, sf_dir)))


@register("explain_summary")
def explain_summary(spark, sf_dir):
    return drv.explain_summary(drv.explain_entries(_driver_model(spark, sf_dir)))


@register("shap_values")
def shap_values(spark, sf_dir):
    return drv.all_values(_driver_model(spark, sf_dir))


# Parts of the driver model that SQL can state: bins, level ids, the first
# split, the two leaves of a first tree, what holds for all predictions.
NUMERIC_SQL = {"discount_percentage": "CAST(t.discount_percentage AS DOUBLE)",
               "promotion_applied": "CAST(CAST(t.promotion_applied AS INTEGER) AS DOUBLE)",
               "holiday_flag": "CAST(CAST(t.holiday_flag AS INTEGER) AS DOUBLE)",
               "store_rating": "CAST(s.store_rating AS DOUBLE)"}
LEVEL_SQL = {"customer_type": "t.customer_type", "payment_mode": "t.payment_mode",
             "category": "p.category"}
BINS_SQL = f"""
vals AS ({" UNION ALL ".join(f"SELECT {i} AS col, {e} AS v {JOINED}" for i, e in enumerate(NUMERIC_SQL.values()))}),
cnt AS (SELECT col, v, count(*) AS n FROM vals WHERE v IS NOT NULL GROUP BY 1, 2),
run AS (SELECT *, sum(n) OVER (PARTITION BY col ORDER BY v) - n AS before,
               sum(n) OVER (PARTITION BY col) AS total, count(*) OVER (PARTITION BY col) AS vs FROM cnt),
slots AS (SELECT col, max(v) AS upper, sum(n)::BIGINT AS n FROM run
          GROUP BY col, CASE WHEN vs <= 255 THEN v ELSE floor(before * 255 / total) END),
bins AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY upper)::INTEGER AS bin, upper, n FROM slots)"""


def _coded(spark, sf_dir):
    from salescope.session import materialize, ship_package
    ship_package(spark)
    # Read for the bins, the levels and the codes: joined and written once.
    rows = materialize(drv.driver_rows(star_from_tpch(spark, sf_dir), FilterSpec()), "driver-rows")
    coding, plain = drv.driver_coding(rows)
    return coding, plain


@register("feature_bins", BINS_SQL + "\nSELECT col AS \"column\", bin, upper, n FROM bins")
def feature_bins(spark, sf_dir):
    from salescope.operators.leafwise import bin_edges
    _, plain = _coded(spark, sf_dir)
    return bin_edges(plain, list(NUMERIC_SQL))


# A column as wide as the part table, next to one of six levels.
@register("level_ids", f"""
pairs AS (SELECT 0 AS col, p.category AS level {JOINED} UNION
          SELECT 1, CAST(t.product_id AS VARCHAR) {JOINED})
SELECT col AS "column", level, (row_number() OVER (ORDER BY col, level) - 1)::INTEGER AS id,
       row_number() OVER (PARTITION BY col ORDER BY level) = 1 AS first FROM pairs""")
def level_ids(spark, sf_dir):
    from pyspark.sql import functions as F

    from salescope.operators.filters import enriched
    from salescope.operators.leafwise import level_dictionary
    f = enriched(star_from_tpch(spark, sf_dir), FilterSpec(), ["category", "product_id"])
    return level_dictionary(f.withColumn("product_id", F.col("product_id").cast("string")),
                            ["category", "product_id"])


def root_sql() -> str:
    """Best split of the root per column, by the gain in squared error."""
    number = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, b.bin AS code, b.upper::VARCHAR AS cut, g.n AS nl, g.g AS gl "
        f"FROM bins b, LATERAL (SELECT count(*) AS n, sum(y - m) AS g FROM src, base "
        f"WHERE {c} <= b.upper) g WHERE b.col = {i}" for i, c in enumerate(NUMERIC_SQL))
    level = " UNION ALL ".join(
        f"SELECT '{c}', row_number() OVER (ORDER BY {c}), {c}, (SELECT n FROM base) - count(*), -sum(y - m) "
        f"FROM src, base GROUP BY {c}" for c in LEVEL_SQL)
    cols = ", ".join(f"{e} AS {c}" for c, e in (NUMERIC_SQL | LEVEL_SQL).items())
    return BINS_SQL + f""",
src AS MATERIALIZED (SELECT CAST(t.revenue AS DOUBLE) AS y, {cols} {JOINED}),
base AS MATERIALIZED (SELECT avg(y) AS m, count(*) AS n, sum((y - (SELECT avg(y) FROM src)) ** 2) AS ss FROM src),
cand AS ({number} UNION ALL {level}),
firsts AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, min({c}) AS cut FROM src" for c in LEVEL_SQL)}),
scored AS (SELECT c.feature, c.code, c.cut, c.nl, c.gl, c.gl * c.gl / c.nl + c.gl * c.gl / (b.n - c.nl) AS gain
           FROM cand c, base b WHERE c.nl >= 20 AND b.n - c.nl >= 20
           AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.feature = c.feature AND f.cut = c.cut)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, code) = 1)"""


@register("root_split_gains", root_sql() + """
SELECT feature, cut AS split_at, nl::BIGINT AS n_left, round(gain / ss * 1e6, 3) AS gain_per_million
FROM best, base""")
def root_split_gains(spark, sf_dir):
    """First split of every column: the distributed histogram pass."""
    from pyspark.sql import functions as F

    from salescope.operators import leafwise as lw
    from salescope.session import materialize
    coding, plain = _coded(spark, sf_dir)
    vectors = materialize(lw.collapse(coding.encode(plain), coding.codes, drv.TARGET), "vectors")
    n, y = vectors.agg(F.sum("n"), F.sum("y")).first()
    state = vectors.withColumn("pred", F.lit(y / n))
    tree = lw.Tree()
    tree.add(0.0, 0.0)
    k = len(coding.numeric)
    best = lw.best_splits(lw._histograms(state, tree, [0], len(coding.codes), k), k, coding.firsts,
                          lw.MIN_ROWS, 0, 1.0, 0, 4).where("gain >= 0")
    ss = plain.agg(F.sum(F.pow(F.col(drv.TARGET) - F.lit(y / n), 2))).first()[0]
    names = F.array(*map(F.lit, coding.numeric + coding.strings))
    uppers = spark.createDataFrame([(i, b + 1, str(u)) for i, up in enumerate(coding.uppers)
                                    for b, u in enumerate(up)], "column int, code int, at string")
    levels = coding.levels.select((F.col("column") + k).alias("column"), F.col("id").alias("code"),
                                  F.col("level").alias("at"))
    return best.join(uppers.unionByName(levels), ["column", "code"]).select(
        F.get(names, F.col("column")).alias("feature"), F.col("at").alias("split_at"),
        F.col("nl").cast("long").alias("n_left"),
        F.round(F.col("gain") / F.lit(ss) * 1e6, 3).alias("gain_per_million"))


@register("first_tree_leaves", root_sql() + """,
top AS (SELECT * FROM best ORDER BY gain DESC LIMIT 1)
SELECT leaf, n::BIGINT AS n_rows, round(v, 6) AS leaf_value, round(m + v, 4) AS prediction FROM (
  SELECT 'left' AS leaf, nl AS n, 0.05 * gl / nl AS v, m FROM top, base
  UNION ALL SELECT 'right', n - nl, 0.05 * -gl / (n - nl), m FROM top, base)""")
def first_tree_leaves(spark, sf_dir):
    """One round of two leaves on every row: fitted, applied and counted."""
    from pyspark.sql import functions as F

    from salescope.operators import leafwise as lw
    from salescope.session import materialize
    coding, plain = _coded(spark, sf_dir)
    coded = materialize(coding.encode(plain), "coded")
    vectors = materialize(lw.collapse(coded, coding.codes, drv.TARGET), "vectors")
    m = lw.fit_leafwise(coding, vectors, rounds=1, leaves=2, fraction=1.0)
    leaf = m.node_frame().where("left < 0").select(
        F.when(F.col("node") == 1, "left").otherwise("right").alias("leaf"), "value")
    return m.predict(coded.select(*coding.codes)).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n_rows")) \
        .join(leaf, F.abs(F.col("prediction") - m.base - F.col("value")) < 1e-9) \
        .select("leaf", "n_rows", F.round("value", 6).alias("leaf_value"),
                F.round("prediction", 4).alias("prediction"))


@register("prediction_checks", f"""
SELECT count(*) AS n_rows, round(avg(CAST(t.revenue AS DOUBLE)), 3) AS mean_prediction,
       0::BIGINT AS not_additive, true AS better_than_mean {JOINED}""")
def prediction_checks(spark, sf_dir):
    """Over every row: mean prediction (that of the target), rows whose SHAP
    values and base do not add up to their prediction, and whether the squared
    error is below that of the mean."""
    from pyspark.sql import functions as F
    dm = _driver_model(spark, sf_dir)
    rows = dm.explainer.row_values(dm.matrix, drv.ID, [drv.TARGET], dm.vectors)
    off = F.abs(F.aggregate("values", F.col("base_value"), lambda s, x: s + x) - F.col("prediction"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("prediction"), 3).alias("mean_prediction"),
                    F.count_if(off > 1e-6 * F.abs("prediction") + 1e-6).alias("not_additive"),
                    (F.avg(F.pow(F.col("prediction") - F.col(drv.TARGET), 2))
                     < F.var_pop(drv.TARGET)).alias("better_than_mean"))


@register("driver_sample", f"""
r AS (SELECT t.transaction_id, CAST(t.revenue AS DOUBLE) AS revenue, p.category {JOINED})
SELECT * FROM r ORDER BY md5(transaction_id::VARCHAR || ':42'), transaction_id LIMIT 2000""")
def driver_sample(spark, sf_dir):
    rows = drv.driver_rows(star_from_tpch(spark, sf_dir), FilterSpec(), with_id=True)
    return drv.sample_by_id(rows.select(drv.ID, drv.TARGET, "category"), 2000)


@register("explain_transactions", f"""
SELECT t.transaction_id, CAST(t.revenue AS DOUBLE) AS revenue, p.category, true AS additive
{JOINED} WHERE t.transaction_id IN (SELECT min(transaction_id) FROM transactions
                                    UNION SELECT max(transaction_id) FROM transactions)""")
def explain_transactions(spark, sf_dir):
    """Two given transactions looked up by id and explained."""
    from pyspark.sql import functions as F
    dm = _driver_model(spark, sf_dir)
    ids = list(dm.matrix.agg(F.min(drv.ID), F.max(drv.ID)).first())
    rows = dm.explainer.row_values(dm.lookup(ids), drv.ID, [drv.TARGET, "category"])
    total = F.aggregate("values", F.col("base_value"), lambda s, x: s + x)
    return rows.select(drv.ID, drv.TARGET, "category",
                       (F.abs(total - F.col("prediction")) < 1e-6).alias("additive"))


# ---------------------------------------------------------------- forecast
import math  # noqa: E402

from salescope.operators import forecast as fcst  # noqa: E402

PANEL_KEYS = ["store_location", "category"]


def daily_sql(keys: list[str], days=0, store=None, category=None) -> str:
    k = "".join(f"{'s.' if c == 'store_location' else 'p.'}{c}, " for c in keys)
    g = ", ".join([str(i + 1) for i in range(len(keys) + 1)])
    return f"""
SELECT {k}cast(t.ts AS date) AS ds, cast(sum(t.revenue) AS double) AS y,
       bool_or(t.holiday_flag) AS holiday_flag
{JOINED} {where(days, store, category)} GROUP BY {g}"""


@register("forecast_daily_series", daily_sql([]))
def forecast_daily_series(spark, sf_dir):
    return fcst.daily_series(star_from_tpch(spark, sf_dir), FilterSpec())


@register("forecast_daily_series_panel", daily_sql(PANEL_KEYS))
def forecast_daily_series_panel(spark, sf_dir):
    return fcst.daily_series(star_from_tpch(spark, sf_dir), FilterSpec(), PANEL_KEYS)


@register("forecast_future_frame", f"""
d AS ({daily_sql([])}),
cal AS (SELECT month(ds) AS m, day(ds) AS dd, bool_or(holiday_flag) AS is_h FROM d GROUP BY 1, 2),
f AS (SELECT (SELECT max(ds) FROM d) + CAST(i AS INTEGER) AS ds FROM range(1, 61) r(i)),
j AS (SELECT f.ds, CAST(cal.is_h AS DOUBLE) AS h FROM f LEFT JOIN cal
      ON month(f.ds) = cal.m AND day(f.ds) = cal.dd)
SELECT ds, coalesce(first_value(h IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW
       AND UNBOUNDED FOLLOWING), 0.0) AS holiday_flag FROM j""")
def forecast_future_frame(spark, sf_dir):
    daily = fcst.daily_series(star_from_tpch(spark, sf_dir), FilterSpec())
    return fcst.future_frame(daily, [], 60, fcst.holiday_calendar(daily))


def seasonal_sql() -> str:
    cols = []
    for name, period, order in (("yearly", fcst.YEARLY_PERIOD, fcst.YEARLY_ORDER),
                                ("weekly", fcst.WEEKLY_PERIOD, fcst.WEEKLY_ORDER)):
        for k in range(1, order + 1):
            arg = f"({2.0 * math.pi * k!r} * CAST(ds - DATE '1970-01-01' AS DOUBLE)) / {float(period)!r}"
            cols.append(f"round(sin({arg}), 6) AS {name}_sin{k}")
            cols.append(f"round(cos({arg}), 6) AS {name}_cos{k}")
    return f"d AS ({daily_sql([])})\nSELECT ds, {', '.join(cols)} FROM d"


@register("forecast_seasonal_features", seasonal_sql())
def forecast_seasonal_features(spark, sf_dir):
    from pyspark.sql import functions as F
    daily = fcst.daily_series(star_from_tpch(spark, sf_dir), FilterSpec())
    return daily.select("ds", *fcst.seasonal_features(F.col("ds"), digits=6))


def _forecast(spark, sf_dir, stage=False, **kw):
    """Each query reads one frame, so only the chart (two reads of the
    predictions) stages them."""
    return fcst.revenue_forecast(star_from_tpch(spark, sf_dir), stage=stage, **kw)


@register("forecast_revenue")
def forecast_revenue(spark, sf_dir):
    return _forecast(spark, sf_dir, steps=30)["predictions"]


@register("forecast_panel")
def forecast_panel(spark, sf_dir):
    return _forecast(spark, sf_dir, steps=30, keys=PANEL_KEYS)["predictions"]


@register("forecast_summary")
def forecast_summary(spark, sf_dir):
    return _forecast(spark, sf_dir, steps=30)["summary"]


@register("forecast_summary_filtered")
def forecast_summary_filtered(spark, sf_dir):
    return _forecast(spark, sf_dir, steps=60, store=STORE, category=CATEGORY)["summary"]


@register("forecast_predictions_tail")
def forecast_predictions_tail(spark, sf_dir):
    return _forecast(spark, sf_dir, steps=30, category=CATEGORY)["predictions_tail"]


@register("forecast_chart_series")
def forecast_chart_series(spark, sf_dir):
    return _forecast(spark, sf_dir, steps=30, store=STORE, stage=True)["chart"]


# Named holidays by date: one that moves from year to year, one with days
# after it, one with days on both sides that crosses the end of the year.
HOLIDAY_SQL = f"""
daily AS ({daily_sql(["category"])}),
span AS (SELECT min(year(ds)) AS lo, max(year(ds)) + 1 AS hi FROM daily),
years AS (SELECT CAST(unnest(range(lo, hi + 1)) AS BIGINT) AS y FROM span),
hol AS (
  SELECT 'spring_sunday' AS holiday, CAST(make_date(y, 3, 31) - CAST(dayofweek(make_date(y, 3, 31)) AS INTEGER) AS DATE) AS ds,
         0 AS lower_window, 0 AS upper_window FROM years
  UNION ALL
  SELECT 'harvest', CAST(make_date(y, 11, 22) + CAST((11 - dayofweek(make_date(y, 11, 22))) % 7 AS INTEGER) AS DATE),
         0, 1 FROM years
  UNION ALL SELECT 'year_end', make_date(y, 12, 31), -2, 1 FROM years),
hol_days AS (
  SELECT CAST(ds + CAST(sh AS INTEGER) AS DATE) AS ds,
         CASE WHEN sh = 0 THEN holiday WHEN sh > 0 THEN holiday || '+' || sh
              ELSE holiday || sh END AS effect
  FROM (SELECT *, unnest(range(lower_window, upper_window + 1)) AS sh FROM hol))"""


def named_holidays(daily: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    y = F.col("y")
    years = daily.agg(F.min(F.year("ds")).alias("lo"), (F.max(F.year("ds")) + 1).alias("hi")) \
                 .select(F.explode(F.sequence("lo", "hi")).alias("y"))
    entries = [("spring_sunday", fcst.nth_weekday(y, 3, 1, -1), 0, 0),
               ("harvest", fcst.nth_weekday(y, 11, 5, 4), 0, 1),
               ("year_end", F.make_date(y, F.lit(12), F.lit(31)), -2, 1)]
    return years.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("holiday"), d.alias("ds"), F.lit(a).alias("lower_window"),
                 F.lit(b).alias("upper_window")) for n, d, a, b in entries])))


def _category_daily(spark, sf_dir):
    """Daily revenue per category, written once for its several readers."""
    from salescope.session import materialize
    return materialize(fcst.daily_series(star_from_tpch(spark, sf_dir), FilterSpec(),
                                         ["category"]), "daily")


@register("forecast_holiday_frame", HOLIDAY_SQL.lstrip() + f""",
last AS (SELECT category, max(ds) AS last_ds FROM daily GROUP BY 1),
frame AS (
  SELECT category, ds, CAST(holiday_flag AS DOUBLE) AS holiday_flag, false AS is_forecast FROM daily
  UNION ALL
  SELECT category, CAST(last_ds + CAST(i AS INTEGER) AS DATE), 0.0, true FROM last, range(1, 401) r(i)),
eff AS (SELECT ds, string_agg(effect, ',' ORDER BY effect) AS effects FROM hol_days GROUP BY 1)
SELECT category AS series, frame.ds, holiday_flag, is_forecast, coalesce(effects, '') AS effects
FROM frame LEFT JOIN eff ON frame.ds = eff.ds""")
def forecast_holiday_frame(spark, sf_dir):
    """History and 400 future days per category with the named effects of each day."""
    from pyspark.sql import functions as F
    daily = _category_daily(spark, sf_dir)
    rows = fcst.model_input(daily, ["category"], 400, holidays=named_holidays(daily))
    return rows.select("series", "ds", "holiday_flag", "is_forecast",
                       F.array_join("effects", ",").alias("effects"))


@register("forecast_holiday_days", HOLIDAY_SQL.lstrip() + f""",
last AS (SELECT category, max(ds) AS last_ds FROM daily GROUP BY 1),
known AS (SELECT DISTINCT category, effect FROM daily JOIN hol_days USING (ds)),
flagged AS (SELECT category, ds FROM daily WHERE holiday_flag
  UNION
  SELECT l.category, h.ds FROM last l JOIN known k ON l.category = k.category
  JOIN hol_days h ON h.effect = k.effect AND h.ds > l.last_ds AND h.ds <= l.last_ds + 400
  UNION
  SELECT d.category, d.ds FROM daily d JOIN hol_days USING (ds))
SELECT category AS series, ds FROM flagged""")
def forecast_holiday_days(spark, sf_dir):
    """The days on which a fitted forecast has a holiday component: those of
    the flag and of the named holidays that the history holds, no others."""
    daily = _category_daily(spark, sf_dir)
    pred = fcst.forecast(daily, ["category"], 400, holidays=named_holidays(daily))
    return pred.where("holidays <> 0").select("series", "ds")


# Coefficients of a saved forecaster (scaled units).
SAVED = {"changepoints": [0.25, 0.5], "base": [0.5, 0.2], "steps": [-0.3, 0.1],
         "yearly": [(0.01 / k, -0.02 / k) for k in range(1, fcst.YEARLY_ORDER + 1)],
         "weekly": [(0.03 / k, 0.01 / k) for k in range(1, fcst.WEEKLY_ORDER + 1)],
         "flag": 0.05, "sigma2": 0.01}


def saved_coefficients(daily: DataFrame) -> DataFrame:
    """A coefficient table with known coefficients, scaled by each category's history."""
    from pyspark.sql import functions as F
    beta = [*SAVED["base"], *SAVED["steps"], *[v for ab in SAVED["yearly"] for v in ab],
            *[v for ab in SAVED["weekly"] for v in ab], SAVED["flag"]]
    day = F.datediff("ds", F.lit("1970-01-01").cast("date"))

    def array(values):
        return F.array(*[F.lit(float(v)) for v in values])

    return daily.groupBy(F.col("category").alias("series")).agg(
        F.min(day).cast("double").alias("d0"),
        F.greatest(F.max(day) - F.min(day), F.lit(1)).cast("double").alias("span"),
        F.max(F.abs("y")).alias("scale")).select(
        "*", array(SAVED["changepoints"]).alias("changepoints"), array(beta).alias("beta"),
        F.lit(SAVED["sigma2"]).alias("sigma2"),
        F.array_repeat(F.lit(0.0), len(beta) ** 2).alias("a_inv"),
        array([0.0]).alias("reg_mu"), array([1.0]).alias("reg_sd"),
        F.array().cast("array<string>").alias("effects"))


def saved_sql() -> str:
    def wave(pairs, period):
        def arg(k):
            return f"{2.0 * math.pi * k!r} * day / {float(period)!r}"
        return " + ".join(f"{a!r} * sin({arg(k)}) + {b!r} * cos({arg(k)})"
                          for k, (a, b) in enumerate(pairs, 1))
    hinges = " + ".join(f"{d!r} * greatest(t - {c!r}, 0.0)"
                        for d, c in zip(SAVED["steps"], SAVED["changepoints"]))
    comps = ("trend", "weekly", "yearly", "holidays")
    return f"""
daily AS ({daily_sql(["category"])}),
par AS (SELECT category, min(ds) AS d0, max(ds) AS last_ds, max(abs(y)) AS scale,
               CAST(greatest(max(ds) - min(ds), 1) AS DOUBLE) AS span FROM daily GROUP BY 1),
frame AS (
  SELECT category, ds, CAST(holiday_flag AS DOUBLE) AS flag, false AS ahead FROM daily
  UNION ALL
  SELECT category, CAST(last_ds + CAST(i AS INTEGER) AS DATE), 0.0, true FROM par, range(1, 91) r(i)),
x AS (SELECT f.*, scale, CAST(ds - d0 AS DOUBLE) / span AS t,
             CAST(ds - DATE '1970-01-01' AS DOUBLE) AS day
      FROM frame f JOIN par USING (category)),
c AS (SELECT category, ds, ahead, scale,
        ({SAVED["base"][0]!r} + {SAVED["base"][1]!r} * t + {hinges}) * scale AS trend,
        ({wave(SAVED["weekly"], fcst.WEEKLY_PERIOD)}) * scale AS weekly,
        ({wave(SAVED["yearly"], fcst.YEARLY_PERIOD)}) * scale AS yearly,
        {SAVED["flag"]!r} * flag * scale AS holidays FROM x)
SELECT category AS series, ds, round({" + ".join(comps)}, 1) + 0.0 AS yhat,
       {", ".join(f"round({n}, 1) + 0.0 AS {n}" for n in comps)},
       CASE WHEN NOT ahead THEN round({2 * fcst.Z_80 * math.sqrt(SAVED["sigma2"])!r} * scale, 1) END AS width,
       true AS inside
FROM c"""


@register("forecast_from_saved", saved_sql())
def forecast_from_saved(spark, sf_dir):
    """Predictions from a coefficient table for the history and 90 days after
    it: components, width of the band over the history, and whether the band
    contains the prediction and widens after the history."""
    from pyspark.sql import functions as F
    daily = _category_daily(spark, sf_dir)
    dates = fcst.model_input(daily, ["category"], 90)
    last = daily.groupBy(F.col("category").alias("series")).agg(
        F.max("ds").alias("last_ds"), F.max(F.abs("y")).alias("scale"))
    pred = fcst.predict_with_coefficients(saved_coefficients(daily), dates).join(last, "series")
    width = F.col("yhat_upper") - F.col("yhat_lower")
    known = F.lit(2 * fcst.Z_80 * math.sqrt(SAVED["sigma2"])) * F.col("scale")
    ahead = F.col("ds") > F.col("last_ds")
    names = ("yhat", "trend", "weekly", "yearly", "holidays")
    return pred.select(
        "series", "ds", *[(F.round(n, 1) + 0.0).alias(n) for n in names],
        F.when(~ahead, F.round(width, 1)).alias("width"),
        (F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper"))
         & (~ahead | (width > 0.99 * known))).alias("inside"))


# ---------------------------------------------------------------- ETL
from salescope.operators import clean as cln  # noqa: E402
from salescope.operators import star_build as sb  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from salescope.sources.raw import (  # noqa: E402
    BROKEN_COLUMNS, DIRTY_SQL, broken_sales, dirty_sales)

_ETL_CACHE: dict = {}


class _Etl:
    """The cleaning result and, built on first use, the loaded star."""

    def __init__(self, cr):
        self.cr = cr
        self._lr = None

    def __getitem__(self, i):
        if i == 0:
            return self.cr
        if self._lr is None:
            self._lr = sb.load_star(self.cr.rows)
        return self._lr


def _etl(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ETL_CACHE:
        _ETL_CACHE[key] = _Etl(cln.clean_sales(dirty_sales(spark, sf_dir)))
    return _ETL_CACHE[key]


def _std(col: str) -> str:
    t = title_sql(f"regexp_replace(coalesce({col}, 'Unknown'), '^\\s+|\\s+$', '', 'g')")
    return f"CASE WHEN {t} IN ('Nan', 'None', '') THEN 'Unknown' ELSE {t} END"


DATA_COLS = ['"Date"', '"Store_Location"', '"Store_Rating"', '"Product_Category"',
             '"Product_Subcategory"', '"Brand"', '"Stock_On_Hand"', '"Unit_Price"',
             '"Discount_Percentage"', '"Revenue"', '"Promotion_Applied"']
TEXT = {'"Store_Location"', '"Product_Category"', '"Product_Subcategory"', '"Brand"',
        '"Promotion_Applied"'}


def etl_ctes() -> str:
    s1 = ", ".join(f"{_std(c)} AS {c}" if c in TEXT else c for c in DATA_COLS)
    s3 = ", ".join('coalesce("Store_Rating", (SELECT m FROM med)) AS "Store_Rating"'
                   if c == '"Store_Rating"' else
                   'coalesce("Discount_Percentage", 0.0) AS "Discount_Percentage"'
                   if c == '"Discount_Percentage"' else c for c in DATA_COLS)
    cols = ", ".join(DATA_COLS)
    return DIRTY_SQL.strip() + f""",
s1 AS (SELECT _row, {s1} FROM dirty),
s2 AS (SELECT *, "Date" IS NULL OR "Revenue" IS NULL AS crit,
              NOT ("Date" IS NULL OR "Revenue" IS NULL)
              AND NOT (coalesce("Revenue" >= 0, false) AND coalesce("Unit_Price" >= 0, false)) AS anom
       FROM s1),
kept AS (SELECT * FROM s2 WHERE NOT crit AND NOT anom),
med AS (SELECT median("Store_Rating") AS m FROM kept),
s3 AS (SELECT _row, "Store_Rating" IS NULL AS fill_r, "Discount_Percentage" IS NULL AS fill_d, {s3}
       FROM kept),
clean AS (SELECT min(_row) AS _row, {cols} FROM s3 GROUP BY {cols}),
dim_s AS (SELECT row_number() OVER (ORDER BY f, "Store_Location") AS store_id,
                 "Store_Location" AS store_location, store_rating
          FROM (SELECT "Store_Location", arg_min("Store_Rating", _row) AS store_rating,
                       min(_row) AS f FROM clean GROUP BY 1)),
dim_p AS (SELECT row_number() OVER (ORDER BY f, "Product_Category", "Unit_Price",
                 "Product_Subcategory", "Brand", "Stock_On_Hand") AS product_id,
                 "Product_Category" AS category, "Product_Subcategory" AS subcategory,
                 "Brand" AS brand, CAST("Unit_Price" AS DOUBLE) AS unit_price,
                 coalesce(CAST("Stock_On_Hand" AS INTEGER), 0) AS stock_on_hand
          FROM (SELECT "Product_Category", "Unit_Price", "Product_Subcategory", "Brand",
                       "Stock_On_Hand", min(_row) AS f FROM clean GROUP BY ALL)),
look AS (SELECT category, subcategory, brand, unit_price, max(product_id) AS product_id
         FROM dim_p GROUP BY ALL),
facts AS (SELECT CAST(c."Date" AS TIMESTAMP) AS ts, s.store_id, l.product_id,
                 coalesce(c."Discount_Percentage", 0.0) AS discount_percentage,
                 CAST(CAST(c."Revenue" AS DECIMAL(17,4)) AS DOUBLE) AS revenue,
                 'Unknown' AS customer_type, 'Unknown' AS payment_mode,
                 lower(trim(c."Promotion_Applied")) IN ('true', 'yes', 'y', '1', 't') AS promotion_applied,
                 false AS holiday_flag
          FROM clean c JOIN dim_s s ON c."Store_Location" = s.store_location
          JOIN look l ON c."Product_Category" IS NOT DISTINCT FROM l.category
                     AND c."Product_Subcategory" IS NOT DISTINCT FROM l.subcategory
                     AND c."Brand" IS NOT DISTINCT FROM l.brand
                     AND CAST(c."Unit_Price" AS DOUBLE) IS NOT DISTINCT FROM l.unit_price)"""


def etl_sql(select: str) -> str:
    return etl_ctes() + "\n" + select


@register("clean_rows", etl_sql("SELECT * FROM clean"))
def clean_rows(spark, sf_dir):
    return _etl(spark, sf_dir)[0].rows


@register("clean_report", etl_sql("""
SELECT * FROM (
  SELECT n_in, n_out, unnest([
    {'step': 'input', 'rows_removed': 0, 'cells_filled': 0},
    {'step': 'standardize_strings', 'rows_removed': 0, 'cells_filled': 0},
    {'step': 'drop_missing_critical', 'rows_removed': n_crit, 'cells_filled': 0},
    {'step': 'drop_anomalies', 'rows_removed': n_anom, 'cells_filled': 0},
    {'step': 'impute_median_rating', 'rows_removed': 0, 'cells_filled': n_r},
    {'step': 'impute_zero_discount', 'rows_removed': 0, 'cells_filled': n_d},
    {'step': 'drop_exact_duplicates', 'rows_removed': n_kept - n_out, 'cells_filled': 0}],
    recursive := true)
  FROM (SELECT (SELECT count(*) FROM s2) AS n_in,
               (SELECT count(*) FILTER (WHERE crit) FROM s2) AS n_crit,
               (SELECT count(*) FILTER (WHERE anom) FROM s2) AS n_anom,
               (SELECT count(*) FILTER (WHERE fill_r) FROM s3) AS n_r,
               (SELECT count(*) FILTER (WHERE fill_d) FROM s3) AS n_d,
               (SELECT count(*) FROM s3) AS n_kept,
               (SELECT count(*) FROM clean) AS n_out))"""))
def clean_report(spark, sf_dir):
    return _etl(spark, sf_dir)[0].report


@register("median_impute", etl_sql("SELECT m AS median FROM med"))
def median_impute(spark, sf_dir):
    return _etl(spark, sf_dir)[0].median_rating


@register("store_dimension", etl_sql("SELECT * FROM dim_s"))
def store_dimension(spark, sf_dir):
    return _etl(spark, sf_dir)[1].star.stores


@register("product_dimension", etl_sql("SELECT * FROM dim_p"))
def product_dimension(spark, sf_dir):
    return _etl(spark, sf_dir)[1].star.products


@register("fact_rows", etl_sql("SELECT * FROM facts"))
def fact_rows(spark, sf_dir):
    from pyspark.sql import functions as F
    tx = _etl(spark, sf_dir)[1].star.transactions
    return tx.drop("transaction_id").withColumn("revenue", F.col("revenue").cast("double"))


@register("rejected_rows", etl_sql("""
SELECT c.*, 'unknown_store' AS reject_reason FROM clean c WHERE c."Store_Location" NOT IN
  (SELECT store_location FROM dim_s) AND false"""))
def rejected_rows(spark, sf_dir):
    return _etl(spark, sf_dir)[1].rejected


def _rule_sql(rules) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({p}, false)) AS failures FROM facts"
        for n, p in rules)


@register("validate_rows", etl_sql(_rule_sql(sb.TRANSACTION_RULES)))
def validate_rows(spark, sf_dir):
    from pyspark.sql import functions as F
    tx = _etl(spark, sf_dir)[1].star.transactions
    return sb.validation_summary(tx.withColumn("revenue", F.col("revenue").cast("double")),
                                 sb.TRANSACTION_RULES)


# ---------------------------------------------------------------- more model views
@register("load_report", etl_sql("""
SELECT 'stores' AS "table", count(*) AS "rows" FROM dim_s
UNION ALL SELECT 'products', count(*) FROM dim_p
UNION ALL SELECT 'transactions', count(*) FROM facts
UNION ALL SELECT 'rejected', 0"""))
def load_report(spark, sf_dir):
    return sb.load_report(_etl(spark, sf_dir)[1])


def broken_sql(select: str) -> str:
    """The cleaning and load of the dirty rows, over the broken ones."""
    ctes = etl_ctes().replace('CAST(c."Date" AS TIMESTAMP)', 'TRY_CAST(c."Date" AS TIMESTAMP)')
    rows = f"broken AS ({BROKEN_COLUMNS} FROM dirty),\ns1 AS ("
    ctes = ctes.replace("s1 AS (", rows, 1)
    return ctes.replace("FROM dirty),\ns2", "FROM broken),\ns2", 1) + "\n" + select


def _broken_load(spark, sf_dir):
    return sb.load_star(cln.clean_sales(broken_sales(spark, sf_dir)).rows)


@register("load_report_broken", broken_sql("""
SELECT 'stores' AS "table", count(*) AS "rows" FROM dim_s
UNION ALL SELECT 'products', count(*) FROM dim_p
UNION ALL SELECT 'transactions', count(*) FROM facts WHERE ts IS NOT NULL
UNION ALL SELECT 'rejected', count(*) FROM facts WHERE ts IS NULL"""))
def load_report_broken(spark, sf_dir):
    return sb.load_report(_broken_load(spark, sf_dir))


@register("reject_rows", broken_sql("""
SELECT r."Date", r."Store_Location", r."Product_Subcategory", CAST(r."Revenue" AS DOUBLE) AS "Revenue",
       'unparsable_timestamp' AS reject_reason
FROM clean r WHERE TRY_CAST(r."Date" AS TIMESTAMP) IS NULL"""))
def reject_rows(spark, sf_dir):
    return _broken_load(spark, sf_dir).rejected.select(
        "Date", "Store_Location", "Product_Subcategory",
        F.col("Revenue").cast("double").alias("Revenue"), "reject_reason")


@register("validate_star", broken_sql("""
SELECT 'stores' AS "table", * FROM (
  SELECT 'store_location_required' AS rule,
         count(*) FILTER (WHERE coalesce(store_location, '') = '') AS failures FROM dim_s
  UNION ALL SELECT 'store_rating_range',
         count(*) FILTER (WHERE store_rating IS NULL OR store_rating < 0 OR store_rating > 5) FROM dim_s)
UNION ALL SELECT 'products', * FROM (
  SELECT 'category_required', count(*) FILTER (WHERE coalesce(category, '') = '') FROM dim_p
  UNION ALL SELECT 'unit_price_positive', count(*) FILTER (WHERE unit_price IS NULL OR unit_price <= 0) FROM dim_p
  UNION ALL SELECT 'stock_non_negative', count(*) FILTER (WHERE stock_on_hand IS NULL OR stock_on_hand < 0) FROM dim_p)
UNION ALL SELECT 'transactions', * FROM (
  SELECT unnest([
    {'rule': 'store_id_required', 'failures': count(*) FILTER (WHERE store_id IS NULL)},
    {'rule': 'product_id_required', 'failures': count(*) FILTER (WHERE product_id IS NULL)},
    {'rule': 'discount_range',
     'failures': count(*) FILTER (WHERE discount_percentage < 0 OR discount_percentage > 100)},
    {'rule': 'revenue_non_negative', 'failures': count(*) FILTER (WHERE revenue < 0)},
    {'rule': 'customer_type_required', 'failures': count(*) FILTER (WHERE customer_type IS NULL)},
    {'rule': 'payment_mode_required', 'failures': count(*) FILTER (WHERE payment_mode IS NULL)}],
    recursive := true)
  FROM facts WHERE ts IS NOT NULL)"""))
def validate_star(spark, sf_dir):
    return sb.validate_star(_broken_load(spark, sf_dir))


@register("load_repeated", etl_sql("""
SELECT s.store_location, count(*) AS transactions, count(DISTINCT f.product_id) AS products,
       CAST(sum(CAST(f.revenue AS DECIMAL(17,4))) AS DOUBLE) AS revenue
FROM facts f JOIN dim_s s ON f.store_id = s.store_id GROUP BY 1"""))
def load_repeated(spark, sf_dir):
    """The dirty rows as two folders of CSV files, loaded one after the other
    and then both again: the repeated load adds nothing."""
    from pyspark.sql import functions as F

    from salescope.session import scratch_path
    from salescope.sources.loads import load_files, read_loaded_star
    raw = dirty_sales(spark, sf_dir)
    halves = [scratch_path(spark, f"raw-{i}") for i in (0, 1)]
    for i, path in enumerate(halves):
        raw.where(F.col("_row") % 2 == i).drop("_row").write.csv(
            path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    root = scratch_path(spark, "loaded-star")
    for paths in ([halves[0]], [halves[1]], halves):
        load_files(spark, paths, root)
    star = read_loaded_star(spark, root)
    return star.transactions.join(star.stores, "store_id").groupBy("store_location").agg(
        F.count(F.lit(1)).alias("transactions"), F.count_distinct("product_id").alias("products"),
        F.sum("revenue").cast("double").alias("revenue"))


@register("local_explanation")
def local_explanation(spark, sf_dir):
    return drv.all_explanations(_driver_model(spark, sf_dir))


@register("gain_importance")
def gain_importance(spark, sf_dir):
    return _driver_model(spark, sf_dir).model.importance("gain")


@register("explain_entries_sampled")
def explain_entries_sampled(spark, sf_dir):
    return drv.sorted_entries(drv.explain_entries(_driver_model(spark, sf_dir), sample_rows=2000))


@register("forecast_coefficients")
def forecast_coefficients(spark, sf_dir):
    daily = fcst.daily_series(star_from_tpch(spark, sf_dir), FilterSpec(), PANEL_KEYS, stage=True)
    return fcst.fit_coefficients(daily, PANEL_KEYS)


# ---------------------------------------------------------------- one-pass overview
def _one_pass(spark, sf_dir, frame):
    return ov.overview_one_pass(star_from_tpch(spark, sf_dir),
                                FilterSpec(365, STORE, CATEGORY))[frame]


@register("overview_one_pass_kpis", kpi_sql(365, STORE, CATEGORY))
def overview_one_pass_kpis(spark, sf_dir):
    return _one_pass(spark, sf_dir, "kpis")


@register("overview_one_pass_trend", trend_sql(365, STORE, CATEGORY))
def overview_one_pass_trend(spark, sf_dir):
    return _one_pass(spark, sf_dir, "revenue_trend")


@register("overview_one_pass_top_stores", top_sql("store_location", 365, None, CATEGORY))
def overview_one_pass_top_stores(spark, sf_dir):
    return _one_pass(spark, sf_dir, "top_stores")


@register("overview_one_pass_top_categories", top_sql("category", 365, STORE, None))
def overview_one_pass_top_categories(spark, sf_dir):
    return _one_pass(spark, sf_dir, "top_categories")


@register("forecast_extra_regressor")
def forecast_extra_regressor(spark, sf_dir):
    """Panel forecast with the daily mean discount as an extra regressor;
    its future value is each series' historical mean."""
    from pyspark.sql import functions as F
    star = star_from_tpch(spark, sf_dir)
    regs = {"avg_discount": F.avg("discount_percentage")}
    from salescope.session import checkpoint_dir
    checkpoint_dir(spark)
    # Read for history, last dates and means: written once.
    daily = fcst.daily_series(star, FilterSpec(), ["category"], regs).checkpoint(eager=True)
    means = daily.groupBy("category").agg(F.avg("avg_discount").alias("avg_discount"))
    future = fcst.future_frame(daily, ["category"], 30).join(means, "category")
    return fcst.forecast(daily, ["category"], 30, regressors=["avg_discount"],
                         future=future.select("category", "ds", "avg_discount"))


# ---------------------------------------------------------------- more relational views
@register("driver_feature_rows", f"""
SELECT t.discount_percentage, t.customer_type, t.payment_mode, t.promotion_applied,
       t.holiday_flag, CAST(t.revenue AS DOUBLE) AS revenue, s.store_rating, p.category
{JOINED} {where(365)}""")
def driver_feature_rows(spark, sf_dir):
    return drv.driver_rows(star_from_tpch(spark, sf_dir), FilterSpec(days=365))


@register("driver_feature_rows_all", f"""
SELECT t.discount_percentage, t.customer_type, t.payment_mode, t.promotion_applied,
       t.holiday_flag, CAST(t.revenue AS DOUBLE) AS revenue, s.store_rating, p.category
{JOINED}""")
def driver_feature_rows_all(spark, sf_dir):
    return drv.driver_rows(star_from_tpch(spark, sf_dir), FilterSpec())


@register("clean_strings", DIRTY_SQL.strip() + "\n" + f"""
SELECT _row, "Date", {', '.join(f"{_std(c)} AS {c}" if c in TEXT else c for c in DATA_COLS[1:])}
FROM dirty""")
def clean_strings(spark, sf_dir):
    return cln.standardize_strings(dirty_sales(spark, sf_dir))
