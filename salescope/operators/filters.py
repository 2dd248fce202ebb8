"""Shared filters (look-back, store, category) and the enriched fact frame.

Every analysis reads ``transactions ⋈ stores ⋈ products`` (inner joins, so
facts with a null or orphan key never count) restricted by a
:class:`FilterSpec`.  ``None`` and ``''`` both mean "no filter".
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salescope.session import delete_tables, materialize, recorded_tables, release_shuffles
from salescope.sources.star import JOINED_ATTRIBUTES, Star

MAX_OVERVIEW_DAYS = 9999
MAX_BROADCAST_STORES = 500_000      # stores sent to every executor at most


@dataclass(frozen=True)
class FilterSpec:
    """Look-back in days (0 = all time), store location and category."""

    days: int = 0
    store: str | None = None
    category: str | None = None

    def __post_init__(self):
        if self.days is None or int(self.days) < 0:
            raise ValueError(f"days must be >= 0, got {self.days!r}")

    def without(self, *fields: str) -> "FilterSpec":
        """The same spec with some filters removed (cross-filter exemption)."""
        return dataclasses.replace(self, **{f: (0 if f == "days" else None) for f in fields})


def newest_rows(transactions: DataFrame) -> DataFrame:
    """Rows among which the newest is: of a written star, those of the newest
    day.  The days are partition values, so finding the newest one reads no
    column; only that day's folder is left to read."""
    if "sale_date" not in transactions.columns:
        return transactions
    day = transactions.agg(F.max("sale_date").alias("m")).first()["m"]
    return transactions.where(F.col("sale_date") == F.lit(day))


def newest_timestamp(transactions: DataFrame):
    """max(ts) over all transactions, ignoring every other filter; None
    without rows.

    Resolved as one small aggregate so the cutoff becomes a literal: a literal
    predicate reaches the Parquet scan (row-group skipping, partition pruning
    on a date-partitioned fact table), a scalar subquery does not.
    """
    return newest_rows(transactions).agg(F.max("ts").alias("m")).first()["m"]


def lookback_predicate(transactions: DataFrame, days: int) -> Column | None:
    """``ts >= max(ts) - days`` (inclusive); None when days == 0.

    An empty fact table has no newest timestamp; the predicate is then
    ``false`` so every analysis sees no rows instead of failing.
    """
    if not days:
        return None
    newest = newest_timestamp(transactions)
    if newest is None:
        return F.lit(False)
    ts_type = transactions.schema["ts"].dataType.simpleString()
    cutoff = F.lit(newest.isoformat(sep=" ")).cast(ts_type) - F.expr(f"INTERVAL {int(days)} DAYS")
    pred = F.col("ts") >= cutoff
    if "sale_date" in transactions.columns:
        # Implied by the ts predicate; stated on the partition column so the
        # scan skips whole date partitions of a written star.
        pred = pred & (F.col("sale_date") >= F.to_date(cutoff))
    return pred


def fact_rows(star: Star, columns: list[str] | None = None) -> DataFrame:
    """The fact frame to read: the narrow one when the requested columns do
    not include an attribute that needs a lookup join."""
    if star.narrow is not None and columns is not None \
            and not set(columns) & set(JOINED_ATTRIBUTES):
        return star.narrow
    return star.transactions


def enriched(star: Star, spec: FilterSpec, columns: list[str] | None = None) -> DataFrame:
    """Facts joined to both dimensions with the spec's predicates applied.

    Dimension predicates are applied to the dimension before the join so the
    planner can shrink (and, when small enough, broadcast) that side; the
    look-back predicate lands on the fact scan.
    """
    tx, stores, products = _filtered(star, spec, fact_rows(star, columns))
    df = tx.join(stores, "store_id", "inner").join(products, "product_id", "inner")
    return df.select(*columns) if columns else df


def _filtered(star: Star, spec: FilterSpec, tx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts, stores and products that the spec leaves."""
    stores = star.stores
    products = star.products
    preds = []
    lb = lookback_predicate(tx, spec.days)
    if lb is not None:
        preds.append(lb)
    if spec.store:
        stores = stores.filter(F.col("store_location") == spec.store)
    if spec.category:
        products = products.filter(F.col("category") == spec.category)
    if preds:
        tx = tx.filter(reduce(lambda a, b: a & b, preds))
    return tx, stores, products


def staged_rows(star: Star, spec: FilterSpec, columns: list[str], name: str) -> DataFrame:
    """The rows of ``enriched``, written.  A join that shuffles the facts is
    written before the next begins, as the shuffle files of all joins of one job
    are kept until its end; each step holds only the columns that are still
    needed.  Stores are sent to all executors if they are counted to be few."""
    looked_up = star.parts is not None and set(columns) & set(JOINED_ATTRIBUTES)
    tx, stores, products = _filtered(star, spec, star.parts.lines if looked_up
                                     else fact_rows(star, columns))
    late = star.parts.late if looked_up else {}
    few = stores.limit(MAX_BROADCAST_STORES + 1).count() <= MAX_BROADCAST_STORES
    steps = [(products, "product_id", "inner", True), (stores, "store_id", "inner", not few)]
    if looked_up:
        steps.append((star.parts.attributes, star.parts.key, "left", True))

    def write(rows: DataFrame, before: list[str]) -> tuple[DataFrame, list[str]]:
        with recorded_tables() as paths:
            out = materialize(rows, name)
        release_shuffles(rows.sparkSession)
        delete_tables(rows.sparkSession, before)
        return out, paths

    rows, paths, shuffled = tx, [], False
    wanted = set(columns) | {x for c in columns if c in late for x in late[c][1]}
    for i, (side, key, how, shuffles) in enumerate(steps):
        if shuffled and shuffles:
            rows, paths = write(rows, paths)
        keys = {k for _, k, *_ in steps[i:]}
        side = side.select(*[c for c in side.columns if c == key or c in wanted])
        rows = rows.select(*[c for c in rows.columns if c in wanted | keys])
        rows = rows.join(side if shuffles else F.broadcast(side), key, how)
        shuffled |= shuffles
    return write(rows.select(*[late[c][0].alias(c) if c in late else c for c in columns]), paths)[0]


def check_overview_days(days: int) -> None:
    if not 0 <= int(days) <= MAX_OVERVIEW_DAYS:
        raise ValueError(f"days must be within 0..{MAX_OVERVIEW_DAYS}")
