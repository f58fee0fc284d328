"""Ranks, pools and samples over groups. Every order ends in a unique key, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """Rows with their 1-based rank within ``by``, the first ``n`` of each (None: all)."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


def min_max(rows: DataFrame, pool: str, score: str, constant: float, name: str) -> DataFrame:
    """``score`` scaled to 0..1 within each pool; ``constant`` where all of a pool's scores agree.

    Bounds come from an aggregate that is joined back, not from a window: a pool may be large.
    """
    bounds = rows.groupBy(F.col(pool).alias("_pool")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span == 0, F.lit(constant)).otherwise((F.col(score) - F.col("_low")) / span)
    return rows.join(bounds, F.col(pool).eqNullSafe(F.col("_pool"))).withColumn(name, scaled).drop("_pool", "_low", "_high")


def best_per_document(ranked: DataFrame, query: str, document: str, score: str, order: list[Column]) -> DataFrame:
    """The best-scoring row of each document of a query, re-ranked densely. The first in ``order`` wins ties."""
    best = top_n(ranked, [query, document], order, 1, "_first").drop("_first", "rank")
    return top_n(best, [query], [F.col(score).desc(), F.col(document).asc()], None)


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, bucket: Column | None = None) -> DataFrame:
    """About ``size`` rows, spread over the strata in proportion, at evenly spaced places of the key order.

    Shares are rounded by largest remainder; every stratum gets a row, so more strata than
    ``size`` give one row each. No randomness. Null strata form one stratum. ``bucket``, a function
    of the key that never falls as the key grows, lets a large stratum be numbered in pieces.
    """
    counts = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    share = F.col("_n") * F.lit(size) / F.col("_total")
    shares = counts.join(F.broadcast(total)).withColumn("_share", share).withColumn("_floor", F.greatest(F.floor("_share"), F.lit(1)))
    spare = F.lit(size) - F.sum("_floor").over(Window.partitionBy())  # one row per stratum
    place = F.row_number().over(Window.orderBy((F.col("_share") - F.col("_floor")).desc(), F.col("_s").asc_nulls_first()))
    slots = shares.withColumn("_slots", F.least(F.col("_n"), F.col("_floor") + F.when(place <= spare, 1).otherwise(0))).select("_s", "_n", "_slots")
    pieces = rows.withColumn("_b", F.lit(0) if bucket is None else bucket)
    earlier = F.sum("_m").over(Window.partitionBy("_p").orderBy(F.col("_b2").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.groupBy(F.col(stratum).alias("_p"), F.col("_b").alias("_b2")).agg(F.count(F.lit(1)).alias("_m")).select("_p", "_b2", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    local = pieces.withColumn("_j", F.row_number().over(Window.partitionBy(stratum, "_b").orderBy(key)) - 1)
    numbered = local.join(offsets, F.col(stratum).eqNullSafe(F.col("_p")) & F.col("_b").eqNullSafe(F.col("_b2"))).withColumn("_i", F.col("_j") + F.col("_offset")).join(slots, F.col(stratum).eqNullSafe(F.col("_s")))
    slot = F.ceil(F.col("_i") * F.col("_slots") / F.col("_n"))
    chosen = (slot < F.col("_slots")) & (F.floor(slot * F.col("_n") / F.col("_slots")) == F.col("_i"))
    return numbered.filter(chosen).drop("_i", "_j", "_b", "_b2", "_p", "_offset", "_s", "_n", "_slots")


def carried_flag(rows: DataFrame, by: str, order: str, flag: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: true from the first row of its group on whose ``flag`` is true.

    The first such ``order`` of each group is an aggregate that is joined back; no group is sorted.
    """
    first = rows.groupBy(F.col(by).alias("_by")).agg(F.min(F.when(flag, F.col(order))).alias("_first"))
    return rows.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.coalesce(F.col(order) >= F.col("_first"), F.lit(False))).drop("_by", "_first")
