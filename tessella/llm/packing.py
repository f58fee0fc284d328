"""Filling fixed-capacity containers by first-fit decreasing in randomised groups.

Items fall into groups by a seeded hash of id, size, part and a number that tells equal rows apart,
so a group's size is set by a parameter whatever the skew of ids (one id or null on a third of all
rows included), and groups pack independently. Within a group a tournament tree over
the bins' free room finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items aimed at per group. More waste at the end of each group with fewer, longer tasks with more.
GROUP_ITEMS = 4096


class FreeRoom:
    """A tournament tree: each node holds the largest free room of the bins below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """Put an item into the first bin with enough room and give that bin's number."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < size:
                node += 1
        bin_ = node - self.width
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; sizes must be sorted, largest first, and none above the capacity."""
    tree = FreeRoom(len(sizes), capacity)
    return [tree.place(s) for s in sizes]


def pack(items: DataFrame, capacities: DataFrame, total: DataFrame | None = None, group_items: int = GROUP_ITEMS, seed: int = 7, largest_capacities: int = 64) -> DataFrame:
    """(capacity_id, group, bin, id, part, start, tokens): the container of every item, for every capacity.

    ``items``: id, tokens (null counts as 0). ``capacities``: capacity_id, capacity; at most
    ``largest_capacities`` rows, else ValueError; rows with a null or a capacity below 1 are left
    out. An item above the capacity, and only such an item, is split: into full containers and a
    remainder, which is packed like other items; ``part`` counts from 0, ``start`` is the part's
    first token. Items without tokens keep a row, in the first container of their group. A
    container is (capacity_id, group, bin). Repeated items are packed each. There is a group per
    ``group_items`` items; ``total``, a frame of one row and one number, saves counting items that are
    costly to compute.
    """
    sizes = capacities.filter("capacity_id IS NOT NULL AND capacity >= 1").select("capacity_id", F.col("capacity").cast("int").alias("capacity")).distinct().limit(largest_capacities + 1).collect()
    if len(sizes) > largest_capacities:
        raise ValueError(f"more than {largest_capacities} capacities")
    rows = items.select("id", F.coalesce(F.col("tokens").cast("bigint"), F.lit(0)).alias("size"))
    if not sizes:
        return rows.limit(0).selectExpr("0 AS capacity_id", "0 AS `group`", "0 AS bin", "id", "0 AS part", "0L AS start", "0L AS tokens")
    counted = (rows.agg(F.count(F.lit(1))) if total is None else total).toDF("_total")
    equal = rows.groupBy("id", "size").agg(F.count(F.lit(1)).alias("_copies"))
    rows = equal.select("id", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")).join(F.broadcast(counted))
    groups = F.greatest(F.lit(1), F.ceil(F.col("_total") / group_items))
    offered = F.explode(F.array(*[F.struct(F.lit(r["capacity_id"]).alias("capacity_id"), F.lit(r["capacity"]).alias("capacity")) for r in sizes]))
    rows = rows.withColumn("_c", offered).select("id", "size", "_copy", groups.alias("_groups"), "_c.capacity_id", "_c.capacity")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.col("capacity").cast("bigint"))
    parts = rows.select("id", "size", "_copy", "_groups", "capacity_id", "capacity", F.posexplode(starts).alias("part", "start"))
    parts = parts.withColumn("tokens", F.least(F.col("size") - F.col("start"), F.col("capacity").cast("bigint")))
    parts = parts.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "id", "size", "part", "_copy"), F.col("_groups")).cast("int")).drop("_groups")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "id", "part", "_copy"], ascending=[False, True, True, True], ignore_index=True)
        group["bin"] = first_fit_decreasing(group["tokens"].tolist(), int(group["capacity"].iloc[0]))
        return group[["capacity_id", "group", "bin", "id", "part", "start", "tokens"]]

    kinds = dict(parts.dtypes)
    return parts.groupBy("capacity_id", "group").applyInPandas(fill, f"capacity_id {kinds['capacity_id']}, `group` int, bin int, id {kinds['id']}, part int, start bigint, tokens bigint")
