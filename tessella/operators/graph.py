"""Property graphs as two frames: nodes (id, label, key) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import ensure_checkpoint_dir


def row_nodes(rows: DataFrame, label: str, key: str) -> DataFrame:
    """(id, label, key) of each non-null key, once."""
    k = F.col(key).cast("string")
    return rows.select(F.concat(F.lit(f"{label}::"), k).alias("id"), F.lit(label).alias("label"), k.alias("key")).filter("key IS NOT NULL").distinct()


def reference_edges(rows: DataFrame, label: str, key: str, column: str, parent: str, kind: str) -> DataFrame:
    """(src, dst, type, source_field) from each row to the parent it names, once; null references give none."""
    named = rows.filter(F.col(key).isNotNull() & F.col(column).isNotNull())
    return named.select(F.concat(F.lit(f"{label}::"), F.col(key).cast("string")).alias("src"), F.concat(F.lit(f"{parent}::"), F.col(column).cast("string")).alias("dst"), F.lit(kind).alias("type"), F.lit(column).alias("source_field")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node; ``missing`` names the end."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    ends = edges.select("*", F.explode(F.array(F.struct(F.lit("src").alias("missing"), F.col("src").alias("_end")), F.struct(F.lit("dst").alias("missing"), F.col("dst").alias("_end")))).alias("_e")).select("*", "_e.missing", "_e._end").drop("_e")
    return ends.join(ids, F.col("_end") == F.col("_id"), "left_anti").drop("_end")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, n_types): edges at each node, in and out, and their distinct types."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "type")
    by_type = ends.groupBy("id", "type").agg(F.count(F.lit(1)).alias("_n"))
    return by_type.groupBy("id").agg(F.sum("_n").alias("degree"), F.count(F.lit(1)).alias("n_types"))


def children_counts(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(dst, type, n_children) of each parent."""
    rows = edges if kind is None else edges.filter(F.col("type") == kind)
    return rows.groupBy("dst", "type").agg(F.count_distinct("src").alias("n_children"))


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``keep`` (id)."""
    a, b = (keep.select(F.col("id").alias(c)).distinct() for c in ("_a", "_b"))
    return edges.join(a, F.col("src") == F.col("_a"), "left_semi").join(b, F.col("dst") == F.col("_b"), "left_semi")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id each node is connected to, edges taken both ways.

    Large-star and small-star rounds (Kiveris et al.): each round links every node's neighbours to
    the smallest of them, so chains shrink by a constant factor and no edge is repeated; the edge
    set is checkpointed between rounds, which cuts the lineage and survives lost executors. Ids of
    isolated nodes are their own component. Raises if ``most_rounds`` do not settle it.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("_p")).select("_p.*")
        around = both if large else both.filter("v < u")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else around.groupBy("u").agg(F.min("v").alias("m"))
        linked = around.join(least, "u")
        if large:
            return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = least.select("u", F.col("m").alias("v"))
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(own).distinct()

    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct().checkpoint()
    seen = None
    for _ in range(most_rounds):
        pairs = star(star(pairs, True), False).checkpoint()
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("id").distinct().join(pairs, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def hops(edges: DataFrame, start: DataFrame, most: int = 8) -> DataFrame:
    """(id, hops): fewest edges from any of ``start`` (id), edges taken both ways, up to ``most``.

    One join per hop from the frontier; the set of reached nodes is checkpointed each time.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = start.select("id").distinct().withColumn("hops", F.lit(0)).checkpoint()
    for step in range(1, most + 1):
        frontier = reached.filter(F.col("hops") == step - 1).select(F.col("id").alias("src"))
        new = frontier.join(both, "src").select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti").withColumn("hops", F.lit(step))
        grown = reached.unionByName(new).checkpoint()
        if grown.filter(F.col("hops") == step).isEmpty():
            break
        reached = grown
    return reached


def co_occurrence(mentions: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(item_a, item_b, support): groups in which two items occur together, a < b.

    Meant for a dictionary of items (a bounded number per group): the pairs of one group's items
    are built from its item set, not by a self-join.
    """
    sets = mentions.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    pairs = F.flatten(F.transform("_items", lambda a: F.transform(F.filter("_items", lambda b: b > a), lambda b: F.struct(a.alias("item_a"), b.alias("item_b")))))
    return sets.select(F.explode(pairs).alias("_p")).groupBy("_p.item_a", "_p.item_b").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
