"""Lookups, result rows, foreign keys, nested children and as-of joins over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ["source", "record_id", "dataset", "category", "score", "retrieval_method", "content", "metadata"]


def as_text(column: str) -> Column:
    return F.col(column).cast("string")


def exact_filter(rows: DataFrame, column: str, value: object, key: str, limit: int | None = None) -> DataFrame:
    """Rows whose column equals ``value``, compared as text; the first ``limit`` by key (None: all)."""
    found = rows.filter(as_text(column) == F.lit(str(value)))
    return found if limit is None else found.orderBy(key).limit(limit)


def exact_lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """At most one row: the one with the key, compared as text."""
    return exact_filter(rows, key, value, key, 1)


def filtered_count(rows: DataFrame, column: str, value: object) -> DataFrame:
    """(n): the rows ``exact_filter`` would give, counted where they are."""
    return exact_filter(rows, column, value, column).agg(F.count(F.lit(1)).alias("n"))


def content_text(table: str, columns: Sequence[str]) -> Column:
    """``table record: a=1, b=2`` in the order given, without null values."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), as_text(c))) for c in columns]
    return F.concat(F.lit(f"{table} record: "), F.concat_ws(", ", *parts))


def common_result(rows: DataFrame, table: str, key: str, category: Column | str, method: str, columns: Sequence[str], source: str = "structured", score: Column | None = None) -> DataFrame:
    """Rows in the common result schema; ``metadata`` is the columns as JSON, null ones left out."""
    return rows.select(
        F.lit(source).alias("source"), as_text(key).alias("record_id"), F.lit(table).alias("dataset"), (F.lit(category) if isinstance(category, str) else category).alias("category"),
        (F.lit(1.0) if score is None else score).cast("double").alias("score"), F.lit(method).alias("retrieval_method"), content_text(table, columns).alias("content"), F.to_json(F.struct(*columns)).alias("metadata"),
    )


def candidate_result(rows: DataFrame, dataset: str, method: str, scores: Sequence[str], required: Sequence[str]) -> DataFrame:
    """External candidates in the common schema: the first non-null of ``scores`` counts, the columns left over become metadata.

    A row without a score or with a null among ``required`` fails the query.
    """
    score = F.coalesce(*[F.col(c).cast("double") for c in scores])
    complete = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    rest = [c for c in rows.columns if c not in {*scores, *required, "text", "category"}]
    checked = F.when((F.size(complete) == 0) & score.isNotNull(), score).otherwise(F.raise_error(F.concat(F.lit("candidate lacks "), F.concat_ws(",", complete, F.when(score.isNull(), F.lit("score"))))).cast("double"))
    return rows.select(
        F.lit("unstructured").alias("source"), as_text(required[0]).alias("record_id"), F.lit(dataset).alias("dataset"), F.col("category"), checked.alias("score"),
        F.lit(method).alias("retrieval_method"), F.col("text").alias("content"), F.to_json(F.struct(*rest)).alias("metadata"),
    )


def foreign_key_report(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """(reference, n_rows, n_null, n_resolved, n_dangling, rate) of one foreign key; null and empty count as null, no references as rate 1."""
    keys = parent.select(as_text(key).alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("_there", F.lit(True))
    ref = F.nullif(F.trim(as_text(column)), F.lit(""))
    rows = child.select(ref.alias("_ref")).groupBy("_ref").agg(F.count(F.lit(1)).alias("_n"))  # a hot parent key is one row
    joined = rows.join(keys, F.col("_ref") == F.col("_key"), "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    null, there = F.col("_ref").isNull(), F.col("_there").isNotNull()
    stats = joined.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), count(null).alias("n_null"), count(~null & there).alias("n_resolved"), count(~null & ~there).alias("n_dangling"))
    named = F.col("n_resolved") + F.col("n_dangling")
    return stats.select(F.lit(name).alias("reference"), "*", F.when(named == 0, 1.0).otherwise(F.round(F.col("n_resolved") / named, 6)).alias("rate"))


def histogram_text(key: str, count: str) -> Column:
    """``a=1,b=2`` over the rows of a group, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(count).alias("n")))), lambda x: F.concat_ws("=", x["k"], x["n"])), ",")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, slice_seconds: int = 86400) -> DataFrame:
    """``left`` plus ``<value>`` of the latest ``right`` row of the same ``by`` at or before each time.

    One union and one window per (key, slice of time) instead of a range join; what earlier slices
    leave behind is one row per slice, so a key that holds a third of all rows still spreads over
    its slices. Of right rows at the same time the largest value counts. Left rows without a match
    keep a null; rows with a null key or time match nothing. ``value`` may be a column of ``left``
    too: the result then is called ``asof_<value>``.
    """
    taken = f"asof_{value}" if value in left.columns else value
    slice_ = F.floor(F.unix_seconds(F.col("_at").cast("timestamp")) / slice_seconds)
    left_rows = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.col(by).alias("_by"), F.col(left_time).alias("_at"), F.lit(1).alias("_side")).withColumn("_slice", slice_)
    known = left_rows.filter("_by IS NOT NULL AND _at IS NOT NULL")
    right_rows = right.filter(F.col(by).isNotNull() & F.col(right_time).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(right_time).alias("_at")).agg(F.max(value).alias("_value")).withColumn("_slice", slice_)
    ends = right_rows.groupBy("_by", "_slice").agg(F.max_by("_value", "_at").alias("_end")).unionByName(known.select("_by", "_slice").distinct(), allowMissingColumns=True).groupBy("_by", "_slice").agg(F.max("_end").alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("_by").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_by", "_slice", before.alias("_carried"))
    both = known.unionByName(right_rows.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    latest = F.last("_value", ignorenulls=True).over(Window.partitionBy("_by", "_slice").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    matched = both.withColumn("_latest", latest).filter("_side = 1").join(carried, ["_by", "_slice"])
    out = matched.select("_row.*", F.coalesce("_latest", "_carried").alias(taken))
    rest = left_rows.filter("_by IS NULL OR _at IS NULL").select("_row.*", F.lit(None).cast(dict(right.dtypes)[value]).alias(taken))
    return out.unionByName(rest)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high, by buckets of ``width`` so that it is an equi-join; clashing names get a ``range_`` prefix."""
    clash = {c: f"range_{c}" for c in ranges.columns if c in points.columns}
    renamed = ranges.withColumnsRenamed(clash)
    lo, hi = F.col(clash.get(low, low)), F.col(clash.get(high, high))
    bucket = lambda c: F.floor(c / width)
    spread = renamed.filter(lo < hi).withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return points.withColumn("_bucket", bucket(F.col(point))).join(spread, "_bucket").filter((F.col(point) >= lo) & (F.col(point) < hi)).drop("_bucket")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks: what a resumed job still has to do."""
    return left.join(right.select(F.col(key).alias("_done")).distinct(), F.col(key) == F.col("_done"), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key over both: the one with the highest version, ``new`` before ``old``. Null keys are left out."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True).filter(F.col(key).isNotNull())
    first = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc(), F.xxhash64(*[c for c in both.columns if c != "_new"]))
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_new")
