"""Retrieval metrics. ``ranked``: query_id, document_id, rank; ``relevant``: query_id, document_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked documents with ``relevant`` and the number of relevant ones of their query.

    Every query of ``relevant`` has a row, with a null document if nothing was ranked for it.
    """
    pairs = relevant.select("query_id", "document_id").distinct()
    totals = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    once = ranked.groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"))
    marked = once.join(pairs.withColumn("_hit", F.lit(True)), ["query_id", "document_id"], "left")
    return totals.join(marked, "query_id", "left").withColumn("relevant", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _within(k: int) -> Column:
    return F.col("rank").isNotNull() & (F.col("rank") <= k)


def query_scores(rows: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10), mrr_cut: int | None = None) -> DataFrame:
    """Per query: hit, recall, precision over k and over what is there, at each cut, and the reciprocal rank.

    Queries with nothing found score 0, also in ``precision_found`` whose denominator is then 0.
    """
    hit = F.col("relevant")
    out = []
    for k in cuts:
        found, there = F.sum(F.when(hit & _within(k), 1).otherwise(0)), F.sum(F.when(_within(k), 1).otherwise(0))
        out += [
            F.max(F.when(hit & _within(k), 1.0).otherwise(0.0)).alias(f"hit_{k}"), (found / F.first("n_relevant")).alias(f"recall_{k}"),
            (found / F.lit(float(k))).alias(f"precision_{k}"), F.when(there == 0, 0.0).otherwise(found / F.nullif(there, F.lit(0))).alias(f"precision_found_{k}"),
        ]
    first = F.min(F.when(hit & (_within(mrr_cut) if mrr_cut else F.lit(True)), F.col("rank")))
    return rows.groupBy("query_id").agg(*out, F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


def mean_scores(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Means over all queries and their number; zeros where there is none. A mean above 1 fails the query."""
    names = [c for c in scores.columns if c != "query_id"]
    mean = lambda c: F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))
    means = scores.agg(F.count(F.lit(1)).alias("n_queries"), *[mean(c).alias(c) for c in names])
    checked = [F.when(F.col(c) <= 1, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} above 1")).cast("double")).alias(c) for c in names]
    return means.select("n_queries", *checked)


def precision_recall(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two flags; 0 where a denominator is 0."""
    counts = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / F.nullif(b, F.lit(0)), 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion(rows: DataFrame, expected: str, got: str, labels: list[str]) -> DataFrame:
    """Counts of each expected label by what was given; labels never given are 0."""
    return rows.groupBy(expected).agg(*[F.count_if(F.col(got) == label).alias(label) for label in labels])
