"""Parquet table scans. Each reads only the columns the plan asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, CR and LF: what counts as whitespace in keys and lines.
BLANKS = " \t\r\n"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def latest_rows(df: DataFrame, key: str, version: str, keep: list[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the latest ``version`` (nulls oldest).

    An aggregate, not a window: copies of a hot key are combined before the shuffle.
    Ties on ``version`` are settled by the largest remaining values, so the result does
    not depend on row order. Columns: ``key``, ``version`` and ``keep``.
    """
    rest = [c for c in keep if c not in (key, version)]
    newest = F.max(F.struct(F.col(version).alias("_v"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(rest)]))
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key))
        .agg(newest.alias("_newest"))
        .select(key, F.col("_newest._v").alias(version), *[F.col(f"_newest._k{i}").alias(c) for i, c in enumerate(rest)])
    )
