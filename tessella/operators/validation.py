"""Checks of chunks and vectors: one row per violated rule, with the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V


def _counted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_rows) of all rules in one pass, zeros included."""
    counts = rows.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{i}").alias("n_rows")) for i, name in enumerate(rules)])
    return counts.select(F.explode(pairs).alias("_r")).select("_r.rule", "_r.n_rows")


def chunk_violations(chunks: DataFrame, required: list[str]) -> DataFrame:
    """(rule, n_rows): missing fields, empty texts, negative indexes (in chunks), repeated ids, broken sequences (in groups)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string"), F.lit(" \t\r\n")) == "")
    rules = {f"missing_{c}": F.col(c).isNull() for c in required} | {"empty_text": blank("text"), "negative_index": F.col("chunk_index") < 0}
    ids = chunks.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    runs = chunks.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.min("chunk_index").alias("_low"), F.max("chunk_index").alias("_high"), F.count(F.lit(1)).alias("_n"), F.count_distinct("chunk_index").alias("_d"))
    sequence = (F.col("_low") == 0) & (F.col("_high") + 1 == F.col("_n")) & (F.col("_d") == F.col("_n"))
    return _counted(chunks, rules).unionByName(_counted(ids, {"repeated_id": F.col("_n") > 1})).unionByName(_counted(runs, {"broken_sequence": ~F.coalesce(sequence, F.lit(False))}))


def vector_violations(vectors: DataFrame, key: str, column: str, dim: int, tolerance: float = 1e-3) -> DataFrame:
    """(rule, n_rows): null vectors, wrong lengths, NaN and infinite numbers, lengths other than 1, repeated ids."""
    v = F.col(column)
    off = F.abs(V.norm(v) - 1.0) > tolerance
    rules = {"null_vector": v.isNull(), "wrong_length": F.size(v) != dim, "nan": V.has_nan(v), "infinite": V.has_infinite(v), "not_unit": (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()) & off}
    ids = vectors.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return _counted(vectors, rules).unionByName(_counted(ids, {"repeated_id": F.col("_n") > 1}))
