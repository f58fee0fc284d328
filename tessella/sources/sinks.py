"""Writers. Each says what happens to what is already there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import remove, shared_folder


_SCRATCH = "tessella-scratch-"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name that all executors share, below ``spark.checkpoint.dir``; gone with ``clear_scratch``."""
    context = spark.sparkContext
    return f"{shared_folder(spark)}/{_SCRATCH}{context.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote to scratch folders; results read from them must be done with."""
    remove(spark, f"{shared_folder(spark)}/{_SCRATCH}{spark.sparkContext.applicationId}")


def replace_table(rows: DataFrame, path: str) -> None:
    """Parquet; what was there is replaced."""
    rows.write.mode("overwrite").parquet(path)


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Parquet by a column of few values; only the partitions that ``rows`` has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def reset_owned(spark: SparkSession, path: str, by: str, owned: list[str]) -> None:
    """Remove the partitions of the ``owned`` values of ``by``; those of others stay."""
    for value in owned:
        remove(spark, f"{path}/{by}={value}")


def write_once(rows: DataFrame, path: str) -> None:
    """JSON lines; raises if anything is there."""
    rows.write.mode("errorifexists").json(path)


def write_with_quarantine(rows: DataFrame, path: str, accepted: Column) -> tuple[str, str]:
    """Rows that pass below ``kept``, the others, nulls included, below ``rejected``; both folders."""
    passes = F.coalesce(accepted, F.lit(False))
    replace_table(rows.filter(passes), f"{path}/kept")
    replace_table(rows.filter(~passes), f"{path}/rejected")
    return f"{path}/kept", f"{path}/rejected"


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    """Nodes and edges below ``path`` as Parquet or JSON lines, null texts as empty ones."""
    for name, rows in (("nodes", nodes), ("edges", edges)):
        bare = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
        bare.write.mode("overwrite").format(form).save(f"{path}/{name}")


def write_vectors(vectors: DataFrame, metadata: DataFrame, path: str, key: str = "id", dim: int = 64) -> None:
    """Vectors with their metadata as one table, matched by ``key``, for exact search; raises if they do not fit.

    Every key must have one vector of ``dim`` finite numbers and one row of metadata. The checks
    are read from the table once written; a table that fails them is not left behind.
    """
    e = F.col("embedding")
    usable = F.coalesce((F.size(e) == dim) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    sides = vectors.withColumn("_vector", F.lit(1)).join(metadata.withColumn("_metadata", F.lit(1)), key, "full")
    replace_table(sides.withColumn("_usable", usable), f"{path}/unchecked")
    spark = vectors.sparkSession
    written = spark.read.parquet(f"{path}/unchecked")
    bad = written.agg(
        F.count_if(F.col("_vector").isNull() | F.col("_metadata").isNull()).alias("unmatched"), F.count_if(~F.col("_usable") & F.col("_vector").isNotNull()).alias("unusable"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated or missing keys"),
    ).first()
    wrong = {k: v for k, v in bad.asDict().items() if v}
    if not wrong:
        replace_table(written.drop("_vector", "_metadata", "_usable"), f"{path}/vectors")
    remove(spark, f"{path}/unchecked")
    if wrong:
        raise ValueError(f"vectors and metadata do not fit: {wrong}")
