"""Registered queries: tables written by Spark in other formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.register import register
from tessella.schemas import TABLES
from tessella.sources import files, sinks
from tessella.sources.tables import table

QUERIES, query = register()


@query("""SELECT subscription_id, customer_id, msisdn, plan_id, strftime(activation_date, '%Y-%m-%d') activation, strftime(expiry_date, '%Y-%m-%d') expiry, status, renewal_type FROM subscriptions""")
def scan_s01_csv(spark: SparkSession, base: str) -> DataFrame:
    """Subscriptions as CSV, read as text and typed."""
    declared = TABLES["subscriptions"]
    place = sinks.scratch(spark, "csv")
    raw = table(spark, base, "subscriptions").select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if k == "d" else F.col(c).cast("string").alias(c) for c, k in declared.kinds.items()])
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(place)
    rows = files.read_csv_table(spark, place, declared, typed=True)
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return rows.select("subscription_id", "customer_id", "msisdn", "plan_id", day("activation_date", "activation"), day("expiry_date", "expiry"), "status", "renewal_type")


@query("SELECT doc_id, lang, coalesce(length(text), -1) n FROM documents")
def scan_s14_json_lines(spark: SparkSession, base: str) -> DataFrame:
    place = sinks.scratch(spark, "jsonl")
    sinks.write_once(table(spark, base, "documents").select("doc_id", "lang", "text"), place)
    rows = files.read_json_lines(spark, place, "doc_id bigint, lang string, text string")
    return rows.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(-1)).cast("bigint").alias("n"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) query_id, CAST(o_orderkey AS VARCHAR) document_id FROM orders WHERE o_orderstatus <> 'F'")
def scan_s16_judgements(spark: SparkSession, base: str) -> DataFrame:
    """Pairs with a score as a tab-separated file; those at 0 are left out."""
    place = sinks.scratch(spark, "tsv")
    score = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    table(spark, base, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("document_id"), score.alias("score")).write.option("header", True).option("sep", "\t").csv(place)
    return files.read_judgements(spark, place)


@query("""WITH d AS (SELECT DISTINCT document_type, document_id FROM canonical_documents WHERE document_type IS NOT NULL AND trim(document_type) <> '') SELECT document_type, count(*) n FROM d GROUP BY 1""")
def sink_k04_partitioned(spark: SparkSession, base: str) -> DataFrame:
    """A partitioned write, of which a later read takes only the folders it needs."""
    place = sinks.scratch(spark, "parts")
    rows = table(spark, base, "canonical_documents").filter("document_type IS NOT NULL AND trim(document_type) <> ''").select("document_type", "document_id").distinct()
    sinks.write_partitioned(rows.withColumn("part", F.col("document_type")), place, "part")
    return spark.read.schema("document_type string, document_id string, part string").parquet(place).groupBy("document_type").agg(F.count(F.lit(1)).alias("n"))
