"""Registered queries: streaming aggregates over the events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.register import register
from tessella.streaming import windows as W

QUERIES, query = register()


def _stream(spark: SparkSession, base: str) -> DataFrame:
    schema = spark.read.parquet(f"{base}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(base))


def _folder(base: str) -> str:
    """A stream reads folders; a table that is one file is named by a pattern."""
    return f"{base}/events.parque[t]"


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark: SparkSession, base: str) -> DataFrame:
    return W.run_to_end(spark, W.tumbling(_stream(spark, base), "1 day"))


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) s FROM events) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, base: str) -> DataFrame:
    return W.run_to_end(spark, W.sliding(_stream(spark, base), "1 day", "12 hours"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) i FROM m)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) n FROM g GROUP BY user_id, i""")
def stream_sessions(spark: SparkSession, base: str) -> DataFrame:
    return W.run_to_end(spark, W.sessions(_stream(spark, base), "6 hours"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) total FROM events GROUP BY 1, 2""")
def stream_batch_twin(spark: SparkSession, base: str) -> DataFrame:
    """The tumbling aggregate over the table: the same function, no stream."""
    return W.tumbling(spark.read.parquet(f"{base}/events.parquet"), "1 day")


_MARK_SQL = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) total FROM events
    GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK_SQL}""")
def stream_closed_days(spark: SparkSession, base: str) -> DataFrame:
    """Append mode: each day once, when the watermark has passed it; its state is dropped then."""
    return W.run_to_end(spark, W.tumbling(_stream(spark, base), "1 day"), "append")


@query(f"""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) i FROM m)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) n FROM g GROUP BY user_id, i HAVING max(ts) + INTERVAL 6 HOUR <= {_MARK_SQL}""")
def stream_closed_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Append mode: each session once it can grow no more."""
    return W.run_to_end(spark, W.sessions(_stream(spark, base), "6 hours"), "append")
