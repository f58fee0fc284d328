"""Windowed aggregates over event streams, and their batch twins.

The same function aggregates a stream and a table. Append mode writes a window once, when the
watermark has passed its end, and forgets its state; ``closed`` keeps the same windows of the batch
twin. Complete mode keeps all windows for ever: for small results only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.sinks import scratch


def stamped(events: DataFrame) -> DataFrame:
    """Event time as an instant: watermarks refuse timestamps without zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per window of ``size``. Rows with a null time are in none."""
    rows = stamped(events).filter("ts IS NOT NULL").withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, size: str, step: str, late: str = "1 day") -> DataFrame:
    """(start, event_type, n) per window of ``size`` every ``step``."""
    rows = stamped(events).filter("ts IS NOT NULL").withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(user_id, start, stop, n) of each run of events less than ``gap`` apart; stop is the last event plus the gap."""
    rows = stamped(events).filter("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", day("session_window.start").alias("start"), day("session_window.end").alias("stop"), "n")


def without_repeats(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return stamped(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def closed(windows: DataFrame, events: DataFrame, stop: str, late: str = "1 day") -> DataFrame:
    """Those of a batch twin's ``windows`` that a stream in append mode has written: their end (``stop``, text) is not past the watermark."""
    mark = stamped(events).agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("_mark"))
    return windows.join(F.broadcast(mark)).filter(F.to_timestamp(stop) <= F.col("_mark")).drop("_mark")


def run_to_end(spark: SparkSession, result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming result over all that is there and read what it wrote.

    Each batch replaces (complete) or extends (append) a table in the shared checkpoint folder.
    """
    place = scratch(spark, "stream")

    empty = spark.createDataFrame([], result.schema)
    empty.write.parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{place}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep)
    writer.start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{place}/out").select(result.columns)
