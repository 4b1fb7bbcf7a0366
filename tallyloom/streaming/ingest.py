"""Streams: records from JSON lines and windowed counts of events. An extension; the batch operators are reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "line_key LONG, bucket STRING, file_name STRING, line_no LONG, body STRING, read_at TIMESTAMP"
EVENT = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def stream(spark: SparkSession, folder: str, schema: str, pattern: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def usable_lines(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Lines that hold an object with an id, each id once within the watermark; late repeats are dropped with it."""
    parsed = lines.withColumn("id", F.get_json_object("body", "$.id")).where("id is not null and read_at is not null")
    return parsed.withWatermark("read_at", delay).dropDuplicatesWithinWatermark(["id"]).select("line_key", "id", "read_at")


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their values by window and kind; state is dropped behind the watermark."""
    agg = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, delay: str = "10 minutes", gap: str = "2 hours") -> DataFrame:
    """Sessions of users, ended by a gap."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def run_to_end(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return the rows, which go to files in a folder and never to the driver.

    ``append`` adds rows that are final; ``complete`` writes the whole table of an aggregation anew in every batch.
    """
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", folder).start()
    else:
        q = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(folder)).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder)
