"""Weekly event counts, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def weekly(events: DataFrame) -> DataFrame:
    """week, event_type, n, total over tumbling weeks. ``ts`` becomes an instant: watermarks need one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", "1 day")
    found = timed.groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
    return found.select(F.col("w.start").cast("date").alias("week"), "event_type", "n", "total")


def stream(spark: SparkSession, folder: str, schema: str, name: str) -> StreamingQuery:
    """The same over files that arrive in a folder, complete in a memory table."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return weekly(rows).writeStream.outputMode("complete").format("memory").queryName(name).start()


def stream_upsert(rows: DataFrame, table, checkpoint: str) -> StreamingQuery:
    """Every micro-batch merged into a lake table: a batch that runs again changes nothing."""
    return rows.writeStream.foreachBatch(lambda batch, _: table.upsert(batch)).option("checkpointLocation", checkpoint).start()
