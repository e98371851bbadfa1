"""Road-closure events as a stream: an extension, not part of the batch analysis.

Works on a static table too, where the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by window and type: n and mean value; events later than the watermark are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "mean")
    )


def run_available(spark, folder: str, checkpoint: str, out: str, schema) -> None:
    """Read what is in a folder of Parquet files as a stream, and append finished windows to ``out``."""
    stream = spark.readStream.schema(schema).parquet(folder)
    closure_counts(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
