"""Event streams: windowed sums with watermarks, and the running state of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of event files; ts becomes an instant (UTC) for watermarks."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and their values by type and time window; events later than the watermark are dropped from a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    sums = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "peak")


def running_peaks(events: DataFrame) -> DataFrame:
    """Count, peak and total of each user so far, emitted whenever they change (update mode); the state is three numbers a user."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.sum("value").alias("total"))


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now and returns its in-memory table; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def drain_to(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet table of its last state, which is read back; nothing passes through
    the driver."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
