"""Counts over event-time windows of a stream; late rows are waited for, then dropped from the state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch


def windowed_counts(events: DataFrame, keys: list[str], value: str, width: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """window_start and `keys` with n and total; in append mode a window comes out once the watermark has passed its end."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = timed.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *keys, "n", "total")


def run_once(stream: DataFrame) -> DataFrame:
    """Work through all that the stream's source has now, into Parquet in the shared folder, and read it back."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
