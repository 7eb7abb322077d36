"""Eight-day composites of a stream: an extension, with the batch query's windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def composite(events: DataFrame, time: str, value: str, *keys: str, days: int = 8, start: str = "0 days", late: str = "8 days") -> DataFrame:
    """keys, end_date, n, mean: tumbling windows named by their exclusive end; events later than ``late`` are dropped by the watermark."""
    at = F.col(time).cast("timestamp")
    df = events.withColumn("_at", at).withWatermark("_at", late)
    by = df.groupBy(*keys, F.window("_at", f"{days} days", startTime=start)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return by.select(*keys, F.col("window.end").cast("date").alias("end_date"), "n", "mean")


def composite_files(spark: SparkSession, events: str, schema: StructType, out: str, state: str, time: str, value: str, *keys: str, **windows) -> None:
    """Takes the files that came into ``events`` since the last run and appends the composites that are complete to ``out``.

    Where it stopped, and the open windows, are in ``state``: a run that fails is repeated there, and a later one goes on.
    """
    stream = spark.readStream.schema(schema).parquet(events)
    made = composite(stream, time, value, *keys, **windows).writeStream.format("parquet").outputMode("append")
    made.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
