"""Streams, as an extension of the batch engine: late runs into stored tables, power samples into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattloom.sources.tables import store


def follow_measurements(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Wide rows that arrive as Parquet files replace their (design, build); a replayed batch changes nothing."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(lambda df, _: store(df, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def power_windows(samples: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Mean and peak per workload and window of samples (ts, event_type, value), late ones up to ``late``."""
    timed = samples.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), F.col("event_type").alias("workload")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_mw"), F.max("value").alias("peak_mw")).select("workload", F.col("window.start").alias("t_start"), "n", "mean_mw", "peak_mw")
