"""Incremental ingest, an extension: rows that arrive in files are taken once, and counts kept as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once(rows: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is dropped when it has passed."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def coverage_by_day(rows: DataFrame, time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """``keys, day, n_rows`` once the watermark has passed the day."""
    return rows.withWatermark(time, late).groupBy(*keys, F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n_rows")).select(*keys, F.col("w.start").alias("day"), "n_rows")


def append_to(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there as Parquet and stops; a later call goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
