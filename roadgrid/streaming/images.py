"""New image files as a stream, in micro-batches of the detector's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import text as X
from roadgrid.operators import match
from roadgrid.sources.images import FILES, GLOB


def stream(spark: SparkSession, folder: str, batch: int = C.DETECTOR_BATCH) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", batch).load(folder)
    return files.withColumn("image", X.basename(F.col("path"))).where(X.is_image(F.col("image")))


def status_stream(readings: DataFrame, plates: DataFrame) -> DataFrame:
    """A stream of readings with status, against a static watchlist."""
    return match.assign_status(readings, plates)


def windowed_counts(results: DataFrame, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by status and window of a stream of results."""
    return results.withWatermark(ts, late).groupBy(F.window(ts, width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")
