"""Watchlist matching and the watchlist's set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import text as X


def watchlist(raw: DataFrame, column: str = "value") -> DataFrame:
    """plate: the raw lines' normalised plates, without blanks and repeats."""
    return raw.select(X.normalise_watch(F.col(column)).alias("plate")).where("plate <> ''").distinct()


def assign_status(readings: DataFrame, plates: DataFrame, column: str = "plate_text") -> DataFrame:
    """readings with status; each row stays. An existence join, which Spark broadcasts where the list is small.

    Where it isn't, unread images, which may be most, don't meet in one task: a
    key of their own, which no plate has, deals them out.
    """
    listed = plates.select(F.col("plate").alias("_plate")).distinct()
    unread = F.coalesce(F.col(column), F.lit("")) == ""
    dealt = F.concat(F.lit("\0"), (F.rand(1) * 4096).cast("int").cast("string"))
    keyed = readings.withColumn("_key", F.when(unread, dealt).otherwise(F.col(column)))
    hit = keyed.join(listed.withColumn("_hit", F.lit(True)), F.col("_key") == F.col("_plate"), "left")
    status = F.when(unread, C.UNIDENTIFIED).when(F.col("_hit"), C.STOLEN).otherwise(C.OK)
    return hit.withColumn("status", status).drop("_plate", "_hit", "_key")


def stolen_only(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == C.STOLEN)


def in_watchlist(readings: DataFrame, plates: DataFrame, column: str = "plate_text") -> DataFrame:
    return readings.join(plates.select(F.col("plate").alias(column)), column, "left_semi")


def add_plates(plates: DataFrame, new: DataFrame) -> DataFrame:
    return plates.select("plate").union(new.select("plate")).where("plate <> ''").distinct()


def new_plates(plates: DataFrame, new: DataFrame) -> DataFrame:
    """What add_plates would add."""
    return new.where("plate <> ''").select("plate").distinct().join(plates, "plate", "left_anti")


def remove_plates(plates: DataFrame, gone: DataFrame) -> DataFrame:
    return plates.select("plate").distinct().join(gone.select("plate"), "plate", "left_anti")


def removed_plates(plates: DataFrame, gone: DataFrame) -> DataFrame:
    """What remove_plates would remove."""
    return gone.select("plate").distinct().join(plates, "plate", "left_semi")


def clear(plates: DataFrame) -> DataFrame:
    return plates.where(F.lit(False))


def detected_plates(results: DataFrame) -> DataFrame:
    """plate: the different ones read with status OK or stolen."""
    plate = X.strip_upper(F.col("plate_text"))
    return results.where(F.col("status").isin(C.OK, C.STOLEN)).select(plate.alias("plate")).where("plate <> ''").distinct()


def sampled(plates: DataFrame, n: int, seed: str) -> DataFrame:
    """n different plates, the same for the same seed."""
    if n < 0:
        raise ValueError("a sample can't be negative")
    return plates.distinct().orderBy(F.md5(F.concat(F.col("plate"), F.lit(seed))), "plate").limit(n)


def blacklisted(text: Column) -> Column:
    return text.isin(*C.WORD_BLACKLIST)
