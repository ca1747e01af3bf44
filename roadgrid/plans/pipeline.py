"""The plate pipeline: decoded images to results, as one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid.functions import text as X
from roadgrid.operators import infer, match
from roadgrid.operators.recognise import read_plate
from roadgrid.sources.results import with_defaults

MODES = ("serial", "parallel")


def run(images: DataFrame, plates: DataFrame, detector: Callable, recogniser: Callable, mode: str = "parallel", workers: int = 0) -> DataFrame:
    """The result columns, crop and preprocessed (PNG bytes) of every image; path tells images apart.

    serial runs in one partition, parallel in workers partitions (0: as read).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    images = images.coalesce(1) if mode == "serial" else images.repartition(workers, "path") if workers else images
    # Each row goes through both models as it is: nothing is kept, read twice or joined again.
    return finished(infer.read(infer.with_best(infer.detect(images, detector)), recogniser), plates)


def finished(read: DataFrame, plates: DataFrame) -> DataFrame:
    """infer.read() rows with the reading, the paths of their pictures and the status."""
    seen = F.col("plate_detected")
    rows = read.withColumn("r", F.when(seen, read_plate(F.col("plate"), F.col("char_probs"), F.col("failed")))).withColumns(
        {
            "plate_text": F.coalesce("r.text", F.lit("")),
            "ocr_confidence": F.col("r.confidence"),
            "reject_reason": F.col("r.reason"),
            "total_time_s": F.col("yolo_time_s") + F.coalesce("ocr_time_s", F.lit(0.0)),
        }
    )
    rows = rows.drop("r", "plate", "char_probs", "failed")
    name = X.stem(F.col("image"))
    rows = rows.withColumns(
        {
            "crop_path": F.when(F.col("crop").isNotNull(), F.concat(F.lit("crops/"), name, F.lit("_"), F.md5("path"), F.lit("_crop.png"))),
            "preprocessed_path": F.when(F.col("preprocessed").isNotNull(), F.concat(F.lit("preprocessed/"), name, F.lit("_"), F.md5("path"), F.lit("_prep.png"))),
        }
    )
    return match.assign_status(rows, plates)


def results(rows: DataFrame) -> DataFrame:
    """The result columns alone."""
    return with_defaults(rows)
