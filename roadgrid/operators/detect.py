"""Detections: the best one of each image, and images without any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import geometry as G
from roadgrid.store import cut

_EDGES = ("x1", "y1", "x2", "y2")


def clamped(boxes: DataFrame) -> DataFrame:
    """Rows of image, pos, conf, w, h and x1 to y2, with the box in whole pixels inside the image."""
    b = G.clamp(G.box(*[F.col(e) for e in _EDGES]), F.col("w"), F.col("h"))
    return boxes.withColumn("_b", b).select("image", "pos", "conf", "w", "h", *[F.col(f"_b.{e}").alias(e) for e in _EDGES])


def with_area(boxes: DataFrame) -> DataFrame:
    return boxes.where(G.has_area(G.box(*[F.col(e) for e in _EDGES])))


def expanded(boxes: DataFrame, ratio: float = C.BOX_PADDING) -> DataFrame:
    b = G.expand(G.box(*[F.col(e) for e in _EDGES]), F.col("w"), F.col("h"), ratio)
    return boxes.withColumn("_b", b).select("image", "pos", "conf", "w", "h", *[F.col(f"_b.{e}").alias(e) for e in _EDGES])


def best(boxes: DataFrame, ratio: float = C.BOX_PADDING) -> DataFrame:
    """The best box of each image by one aggregation: a struct's maximum, combined before the shuffle."""
    usable = with_area(clamped(boxes)).where(~F.isnan("conf") & (F.col("conf") > -1.0))
    top = usable.groupBy("image").agg(F.max(F.struct("conf", (-F.col("pos")).alias("back"), "w", "h", *_EDGES)).alias("b"))
    rows = top.select("image", (-F.col("b.back")).alias("pos"), "b.conf", "b.w", "b.h", *[F.col(f"b.{e}").alias(e) for e in _EDGES])
    return expanded(rows, ratio)


def as_arrays(boxes: DataFrame) -> DataFrame:
    """image, w, h, boxes: the form in which a detector returns them, in order of pos."""
    item = F.struct("pos", "conf", *_EDGES)
    rows = boxes.groupBy("image", "w", "h").agg(F.sort_array(F.collect_list(item)).alias("boxes"))
    return rows.withColumn("boxes", F.transform("boxes", lambda b: F.struct(b["conf"].alias("conf"), *[b[e].alias(e) for e in _EDGES])))


def best_of_arrays(images: DataFrame, ratio: float = C.BOX_PADDING) -> DataFrame:
    """As best(), without a shuffle, where each image has its boxes in one array."""
    rows = images.select("image", "w", "h", F.explode(G.best_boxes(F.col("boxes"), F.col("w"), F.col("h"), ratio)).alias("_b"))
    return rows.select("image", F.col("_b.pos").alias("pos"), "_b.conf", "w", "h", *[F.col(f"_b.box.{e}").alias(e) for e in _EDGES])


def without_detection(images: DataFrame, found: DataFrame) -> DataFrame:
    return images.join(found.select("image"), "image", "left_anti")


def outer(images: DataFrame, found: DataFrame) -> DataFrame:
    """Every image with its detection or the defaults."""
    return images.join(found, "image", "left").withColumn("plate_detected", F.col("conf").isNotNull())


def batches(images: DataFrame, size: int = C.DETECTOR_BATCH, key: str = "image") -> DataFrame:
    """images with position (from 1, in order of key) and batch (from 0).

    Order over all images without one task for all: ranges are sorted apart and
    the counts of the ranges before are added. The ranges are written once, as
    both the ranks and the counts need the same ones.
    """
    spread = cut(images.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    inner = spread.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    counts = inner.groupBy("_p").agg(F.max("_k").alias("_n"))
    offsets = counts.withColumn("_o", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_o")
    placed = inner.join(F.broadcast(offsets), "_p").withColumn("position", (F.col("_o") + F.col("_k")).cast("long"))
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / size)).drop("_p", "_k", "_o")
