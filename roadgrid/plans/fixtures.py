"""The driver's tables in the shape of this engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.operators import match

WIDTH, HEIGHT = 640, 480
SUFFIXES = (".JPG", ".jpeg", ".png", ".bmp", ".webp", ".txt", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, d: str) -> DataFrame:
    """page_id, path: image names with every kind of suffix."""
    ends = F.array(*[F.lit(s) for s in SUFFIXES])
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("img_"), F.col("page_id").cast("string"), F.element_at(ends, (F.col("page_id") % 7 + 1).cast("int"))).alias("image"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """token: every word of the documents, as raw recognised text."""
    return table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("token"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """id, raw: plate readings."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("raw"))


def watchlist_raw(spark: SparkSession, d: str) -> DataFrame:
    """value: lines that match after normalising (even ids) and lines that never do."""
    part = table(spark, d, "part").where("p_partkey % 97 = 0")
    size = F.col("p_size").cast("string")
    spaced = F.concat(F.lit("  "), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(" - "), size)
    return part.select(F.when(F.col("p_partkey") % 2 == 0, spaced).otherwise(F.concat("p_brand", F.lit("-"), size)).alias("value"))


def watchlist(spark: SparkSession, d: str) -> DataFrame:
    return match.watchlist(watchlist_raw(spark, d))


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """id, char_probs."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * 2).alias("char_probs"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """image, pos, conf, w, h, x1, y1, x2, y2."""
    order = Window.partitionBy("image").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # by the name itself, so that grouping by it needs no second shuffle
    x1, y1 = F.col("l_partkey") % 700 - F.lit(30.5), F.col("l_partkey") % 500 - F.lit(10.5)
    return table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "image").select(
        "image",
        F.row_number().over(order).alias("pos"),
        F.col("l_discount").alias("conf"),
        F.lit(WIDTH).alias("w"),
        F.lit(HEIGHT).alias("h"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 3 * F.col("l_quantity") - 6).alias("x2"),
        (y1 + F.col("l_suppkey") % 40 - 2).alias("y2"),
    )


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as both models return them: every fifth image without a box, every eleventh reading failed."""
    number, seen = F.col("id"), F.col("id") % 5 != 0
    image = F.concat(F.lit("img_"), number.cast("string"), F.lit(".jpg"))
    return readings(spark, d).select(
        F.concat(F.lit("in/"), image).alias("path"),
        image.alias("image"),
        seen.alias("plate_detected"),
        (number / 8).alias("yolo_time_s"),
        (number % 4).cast("long").alias("worker_id"),
        F.lit("").alias("error"),
        F.when(seen, F.col("raw")).alias("plate"),
        F.when(seen, F.array(number % 10 / 8)).alias("char_probs"),
        (seen & (number % 11 == 0)).alias("failed"),
        F.when(seen, F.lit(b"\0")).alias("crop"),
        F.lit(None).cast("binary").alias("preprocessed"),
        F.when(seen, number / 16).alias("ocr_time_s"),
    )


def images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image"))


def results(spark: SparkSession, d: str) -> DataFrame:
    """run and result columns with times."""
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("ts").cast("date").alias("run"),
        F.col("event_id"),
        (F.col("value") / 100).alias("total_time_s"),
        (F.col("value") / 100 * F.lit(0.68)).alias("yolo_time_s"),
        (F.col("value") / 100 * F.lit(0.32)).alias("ocr_time_s"),
        (kind != "error").alias("plate_detected"),
        F.when(kind == "purchase", C.STOLEN).when(kind == "error", C.UNIDENTIFIED).otherwise(C.OK).alias("status"),
    )


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """image, i, value: 0 to 255."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "x"))
    level = (F.col("x").cast("double") + 1) * 127.5
    return rows.select("image", "i", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), level))).cast("int").alias("value"))
