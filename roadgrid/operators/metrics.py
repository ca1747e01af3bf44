"""Run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import scaling as S


def count_status(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def status_counts(results: DataFrame) -> DataFrame:
    """Rows by status, 0 for statuses of the domain that don't occur; other statuses are added."""
    spark = results.sparkSession
    domain = spark.createDataFrame([(s,) for s in C.STATUSES], "status string")
    counts = results.groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(counts, "status", "full").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def plate_counts(results: DataFrame) -> DataFrame:
    """Images with a box and without; those that can't be read count as without."""
    with_plate = F.count_if("plate_detected")
    return results.agg(with_plate.alias("with_plate"), (F.count("*") - with_plate).alias("without_plate"))


def run_metrics(results: DataFrame, elapsed: Column | None = None, *by: str) -> DataFrame:
    """One row a run: counts, stage sums and times as measured, not rounded.

    elapsed: the run's wall clock as an aggregate; the images' times added up if
    it isn't given. Empty runs have times of 0.
    """
    n = F.count("*")
    elapsed = F.coalesce(F.sum("total_time_s") if elapsed is None else elapsed, F.lit(0.0))
    with_plate = F.count_if("plate_detected")
    return results.groupBy(*by).agg(
        n.alias("total_images"),
        elapsed.alias("total_processing_time_s"),
        F.coalesce(F.sum("yolo_time_s"), F.lit(0.0)).alias("yolo_stage_time_s"),
        F.coalesce(F.sum("ocr_time_s"), F.lit(0.0)).alias("ocr_stage_time_s"),
        F.when(n > 0, elapsed / n).otherwise(0.0).alias("avg_time_per_image_s"),
        F.coalesce(F.min("total_time_s"), F.lit(0.0)).alias("min_time_per_image_s"),
        F.coalesce(F.max("total_time_s"), F.lit(0.0)).alias("max_time_per_image_s"),
        F.when(elapsed > 0, n / elapsed).otherwise(0.0).alias("throughput_img_per_s"),
        with_plate.alias("images_with_plate"),
        (n - with_plate).alias("images_without_plate"),
        count_status(C.OK).alias("ok_count"),
        count_status(C.STOLEN).alias("roubado_count"),
        count_status(C.UNIDENTIFIED).alias("nao_identificada_count"),
        count_status(C.ERROR).alias("error_count"),
    )


def run_log_row(metrics: DataFrame, timestamp: str, version: str, execution: str, requested: int, effective: int, warmup: float) -> DataFrame:
    """A row of the run log: metrics rounded to 4 places, in the log's column order."""
    times = [f.name for f in C.RUN_SCHEMA if f.dataType.typeName() == "double"]
    row = metrics.withColumns(
        {
            "timestamp": F.lit(timestamp), "version": F.lit(version), "execution_type": F.lit(execution),
            "workers_solicitados": F.lit(requested), "workers_efetivos": F.lit(effective), "warmup_time_s": F.lit(float(warmup)),
        }
    )
    row = row.withColumns({t: F.round(t, 4) for t in times})
    return row.select(*[F.col(f.name).cast(f.dataType) for f in C.RUN_SCHEMA])


def append_runs(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows)


def stage_share(metrics: DataFrame) -> DataFrame:
    """Percentages of detection and recognition; runs without time have none."""
    whole = F.col("yolo_stage_time_s") + F.col("ocr_stage_time_s")
    return metrics.withColumns({"yolo_percent": S.rounded_percent(F.col("yolo_stage_time_s"), whole), "ocr_percent": S.rounded_percent(F.col("ocr_stage_time_s"), whole)})


def speedups(runs: DataFrame) -> DataFrame:
    """runs(threads, seconds) with speedup against the first, efficiency and band. Few rows: one a configuration."""
    base = F.first_value("seconds").over(Window.orderBy("threads").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = runs.withColumn("speedup", S.speedup(base, F.col("seconds")))
    out = out.withColumn("efficiency", S.efficiency(F.col("speedup"), F.col("threads")))
    return out.withColumn("band", S.efficiency_band(F.col("efficiency")))
