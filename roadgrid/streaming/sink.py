"""A sink for streams of results: every batch once in the results and once in the run log."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from roadgrid import config as C
from roadgrid.operators import metrics
from roadgrid.sources import files
from roadgrid.sources.results import read_csv, with_defaults

COMMIT_SCHEMA = T.StructType([*C.RUN_SCHEMA, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])


def _identity(spark: SparkSession, checkpoint: str) -> str:
    """What tells this checkpoint's batches from another's, which count from 0 too; made with the first batch."""
    files.make_dirs(spark, checkpoint)
    path = f"{checkpoint.rstrip('/')}/sink-id"
    files.claim(spark, path, uuid.uuid4().hex)
    return files.head(spark, path, 64).decode()


def _line(row: DataFrame) -> str:
    """A CSV file's text: the header and the one row of a run."""
    values = row.first().asDict()
    quoted = lambda v: "" if v is None else f'"{str(v).replace(chr(34), chr(34) * 2)}"'
    return ",".join(values) + "\n" + ",".join(quoted(v) for v in values.values()) + "\n"


def batch_writer(spark: SparkSession, folder: str, checkpoint: str, version: str = "1") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch(): folder/results gets the rows, folder/runs a line of the run log.

    Rows are written under a name of this attempt; the run-log file, which names
    the attempt, is what commits them. It appears at once and only once for a
    batch, so a batch that is replayed after it changes nothing, and what broken
    attempts have left is never read.
    """
    folder = folder.rstrip("/")
    files.make_dirs(spark, f"{folder}/results", f"{folder}/runs")
    own = _identity(spark, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        commit = f"{folder}/runs/{own}-{number:012}.csv"
        if files.exists(spark, commit):
            return
        attempt, begin = uuid.uuid4().hex, time.perf_counter()
        path = f"{folder}/results/attempt={attempt}"
        with_defaults(batch).write.parquet(path)
        rows = spark.read.schema(C.RESULT_SCHEMA).parquet(path)
        numbers = metrics.run_metrics(rows, F.lit(time.perf_counter() - begin))
        row = metrics.run_log_row(numbers, time.strftime("%Y-%m-%d %H:%M:%S"), version, "stream", 0, 0, 0.0)
        line = _line(row.withColumns({"batch": F.lit(number), "attempt": F.lit(attempt)}))
        if not files.claim(spark, commit, line):
            files.remove(spark, path)  # another run of this batch was faster

    return write


def write_results(results: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """The stream's writer into folder; call start() on it. Batches without rows are runs too."""
    spark = results.sparkSession
    return results.writeStream.foreachBatch(batch_writer(spark, folder, checkpoint)).option("checkpointLocation", checkpoint).outputMode("append")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The run log with each run's batch and attempt."""
    return read_csv(spark, f"{folder.rstrip('/')}/runs", COMMIT_SCHEMA)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The results of all committed batches, with the attempt that wrote them."""
    path = f"{folder.rstrip('/')}/results"
    schema = T.StructType([*C.RESULT_SCHEMA, T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(schema).parquet(path) if any(n.startswith("attempt=") for n in files.names(spark, path)) else spark.createDataFrame([], schema)
    return rows.join(F.broadcast(commits(spark, folder).select("attempt")), "attempt", "left_semi").select(*schema.names)
