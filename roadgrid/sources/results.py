"""Result and run-log tables as CSV, read by the names in each file's header."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgrid import config as C
from roadgrid.operators.match import detected_plates
from roadgrid.sources.files import exists, head, listed

#: As the csv module of Python writes and reads: quotes are doubled, line breaks may stand in quotes, spaces count.
DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Bytes of a file in which its header ends.
HEADER_BYTES = 1 << 16


def with_defaults(rows: DataFrame) -> DataFrame:
    """The columns of RESULT_SCHEMA in order; missing and null values get their defaults, other columns go."""
    have = set(rows.columns)
    cells = []
    for f in C.RESULT_SCHEMA:
        default = F.lit(C.RESULT_DEFAULTS.get(f.name)).cast(f.dataType)
        cells.append((F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in have else default).alias(f.name))
    return rows.select(*cells)


def save(results: DataFrame, path: str, order: str | list[str] | None = None, parts: int = 0) -> None:
    """Overwrites path with a header and the result columns; truth values as True and False, missing text as nothing.

    With order the parts (so many, 0: as Spark deals them) are sorted ranges:
    their names follow it, and one after the other they are the sorted table.
    """
    keys = [order] if isinstance(order, str) else order or []
    rows = results.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if parts and keys else results.orderBy(*keys) if keys else results
    cells = [(F.initcap(F.col(f.name).cast("string")) if f.dataType.typeName() == "boolean" else F.col(f.name)).alias(f.name) for f in C.RESULT_SCHEMA]
    rows.select(*cells).write.mode("overwrite").options(**DIALECT).option("header", True).option("emptyValue", "").csv(path)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files by their headers, of which one record each is read; files without one are left out."""
    found: dict = {}
    for file in listed(spark, path):
        text = head(spark, file, HEADER_BYTES).decode("utf-8-sig", "replace")
        names = next(csv.reader(io.StringIO(text, newline="")), None)
        if names:
            found.setdefault(tuple(names), []).append(file)
    return found


def _typed(cell: Column, kind: T.DataType) -> Column:
    text = F.when(cell != "", cell)
    return cell if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind)


def _records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of schema by their names in the header, wherever they stand, _file, _record and _bad.

    _bad says what is wrong with a record: cells that are missing or too many,
    or the columns whose text isn't of their kind, which are null.
    """
    parts = []
    for names, files in _headers(spark, path).items() if exists(spark, path) else ():
        raw = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(len(names))] + [T.StructField("_record", T.StringType())])
        rows = spark.read.schema(raw).options(**DIALECT).option("header", True).option("multiLine", True).option("columnNameOfCorruptRecord", "_record").csv(files)
        place = {name: f"_c{k}" for k, name in enumerate(names)}  # of equal names the last
        cells, wrong = [], []
        for f in schema:
            cell = F.col(place[f.name]) if f.name in place else F.lit(None).cast("string")
            cells.append(_typed(cell, f.dataType).alias(f.name))
            wrong.append(F.when((cell != "") & _typed(cell, f.dataType).isNull(), F.lit(f.name)))
        odd = F.concat_ws(", ", *wrong)
        bad = F.when(F.col("_record").isNotNull(), F.lit("cells")).when(odd != "", odd)
        every = F.array(*[F.coalesce(F.col(f"_c{k}"), F.lit("")) for k in range(len(names))])
        parts.append(rows.select(*cells, F.col("_metadata.file_path").alias("_file"), F.coalesce("_record", F.array_join(every, ",")).alias("_record"), bad.alias("_bad")))
    empty = spark.createDataFrame([], T.StructType([*schema, *[T.StructField(c, T.StringType()) for c in ("_file", "_record", "_bad")]]))
    return reduce(DataFrame.unionByName, parts) if parts else empty


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The whole records of the CSV files at path, by name. Columns that a file doesn't have are null; without the path there is no row."""
    return _records(spark, path, schema).where("_bad IS NULL").select(*schema.names)


def bad_records(spark: SparkSession, path: str, schema: T.StructType = C.RESULT_SCHEMA) -> DataFrame:
    """file, record, reason of what read_csv() leaves out."""
    return _records(spark, path, schema).where("_bad IS NOT NULL").select(F.col("_file").alias("file"), F.col("_record").alias("record"), F.col("_bad").alias("reason"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The results at path with defaults for what they lack."""
    return with_defaults(read_csv(spark, path, C.RESULT_SCHEMA))


def plates_of(spark: SparkSession, path: str) -> DataFrame:
    """plate: the different ones of a results table; none without the table."""
    return detected_plates(load(spark, path))


def append_run(row: DataFrame, path: str) -> None:
    """Adds a run to the log, a folder of CSV files with headers: appending needs no rewriting."""
    row.coalesce(1).write.mode("append").options(**DIALECT).option("header", True).csv(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, C.RUN_SCHEMA)
