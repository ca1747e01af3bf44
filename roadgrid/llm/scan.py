"""Ranks and running aggregates over sorted ranges: no key's rows meet in one task, however many it has.

Rows are range-partitioned by group and order and written with their part and
their row in it. Running values are worked out within a part, and what the
parts before add comes from one row a part and group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrid.llm.store import release, written

_IN_PART = (1 << 33) - 1  # of monotonically_increasing_id(): the row within its partition


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of order, with _part and _row, as a table of its own: the ranges are sampled once."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PART))}), "ranges")


def _with_runs(rows: DataFrame, runs: DataFrame, group: list[str]) -> DataFrame:
    """rows with their part and group's row of runs, whose keys are _p and _g_*."""
    on = [rows["_part"] == runs["_p"], *[rows[c].eqNullSafe(runs[f"_g_{c}"]) for c in group]]
    return rows.join(runs, on)


def positions(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df, written, with each row's place in its group, from 0. Nulls of group are a group."""
    rows = ranged(df, [*map(F.col, group), *order])
    runs = rows.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group], (before - F.col("_first")).alias("_shift"))
    out = written(_with_runs(rows, runs, group).withColumn(name, F.col("_row") + F.col("_shift")).select(*df.columns, name), "placed")
    release(df.sparkSession, rows)
    return out


def running(df: DataFrame, group: list[str], order: list[Column], names: list[str], fold: Callable, both: Callable) -> DataFrame:
    """df, written, with each of names replaced by its running value in the group, the row's own included.

    fold is an aggregate that doesn't depend on order (F.sum, F.bit_xor), both
    the same of two values; 0 is neutral to it.
    """
    rows = ranged(df, [*map(F.col, group), *order])
    inner = Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*[f"_g_{c}" for c in group]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group]).agg(*[fold(c).alias(f"_b_{c}") for c in names])
    runs = runs.withColumns({f"_b_{c}": F.coalesce(fold(f"_b_{c}").over(earlier), F.lit(0)) for c in names})
    met = _with_runs(rows.withColumns({c: fold(c).over(inner) for c in names}), runs, group)
    out = written(met.withColumns({c: both(F.col(c), F.col(f"_b_{c}")) for c in names}).select(*df.columns), "running")
    release(df.sparkSession, rows)
    return out
