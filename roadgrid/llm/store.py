"""Shared storage and Arrow steps of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadgrid.store import _tables, cut, release, shared_dir, written
from roadgrid.worker import batches_of, tidy

__all__ = ["_tables", "NUMBER_ROWS", "cut", "mapped", "release", "shared_dir", "written"]

#: Rows of an Arrow batch of texts, which can be long, and of one of numbers.
BATCH_ROWS, NUMBER_ROWS = 256, 8192


def mapped(df: DataFrame, step, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """df.mapInArrow(step, schema), in small batches, after which the workers give memory back."""
    batches_of(df.sparkSession, rows)
    return df.mapInArrow(tidy(step), schema)
