"""The watchlist file: one plate a line. Writers compare versions, so none overwrites what it hasn't seen."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrid.functions import text as X
from roadgrid.operators import match
from roadgrid.sources.files import claim, exists, head, is_file, names, remove, restored

#: Versions that are kept, so that what has been read from one can still be worked out.
REMEMBERED = 64
TRIES = 10


class Conflict(Exception):
    """The list has changed since it was read."""


def _versions(spark: SparkSession, path: str) -> str:
    """The folder of versions: in the list's, where its readers don't look, or beside a list that is one file."""
    return f"{path.rstrip('/')}.versions" if is_file(spark, path) else f"{path.rstrip('/')}/_versions"


def _heads(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names(spark, _versions(spark, path)) if n.isdigit()]


def version(spark: SparkSession, path: str) -> int:
    """The list's version, 0 before its first save."""
    return max(map(int, _heads(spark, path)), default=0)


def current(spark: SparkSession, path: str) -> str:
    """Where the lines of the latest version are; path itself, a list written by hand, before its first save."""
    heads, folder = _heads(spark, path), _versions(spark, path)
    return f"{folder}/{head(spark, f'{folder}/{heads[-1]}', 64).decode()}" if heads else path


def _lines(spark: SparkSession, path: str) -> DataFrame:
    restored(spark, path)  # a replacement that broke off before there were versions
    if not exists(spark, current(spark, path)):
        with contextlib.suppress(Conflict):
            save(spark.createDataFrame([], "plate string"), path, 0)
    return spark.read.text(current(spark, path))


def load(spark: SparkSession, path: str) -> DataFrame:
    """plate: normalised, different, not blank. A missing list is created, empty."""
    return match.watchlist(_lines(spark, path))


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """plate: stripped and upper case only, as the list's tool shows them."""
    return _lines(spark, path).select(X.strip_upper(F.col("value")).alias("plate")).where("plate <> ''").distinct()


def save(plates: DataFrame, path: str, base: int | None = None) -> int:
    """Makes the sorted plates, one a line, the list; its new version.

    With base, the version that the plates were made from, a list that has
    changed since stays and Conflict is raised. Lines are written first, whole;
    the file that names them as the next version is made once, by one writer,
    and is all that changes the list. So readers see one version or another, and
    a writer that breaks off has changed nothing.
    """
    spark = plates.sparkSession
    name, folder = f"lines-{uuid.uuid4().hex}", _versions(spark, path)
    plates.select("plate").distinct().coalesce(1).sortWithinPartitions("plate").write.text(f"{folder}/{name}")
    at = version(spark, path)
    while base is None or at == base:
        if claim(spark, f"{folder}/{at + 1:012}", name):
            for old in _heads(spark, path)[:-REMEMBERED]:
                lines = head(spark, f"{folder}/{old}", 64).decode()
                remove(spark, f"{folder}/{old}")
                remove(spark, f"{folder}/{lines}")
            return at + 1
        at = version(spark, path)
    remove(spark, f"{folder}/{name}")
    raise Conflict(f"{path} is at version {at}, not {base}")


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = TRIES) -> int:
    """Saves change(the list), made anew from the list as it then is if another writer comes in between; the new version."""
    for left in range(tries - 1, -1, -1):
        base = version(spark, path)
        try:
            return save(change(load(spark, path)), path, base)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries has to be 1 or more")
