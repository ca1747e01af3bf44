"""Paths in any storage that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def listed(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, by name, or the file itself; names that begin with _ or . are no data, as for Spark's readers."""
    fs, where = _fs(spark, path)
    files = [f.getPath() for f in fs.listStatus(where) if f.isFile()]
    return sorted(f.toString() for f in files if f.getName()[0] not in "_.")


def head(spark: SparkSession, path: str, most: int) -> bytes:
    """The first bytes of a file."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file, over one that is there."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def make_dirs(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = _fs(spark, path)
        fs.mkdirs(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, by name; nothing without it."""
    fs, where = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file of this text at path, whole and at once, unless there is one; whether it is this one that made it.

    A file written aside is renamed where the storage's rename doesn't
    overwrite; on a machine's own disk, where it does, it is linked.
    """
    jvm, (fs, where) = spark._jvm, _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(at(where), at(aside))
        else:
            rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, where, rename)
        return True
    except Py4JJavaError:
        if not fs.exists(where):
            raise
        return False
    finally:
        fs.delete(aside, False)


def restored(spark: SparkSession, path: str) -> None:
    """Puts what has been moved aside as path.before back in its place, where nothing has taken it."""
    fs, target = _fs(spark, path)
    aside = _fs(spark, f"{path.rstrip('/')}.before")[1]
    if fs.exists(aside) and not fs.exists(target):
        fs.rename(aside, target)
