"""Image files: scan, decoding and PNG sinks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrid.functions import text as X
from roadgrid.sources.files import exists

FILES = "path string, modificationTime timestamp, length long, content binary"
DECODED = "path string, image string, height int, width int, channels int, data binary"
JVM_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[bB][mM][pP]}"
WEBP_GLOB = "*.[wW][eE][bB][pP]"
GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[bB][mM][pP],[wW][eE][bB][pP]}"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's image files (not its subfolders'), with image, the file's name; empty without the folder.

    The content is only read where it is used.
    """
    if exists(spark, folder):
        files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(folder)
    else:
        files = spark.createDataFrame([], FILES)
    files = files.withColumn("image", X.basename(F.col("path")))
    return files.where(X.is_image(F.col("image")))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, image, height, width, channels, data (BGR bytes). Files that can't be decoded stay, with height -1.

    The JVM decodes all but WebP, which Pillow decodes where the workers have it.
    """
    if not exists(spark, folder):
        return spark.createDataFrame([], DECODED)
    rows = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", JVM_GLOB).load(folder)
    path = F.col("image.origin")
    rows = rows.select(path.alias("path"), X.basename(path).alias("image"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    webp = spark.read.format("binaryFile").option("pathGlobFilter", WEBP_GLOB).load(folder).select("path", X.basename(F.col("path")).alias("image"), "content")
    return rows.unionByName(webp.mapInArrow(_webp, DECODED)).where(X.is_image(F.col("image")))


def _webp(batches):
    import io

    import pyarrow as pa

    for batch in batches:
        cells = []
        for data in batch.column(2).to_pylist():
            try:
                from PIL import Image

                x = np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))[:, :, ::-1]
                cells.append((x.shape[0], x.shape[1], 3, x.tobytes()))
            except Exception:  # also without Pillow: an image that can't be decoded, as any other
                cells.append((-1, -1, -1, b""))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        arrays = [pa.array([c[k] for c in cells], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["path", "image", "height", "width", "channels", "data"])


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x 3 uint8, BGR."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3]


def png(image: np.ndarray) -> bytes:
    """A BGR image as a PNG file."""
    h, w = image.shape[:2]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), image[:, :, ::-1].reshape(h, -1)), axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def export(rows: DataFrame, folder: str, name: str, content: str) -> int:
    """Writes each row's content under its name in a folder, from the executors; how many.

    folder is a path or URI that every executor reaches by Arrow's filesystems.
    A file is written aside and then moved, so a task that runs again leaves the
    same files.
    """

    def write(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        target, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        target.create_dir(base, recursive=True)
        for batch in batches:
            for to, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{base}/{os.path.basename(to)}"
                aside = f"{path}.{TaskContext.get().taskAttemptId()}"
                with target.open_output_stream(aside) as out:
                    out.write(data.as_py())
                target.move(aside, path)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    done = rows.where(F.col(content).isNotNull()).select(name, content).mapInArrow(write, "n long")
    return done.agg(F.sum("n")).first()[0] or 0
