"""Model files: exported once, sent to all executors by content, opened once a worker; and the machine's resources."""

from __future__ import annotations

import hashlib
import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark import SparkFiles, cloudpickle
from pyspark.sql import SparkSession

from roadgrid.sources.files import _fs, exists, make_dirs
from roadgrid.store import shared_dir
from roadgrid.worker import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: For spark.executorEnv.*: models use one thread each, as tasks already fill the cores.
THREAD_ENV = {name: "1" for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "NUMEXPR_NUM_THREADS")}


class ModelFile(NamedTuple):
    """A model as the workers know it: its name among the files sent to them, and the digest of its content."""

    name: str
    digest: str


def _put(spark: SparkSession, source: str, target: str) -> None:
    """Copies source to target, which appears whole or not at all; a copy that is there already stays."""
    aside = f"{target}.{uuid.uuid4().hex}"
    fs, where = _fs(spark, source)
    to_fs, to = _fs(spark, aside)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to_fs, to, False, spark._jsc.hadoopConfiguration())
    if exists(spark, target) or not to_fs.rename(to, _fs(spark, target)[1]):
        to_fs.delete(to, True)
    if not exists(spark, target):
        raise OSError(f"can't write {target}")


def resolve(spark: SparkSession, path: str, export: Callable[[str, str], None] | None = None, ending: str = ".onnx") -> str:
    """The exported form of a model: itself, the one beside it, or one that export(path, target) makes; the model if that fails.

    Paths are of any storage that Spark reaches. The export runs on local copies
    and is put beside the model by a rename, so of several runs that export at
    once all use one whole file.
    """
    root, own = os.path.splitext(path)
    target = f"{root}{ending}"
    if own == ending or exists(spark, target):
        return path if own == ending else target
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if export is None:
        return path
    with tempfile.TemporaryDirectory() as folder:
        here, made = f"{folder}/model{own}", f"{folder}/model{ending}"
        fs, where = _fs(spark, path)
        fs.copyToLocalFile(False, where, spark._jvm.org.apache.hadoop.fs.Path(f"file://{here}"), True)
        try:
            export(here, made)
            _put(spark, f"file://{made}", target)
        except Exception:  # the model itself is as good, if slower
            return path
    return target


def publish(spark: SparkSession, path: str) -> ModelFile:
    """Sends a model file to all executors, also those that start later, under a name made of its content.

    A copy in shared storage is what they fetch, so a model that changes on disk
    during a run changes nothing, and equal files are sent once.
    """
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        digest = spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
    name = digest + os.path.splitext(path)[1]
    folder = f"{shared_dir(spark)}/models"
    make_dirs(spark, folder)
    if not exists(spark, f"{folder}/{name}"):
        _put(spark, path, f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    return ModelFile(name, digest)


def local(model: ModelFile) -> str:
    """On a worker, the path of its copy, whose content is checked once."""
    checked = kept("model files")
    if model.name not in checked:
        path = SparkFiles.get(model.name)
        with open(path, "rb") as file:
            found = hashlib.file_digest(file, "sha256").hexdigest()
        if found != model.digest:
            raise OSError(f"model {model.name} has arrived with digest {found}")
        checked[model.name] = path
    return checked[model.name]


def opened(model: ModelFile, kind: Callable[[str], object]) -> Callable[[], object]:
    """A factory for the pipeline: kind(path) of the worker's copy of the file."""
    return lambda: kind(local(model))


def hardware() -> dict:
    """logical_cores, physical_cores, ram_total_gb, ram_avail_gb; memory is 0 where it can't be told."""
    cores = os.cpu_count() or 1
    info = {"logical_cores": cores, "physical_cores": cores, "ram_total_gb": 0.0, "ram_avail_gb": 0.0}
    try:
        import psutil
    except ImportError:
        return info
    memory = psutil.virtual_memory()
    return info | {"physical_cores": psutil.cpu_count(logical=False) or cores, "ram_total_gb": memory.total / 2**30, "ram_avail_gb": memory.available / 2**30}
