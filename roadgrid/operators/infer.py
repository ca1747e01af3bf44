"""Model inference at the edges of the plan: one Python node for each model, batches of rows, failures row by row."""

from __future__ import annotations

import hashlib
import sys
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import geometry as G
from roadgrid.operators import imaging
from roadgrid.sources import images as I
from roadgrid.worker import batches_of, kept

for _module in (sys.modules[__name__], I, imaging, C):
    cloudpickle.register_pickle_by_value(_module)

DETECTED = f"path string, image string, height int, width int, channels int, data binary, boxes {C.BOXES}, yolo_time_s double, worker_id long, error string"
READ = (
    "path string, image string, plate_detected boolean, yolo_time_s double, worker_id long, error string, "
    "plate string, char_probs array<double>, failed boolean, crop binary, preprocessed binary, ocr_time_s double"
)
#: Rows with pixels that go to Python at once.
IMAGE_ROWS = 32


class Detector(Protocol):
    def detect(self, images: list[np.ndarray]) -> list[list[tuple[float, float, float, float, float]]]:
        """Of each image, (conf, x1, y1, x2, y2) of its boxes."""


class Recogniser(Protocol):
    def read(self, crop: np.ndarray) -> tuple[str | None, list[float] | None]:
        """Text and the probabilities of its characters."""


def model_id(factory: Callable) -> str:
    """Tells factories apart by what travels to the workers, so closures of one function are different models."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _model(name: str, factory: Callable, warm: Callable):
    """One model of a factory a Python worker, loaded and warmed up before any row is timed."""
    models = kept("models")
    if name not in models:
        models[name] = factory()
        warm(models[name])
    return models[name]


def _warm_detector(model: Detector) -> None:
    model.detect([np.zeros((64, 64, 3), np.uint8)])


def _warm_recogniser(model: Recogniser) -> None:
    model.read(np.zeros((64, 256, 3), np.uint8))


def warm_up(spark, detector: Callable, recogniser: Callable, workers: int) -> float:
    """Loads and warms up both models in as many tasks as there are workers; the seconds of the slowest.

    Later tasks of the same Python workers find them loaded; a worker that is
    started later warms up before its first row.
    """
    names = model_id(detector), model_id(recogniser)

    def load(frames):
        for frame in frames:
            begin = time.perf_counter()
            _model(names[0], detector, _warm_detector)
            _model(names[1], recogniser, _warm_recogniser)
            yield pd.DataFrame({"s": [time.perf_counter() - begin] * min(1, len(frame))})

    return spark.range(0, max(1, workers), 1, max(1, workers)).mapInPandas(load, "s double").agg(F.max("s")).first()[0] or 0.0


def _worker() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _detector_pass(factory: Callable[[], Detector], batch: int, name: str):
    def run(frames):
        model = _model(name, factory, _warm_detector)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                loaded = [k for k, h in enumerate(part["height"]) if h > 0]
                arrays = [I.pixels(*part.iloc[k][["data", "height", "width", "channels"]]) for k in loaded]
                boxes, errors, times = [None] * len(part), [""] * len(part), [0.0] * len(part)
                begin = time.perf_counter()
                try:
                    found = model.detect(arrays) if arrays else []
                    spent = [(time.perf_counter() - begin) / max(1, len(arrays))] * len(arrays)
                except Exception:  # one bad image must not take the batch's other detections
                    found, spent = [], []
                    for k, a in zip(loaded, arrays):
                        begin = time.perf_counter()
                        try:
                            found.append(model.detect([a])[0])
                        except Exception as e:
                            found.append([])
                            errors[k] = f"YOLO: {e}"
                        spent.append(time.perf_counter() - begin)
                for k, own, s in zip(loaded, found, spent):
                    boxes[k], times[k] = [dict(zip(("conf", "x1", "y1", "x2", "y2"), map(float, b))) for b in own], s
                for k, h in enumerate(part["height"]):
                    if h <= 0:
                        errors[k] = C.LOAD_ERROR
                part["boxes"], part["yolo_time_s"], part["worker_id"], part["error"] = boxes, times, _worker(), errors
                yield part

    return run


def detect(images: DataFrame, factory: Callable[[], Detector], batch: int = C.DETECTOR_BATCH) -> DataFrame:
    """Decoded images with boxes; unreadable ones and failures stay, with an error."""
    batches_of(images.sparkSession, IMAGE_ROWS)
    return images.select("path", "image", "height", "width", "channels", "data").mapInPandas(_detector_pass(factory, batch, model_id(factory)), DETECTED)


def with_best(detected: DataFrame) -> DataFrame:
    best = G.best_box(F.col("boxes"), F.col("width"), F.col("height"))
    return detected.withColumn("best", best)


def _reader_pass(factory: Callable[[], Recogniser], name: str):
    def run(frames):
        model = _model(name, factory, _warm_recogniser)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                own = (r.path, r.image, bool(r.detected), r.yolo_time_s, r.worker_id, r.error)
                if not r.detected:
                    rows.append((*own, None, None, False, None, None, None))
                    continue
                crop = I.pixels(r.data, r.height, r.width, r.channels)[int(r.y1) : int(r.y2), int(r.x1) : int(r.x2)]
                begin, failed, text, probs = time.perf_counter(), False, None, None
                try:
                    text, probs = model.read(crop)
                except Exception:
                    failed = True
                spent = time.perf_counter() - begin
                rows.append((*own, text, probs, failed, I.png(crop), I.png(imaging.preprocess(crop)), spent))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return run


def read(found: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """with_best() rows without their pixels, with the readings of the best boxes; images without a box keep their row."""
    edges = [F.col(f"best.box.{e}").alias(e) for e in ("x1", "y1", "x2", "y2")]
    # The pixels of images without a box have no further use.
    data = F.when(F.col("best").isNotNull(), F.col("data")).alias("data")
    rows = found.select("path", "image", F.col("best").isNotNull().alias("detected"), "yolo_time_s", "worker_id", "error", "height", "width", "channels", data, *edges)
    batches_of(found.sparkSession, IMAGE_ROWS)
    return rows.mapInPandas(_reader_pass(factory, model_id(factory)), READ)
