"""Models in ONNX files, for cli run's --detector and --recogniser with their model options.

OnnxDetector takes detectors that were exported with the common head of one
tensor (batch, 4 + classes, places): centre, size and scores. OnnxReader takes
recognisers that give a distribution over an alphabet for each of a number of
places. Both take their sizes from the file.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Of detections: the least confidence, and the overlap from which the weaker of two is the same plate.
MIN_SCORE, SAME = 0.25, 0.7
SIZE, GROUND = 640, 114
ALPHABET, PAD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_", "_"


def _session(path: str):
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # tasks fill the cores already
    return ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def _fixed(n, otherwise: int) -> int:
    return n if isinstance(n, int) and n > 0 else otherwise


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by pixel centres, in floats."""
    x = image.astype(np.float32)
    for axis, new in ((0, height), (1, width)):
        old = x.shape[axis]
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1)).astype(np.float32)
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, old - 1), axis) * part
    return x


def letterbox(image: np.ndarray, height: int, width: int) -> tuple[np.ndarray, float, float, float]:
    """The image in the middle of a grey field, as large as its proportions allow; scale, left and top of it."""
    h, w = image.shape[:2]
    scale = min(height / h, width / w)
    new_h, new_w = max(1, round(h * scale)), max(1, round(w * scale))
    top, left = round((height - new_h) / 2 - 0.1), round((width - new_w) / 2 - 0.1)
    field = np.full((height, width, 3), GROUND, np.float32)
    field[top : top + new_h, left : left + new_w] = resized(image, new_h, new_w)
    return field, scale, left, top


def distinct(boxes: np.ndarray, scores: np.ndarray, same: float = SAME) -> list[int]:
    """Indices, strongest first, of boxes (x1, y1, x2, y2) that don't overlap a stronger one by same or more."""
    left, kept = list(np.argsort(-scores, kind="stable")), []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    while left:
        k = left.pop(0)
        kept.append(int(k))
        if left:
            rest = np.array(left)
            low, high = np.maximum(boxes[rest, :2], boxes[k, :2]), np.minimum(boxes[rest, 2:], boxes[k, 2:])
            common = np.prod(np.clip(high - low, 0, None), axis=1)
            left = list(rest[common < same * np.maximum(area[rest] + area[k] - common, 1e-9)])
    return kept


class OnnxDetector:
    """Boxes of images, in their own pixels, strongest first."""

    def __init__(self, path: str):
        self.session = _session(path)
        self.input = self.session.get_inputs()[0]
        batch, _, h, w = self.input.shape
        self.height, self.width, self.batched = _fixed(h, SIZE), _fixed(w, SIZE), not isinstance(batch, int) or batch < 1

    def detect(self, images: list[np.ndarray]) -> list[list[tuple[float, float, float, float, float]]]:
        if not images:
            return []
        fields = [letterbox(x[:, :, ::-1], self.height, self.width) for x in images]
        stack = np.stack([f[0] for f in fields]).transpose(0, 3, 1, 2) / np.float32(255)
        runs = [stack] if self.batched else [stack[k : k + 1] for k in range(len(stack))]
        out = np.concatenate([self.session.run(None, {self.input.name: np.ascontiguousarray(r, np.float32)})[0] for r in runs])
        return [self._boxes(o, *f[1:], x.shape) for o, f, x in zip(out, fields, images)]

    def _boxes(self, out: np.ndarray, scale: float, left: float, top: float, shape: tuple) -> list:
        scores = out[4:].max(0)
        own = scores >= MIN_SCORE
        (cx, cy, w, h), scores = out[:4, own].astype(float), scores[own].astype(float)
        boxes = np.stack((cx - w / 2 - left, cy - h / 2 - top, cx + w / 2 - left, cy + h / 2 - top), 1) / scale
        boxes = np.clip(boxes, 0, [shape[1], shape[0], shape[1], shape[0]])
        return [(float(scores[k]), *map(float, boxes[k])) for k in distinct(boxes, scores)]


class OnnxReader:
    """Text of a crop, without padding, and the chance of the character at each place.

    The file may say its alphabet and padding in its metadata (alphabet,
    pad_char).
    """

    def __init__(self, path: str):
        self.session = _session(path)
        self.input = self.session.get_inputs()[0]
        said = self.session.get_modelmeta().custom_metadata_map
        self.alphabet, self.pad = said.get("alphabet", ALPHABET), said.get("pad_char", PAD)
        _, h, w, self.channels = self.input.shape
        self.height, self.width = _fixed(h, 64), _fixed(w, 128)
        self.bytes = self.input.type == "tensor(uint8)"

    def read(self, crop: np.ndarray) -> tuple[str | None, list[float] | None]:
        if not crop.size:
            return None, None
        x = resized(crop[:, :, ::-1], self.height, self.width)
        if self.channels == 1:
            x = x @ np.array([[0.299], [0.587], [0.114]], np.float32)
        x = np.rint(np.clip(x, 0, 255)).astype(np.uint8) if self.bytes else x / np.float32(255)
        out = self.session.run(None, {self.input.name: np.ascontiguousarray(x[None])})[0]
        places = out.reshape(-1, len(self.alphabet)).astype(float)
        text = "".join(self.alphabet[k] for k in places.argmax(1)).replace(self.pad, "")
        return text, [float(p) for p in places.max(1)]
