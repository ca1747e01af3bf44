"""A small plate model of this repository's own: NumPy only, trained on drawn glyphs, kept in one file.

The detector takes the largest bright, filled rectangle for the plate; the
recogniser cuts it at columns without ink and names each glyph by a softmax
regression on its shape.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Strokes between the nine points of a 3 x 3 grid, numbered by rows, of every character.
STROKES = {
    "0": "02 28 86 60 26", "1": "17 31", "2": "02 25 53 36 68", "3": "02 28 86 35", "4": "03 35 28", "5": "20 03 35 58 86",
    "6": "20 06 68 85 53", "7": "02 27", "8": "02 28 86 60 35", "9": "53 30 02 28 86", "A": "31 15 36 58 35", "B": "01 14 34 45 58 86 60",
    "C": "20 06 68", "D": "01 15 57 76 60", "E": "20 06 68 34", "F": "20 06 34", "G": "20 06 68 85 54", "H": "06 28 35", "I": "02 17 68",
    "J": "28 86 63", "K": "06 32 38", "L": "06 68", "M": "60 04 42 28", "N": "60 08 82", "O": "02 28 86 60", "P": "60 02 25 53",
    "Q": "02 28 86 60 48", "R": "60 02 25 53 48", "S": "20 04 48 86", "T": "02 17", "U": "06 68 82", "V": "07 72", "W": "06 64 48 82",
    "X": "08 26", "Y": "04 42 47", "Z": "02 26 68",
}
LETTERS = "".join(STROKES)
#: Height and width to which a glyph is brought.
ROWS, COLUMNS = 14, 12


def glyph(letter: str, height: int = 28, width: int = 18, pen: float = 1.6) -> np.ndarray:
    """Ink, 0 to 1, of a drawn character."""
    points = np.array([(r * (height - 1 - 2 * pen) / 2 + pen, c * (width - 1 - 2 * pen) / 2 + pen) for r in range(3) for c in range(3)])
    pixel = np.stack(np.meshgrid(np.arange(height), np.arange(width), indexing="ij"), -1)[:, :, None, :]
    a, b = (points[[int(s[k]) for s in STROKES[letter].split()]] for k in range(2))
    along = np.clip(((pixel - a) * (b - a)).sum(-1) / ((b - a) ** 2).sum(-1), 0, 1)
    away = np.sqrt(((a + along[..., None] * (b - a) - pixel) ** 2).sum(-1)).min(-1)
    return np.clip(pen + 0.5 - away, 0, 1)


def plate(text: str, height: int = 28, pen: float = 1.6, gap: int = 5) -> np.ndarray:
    """A plate: dark glyphs on light ground, as a BGR image."""
    space = np.zeros((height, gap))
    ink = np.concatenate([space, *[x for c in text for x in (glyph(c, height, height * 9 // 14, pen), space)]], 1)
    ink = np.pad(ink, gap)
    return np.repeat(np.rint(235 - 205 * ink).astype(np.uint8)[:, :, None], 3, 2)


def photo(text: str, seed: int = 0, height: int = 150, width: int = 320) -> np.ndarray:
    """A dark scene with a plate somewhere in it; none for an empty text."""
    rng = np.random.default_rng(seed)
    scene = rng.integers(0, 90, (height, width, 3)).astype(np.uint8)
    if text:
        own = plate(text)
        y, x = rng.integers(5, height - own.shape[0] - 5), rng.integers(5, width - own.shape[1] - 5)
        noise = rng.integers(-12, 13, own.shape)
        scene[y : y + own.shape[0], x : x + own.shape[1]] = np.clip(own.astype(int) + noise, 0, 255).astype(np.uint8)
    return scene


def shape(ink: np.ndarray) -> np.ndarray:
    """A glyph's ink in its bounding box, scaled to the features' grid, and the box's proportion."""
    rows, cols = (np.flatnonzero(ink.max(k) > 0.5) for k in (1, 0))
    if not len(rows) or not len(cols):
        return np.zeros(ROWS * COLUMNS + 1)
    box = ink[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
    places = lambda n, size: np.clip((np.arange(2 * n) + 0.5) * size / (2 * n), 0, size - 1).astype(int)
    fine = box[places(ROWS, box.shape[0])[:, None], places(COLUMNS, box.shape[1])]
    grid = fine.reshape(ROWS, 2, COLUMNS, 2).mean((1, 3))
    return np.append(grid.ravel(), box.shape[1] / box.shape[0])


def train(path: str, each: int = 30, steps: int = 300, seed: int = 5) -> float:
    """Fits the recogniser on drawn glyphs of several sizes and pens with noise, writes the model; its accuracy on others like them."""
    rng = np.random.default_rng(seed)

    def drawn(n):
        x, y = [], []
        for k, c in enumerate(LETTERS):
            for _ in range(n):
                h = int(rng.integers(18, 44))
                ink = glyph(c, h, max(8, int(h * rng.uniform(0.55, 0.75))), rng.uniform(1.0, 2.2) * h / 28)
                x.append(shape(np.clip(ink + rng.normal(0, 0.12, ink.shape), 0, 1)))
                y.append(k)
        return np.array(x), np.array(y)

    x, y = drawn(each)
    mean, scale = x.mean(0), x.std(0) + 0.1
    z, w, goal = np.hstack(((x - mean) / scale, np.ones((len(x), 1)))), np.zeros((x.shape[1] + 1, len(LETTERS))), np.eye(len(LETTERS))[y]
    for _ in range(steps):
        p = np.exp(z @ w - (z @ w).max(1, keepdims=True))
        w -= 0.5 * (z.T @ (p / p.sum(1, keepdims=True) - goal) / len(z) + 1e-4 * w)
    with open(path, "wb") as file:
        np.savez(file, weights=w, mean=mean, scale=scale, letters=np.array(list(LETTERS)), bright=150.0, least=40.0)
    model, (x, y) = GlyphReader(path), drawn(5)
    return float((model.chances(x).argmax(1) == y).mean())


def export(path: str, target: str) -> None:
    """The model as it is used: scaling folded into the weights, single precision."""
    with np.load(path) as f:
        w = f["weights"][:-1] / f["scale"][:, None]
        bias = f["weights"][-1] - f["mean"] @ w
        with open(target, "wb") as file:
            np.savez(file, weights=w.astype(np.float32), bias=bias.astype(np.float32), letters=f["letters"], bright=f["bright"], least=f["least"])


def _grey(image: np.ndarray) -> np.ndarray:
    return image.astype(float).mean(2)


def longest(marks: np.ndarray) -> tuple[int, int]:
    """Bounds of the longest run of true marks."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    if not len(edges):
        return 0, 0
    k = int((edges[1::2] - edges[::2]).argmax())
    return int(edges[2 * k]), int(edges[2 * k + 1])


class GlyphDetector:
    """One box an image: the bright rows' and columns' longest runs; its confidence is how much of it is bright."""

    ENDING, export = ".run", staticmethod(export)

    def __init__(self, path: str):
        with np.load(path) as f:
            self.bright, self.least = float(f["bright"]), float(f["least"])

    def detect(self, images: list[np.ndarray]) -> list[list[tuple[float, float, float, float, float]]]:
        return [self._boxes(_grey(x) > self.bright) for x in images]

    def _boxes(self, light: np.ndarray) -> list:
        y1, y2 = longest(light.sum(1) >= self.least)
        x1, x2 = longest(light[y1:y2].sum(0) >= max(2, 0.1 * (y2 - y1))) if y2 > y1 else (0, 0)
        if y2 - y1 < 8 or x2 - x1 < 20:
            return []
        return [(float(light[y1:y2, x1:x2].mean()), float(x1), float(y1), float(x2), float(y2))]


class GlyphReader:
    """Text of a crop and the chance of each character."""

    ENDING, export = ".run", staticmethod(export)

    def __init__(self, path: str):
        with np.load(path) as f:
            whole = "bias" in f
            self.w, self.bias = (f["weights"], f["bias"]) if whole else (f["weights"][:-1] / f["scale"][:, None], None)
            self.bias = self.bias if whole else f["weights"][-1] - f["mean"] @ self.w
            self.letters, self.bright = list(f["letters"]), float(f["bright"])

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def read(self, crop: np.ndarray) -> tuple[str | None, list[float] | None]:
        light = _grey(crop)
        # What is around the plate is dark as ink is: rows and columns without light ground go first.
        rows, cols = (np.flatnonzero((light > self.bright).mean(k) > 0.2) for k in (1, 0))
        if len(rows) < 8 or len(cols) < 8:
            return None, None
        ink = np.clip((235 - light[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]) / 205, 0, 1)
        marks = np.concatenate(([0], (ink.max(0) > 0.5).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(marks))
        found = [shape(ink[:, a:b]) for a, b in zip(edges[::2], edges[1::2]) if b - a >= 3]
        if not found:
            return None, None
        p = self.chances(np.array(found))
        return "".join(self.letters[k] for k in p.argmax(1)), [float(v) for v in p.max(1)]
