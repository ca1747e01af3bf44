"""Hashes that several operators share; they travel with the functions that use them, so workers need no package."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
_powers: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n or more."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[name] = x
    return _powers["up"], _powers["down"]
