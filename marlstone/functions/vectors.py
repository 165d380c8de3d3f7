"""Vectors of texts, where no encoder is at hand."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=100_000)
def hashed_vector(text: str, size: int = 64) -> np.ndarray:
    """Stand-in for an encoder: normalised counts, with signs, of hashed character trigrams."""
    v = np.zeros(size)
    for i in range(max(len(text) - 2, 1)):
        h = int(hashlib.md5(text[i : i + 3].encode()).hexdigest()[:15], 16)
        v[h % size] += 1 if h // size % 2 else -1
    n = np.linalg.norm(v)
    return v / n if n else v
