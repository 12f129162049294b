"""Hashed byte n-grams of whole texts, vectorised over the bytes of one text."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def codes(text: bytes, n: int, bits: int) -> np.ndarray:
    """Bucket (of 2**bits) of every n-gram, n up to 7; fewer bytes give none."""
    a = np.frombuffer(text, np.uint8)
    m = len(a) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    x = np.full(m, n, np.uint64)
    for i in range(n):
        x = (x << np.uint64(8)) | a[i : i + m]
    return ((x * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
