"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from ._common import mix64

WIDTH = 5


def shingle_hashes(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of each run of ``width`` words (of the whole sequence, if it is shorter)."""
    if not len(h):
        return h
    w = min(width, len(h))
    out = np.full(len(h) - w + 1, w, dtype=np.uint64)
    for i in range(w):
        out = mix64(out ^ h[i : len(h) - w + 1 + i])
    return out

