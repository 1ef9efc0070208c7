"""Hilbert index of points on an integer grid, vectorised over the points."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``points`` (n, dims), coordinates below 2^bits.

    Works on the transposed form of the index (one word per axis): the rotations of the
    sub-cubes are undone from the coarsest level down, then the Gray code is taken,
    and the axes' bits are interleaved.
    """
    axes = [points[:, d].astype(np.uint64).copy() for d in range(points.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for a in range(len(axes)):
            inside = (axes[a] & bit) != 0
            swap = np.where(inside, np.uint64(0), (axes[0] ^ axes[a]) & low)
            axes[0] ^= np.where(inside, low, swap)
            axes[a] ^= swap if a else np.uint64(0)
    for a in range(1, len(axes)):
        axes[a] ^= axes[a - 1]
    turn = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        turn ^= np.where((axes[-1] & bit) != 0, low, np.uint64(0))
    index = np.zeros(len(points), np.uint64)
    for level in range(bits - 1, -1, -1):
        for a in range(len(axes)):
            index = (index << one) | (((axes[a] ^ turn) >> np.uint64(level)) & one)
    return index
