"""Weights of the Gaussian kernels."""

from __future__ import annotations

import math

import numpy as np


def gauss_2d(sigma: float, reach: int) -> list[list[float]]:
    """(2 * reach + 1)^2 weights that sum to 1."""
    raw = [[math.exp(-(x * x + y * y) / (2 * sigma * sigma)) / (math.pi * 2 * sigma * sigma) for y in range(-reach, reach + 1)] for x in range(-reach, reach + 1)]
    total = sum(map(sum, raw))
    return [[v / total for v in row] for row in raw]


def gauss_1d(sigma: float) -> list[float]:
    """floor(6 * sigma) weights in single precision around the middle; their number can be even."""
    s = np.float32(sigma)
    n = int(np.floor(np.float32(6) * s))
    at = np.arange(n, dtype=np.float32) - np.float32((n - 1) / 2)
    raw = np.exp(-(at * at) / (np.float32(2) * s * s)).astype(np.float32)
    total = np.float32(0)
    for v in raw:
        total = np.float32(total + v)
    return [float(v) for v in (raw / total if total else raw)]


# The derivative kernel and the Sobel kernels.
DERIVATIVE = [[-1.0, -1.0], [1.0, 1.0]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


def full_convolution(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    out = [[0.0] * (len(a[0]) + len(b[0]) - 1) for _ in range(len(a) + len(b) - 1)]
    for i, row in enumerate(a):
        for j, x in enumerate(row):
            for k, other in enumerate(b):
                for m, y in enumerate(other):
                    out[i + k][j + m] += x * y
    return out


SECOND_DERIVATIVE = full_convolution(DERIVATIVE, DERIVATIVE)
