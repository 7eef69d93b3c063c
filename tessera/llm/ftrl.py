"""Follow-the-regularised-leader updates with elastic-net penalties, for two or more classes."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal over sparse rows; weights has one column per class (one for two classes)."""

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One update with the sparse row (at, x); at holds distinct coordinates."""
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n)
        out = x @ w
        if w.shape[1] == 1:
            error = 1 / (1 + np.exp(-np.clip(out, -35, 35))) - label
        else:
            e = np.exp(out - out.max())
            error = e / e.sum()
            error[label] -= 1
        g = x[:, None] * error[None, :]
        root = np.sqrt(n + g * g)
        self.z[at] = z + g - (root - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n).astype(np.float32)


def epochs(model: Ftrl, rows: list[tuple[np.ndarray, np.ndarray, int]], times: int, seed: int = 7) -> Ftrl:
    """`times` passes over the rows in a fixed shuffled order."""
    rng = np.random.default_rng(seed)
    for _ in range(times):
        for i in rng.permutation(len(rows)):
            model.learn(*rows[i])
    return model
