"""Sparse logistic regression with follow-the-regularised-leader (proximal) updates.

Defined results: a row without features is judged by the bias alone; without a
single update every weight is zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np


def mix(a: np.ndarray, b: np.ndarray | int, kind: int, bits: int) -> np.ndarray:
    """Hash pairs of 64-bit values of a feature kind to ``bits`` bits."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind * 0x165667B19E3779F9 & (1 << 64) - 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Rows(NamedTuple):
    """Sparse rows, one after another: distinct features, their values, and where each row's begin (and the last's end)."""

    at: np.ndarray
    x: np.ndarray
    bounds: np.ndarray


def row_features(rows: np.ndarray, features: np.ndarray, n: int, bits: int) -> Rows:
    """The distinct features of ``n`` rows, their counts scaled to unit length; a row may have none."""
    key, count = np.unique(rows.astype(np.int64) << bits | features, return_counts=True)
    row, x = key >> bits, count.astype(np.float64)
    length = np.sqrt(np.bincount(row, weights=x * x, minlength=n))
    return Rows(key & ((1 << bits) - 1), x / length[row], np.searchsorted(row, np.arange(n + 1)))


def scores_of(rows: Rows, weights: np.ndarray, bias: float) -> np.ndarray:
    """The sparse dot product of each row with the weights, and the bias."""
    n = len(rows.bounds) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(rows.bounds)), weights=weights[rows.at] * rows.x, minlength=n) + bias


def log_odds(labels: list[int]) -> float:
    """Of the ones among labels, each side counted once more than it occurs."""
    return float(np.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1)))


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal around a fixed bias, so that a row of little evidence stays near the labels' share."""

    bits: int
    bias: float = 0.0
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5

    def __post_init__(self):
        self.z, self.n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self._weights(at)
        g = (float(sigmoid(w @ x + self.bias)) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def weights(self) -> tuple[np.ndarray, float]:
        return self._weights(np.arange(1 << self.bits)).astype(np.float32), self.bias


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
