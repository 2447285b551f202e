"""Clusters that take one vector after another: pull of a new member, and the lead of the best over the next."""

from __future__ import annotations

import numpy as np


def pulled(centroid: np.ndarray, v: np.ndarray, size: int, most: float) -> tuple[np.ndarray, float, float]:
    """(new unit centroid, share of the new member, length before scaling); the share is one over the size, ``most`` at most."""
    share = min(most, 1.0 / size)
    moved = centroid + share * (v - centroid)
    length = max(float(np.sqrt(moved @ moved)), 1e-8)
    return moved / length, share, length


def leading(values: np.ndarray, alone: float) -> tuple[int, float, float]:
    """(index, value, lead over the next) of the greatest value; a single one leads by ``alone``."""
    at = int(values.argmax())
    rest = np.concatenate([values[:at], values[at + 1:]])
    return at, float(values[at]), float(values[at] - rest.max()) if len(rest) else alone
