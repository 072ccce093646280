"""A forest of links inside one task, in numpy."""

from __future__ import annotations

import numpy as np


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 under links u-v: the smallest node reachable."""
    lab = np.arange(n)
    while len(u):
        a, b = lab[u], lab[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        live = low != high
        if not live.any():
            break
        u, v, low, high = u[live], v[live], low[live], high[live]
        np.minimum.at(lab, high, low)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab
