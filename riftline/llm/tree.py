"""A small classification tree: binary splits by Gini impurity."""

from __future__ import annotations

import numpy as np


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 1):
    """A nested (feature, threshold, low, high), or the share of positive rows at a leaf."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            n, m = int(low.sum()), int((~low).sum())
            if min(n, m) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            impurity = n * a * (1 - a) + m * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def judge(node, row) -> float:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node
