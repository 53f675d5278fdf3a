"""Interpolating splines as weights: a value between labels is a sum over the labels' values, so that a join can make it.

The coefficients of a spline solve a banded system along an axis. A row of its inverse falls off by a constant factor from
label to label, so the system is solved in blocks of the axis with a margin to both sides, and weights below NEGLIGIBLE are
left out. Only axes are held, never cells.
"""

from __future__ import annotations

import numpy as np

#: Coefficients solved for at once, the margin to either side, and the size of a weight that is left out.
BLOCK, MARGIN, NEGLIGIBLE = 256, 96, 1e-13

Row = tuple[np.ndarray, np.ndarray]


def knots(x: np.ndarray, degree: int) -> np.ndarray:
    """The knots of a spline through x that needs no condition at its ends: labels of an odd degree, middles of an even one."""
    if degree % 2:
        inner = x[(degree + 1) // 2 : len(x) - (degree + 1) // 2]
    else:
        middle = (x[1:] + x[:-1]) / 2
        inner = middle[degree // 2 : len(middle) - degree // 2]
    return np.concatenate((np.repeat(x[0], degree + 1), inner, np.repeat(x[-1], degree + 1)))


def basis(t: np.ndarray, degree: int, u: float, n: int) -> Row:
    """The numbers of the basis functions that are not zero at u, and their values."""
    k = int(np.clip(np.searchsorted(t, u, side="right") - 1, degree, n - 1))
    values = [1.0]
    for d in range(1, degree + 1):
        left = [u - t[k + 1 - d + i] for i in range(d)]
        right = [t[k + 1 + i] - u for i in range(d)]
        share = [v / (a + b) if a + b else 0.0 for v, a, b in zip(values, left, right)]
        values = [(right[i] * share[i] if i < d else 0.0) + (left[i - 1] * share[i - 1] if i else 0.0) for i in range(d + 1)]
    return np.arange(k - degree, k + 1), np.array(values)


def solved(rows: list[Row], targets: list[Row]) -> list[tuple[int, int, float]]:
    """(target, label, weight): of values that are sums of coefficients, as sums of what the labels' rows of coefficients give."""
    out, n = [], len(rows)
    home = np.array([int(i.min()) for i, _ in targets], np.int64)
    for start in range(0, n, BLOCK):
        mine = np.nonzero((home >= start) & (home < start + BLOCK))[0]
        if not len(mine):
            continue
        low = max(0, start - MARGIN)
        high = min(n, max(start + BLOCK, max(int(targets[m][0].max()) for m in mine) + 1) + MARGIN)
        a, b = np.zeros((high - low, high - low)), np.zeros((high - low, len(mine)))
        for i in range(low, high):
            inside = (rows[i][0] >= low) & (rows[i][0] < high)
            np.add.at(a[i - low], rows[i][0][inside] - low, rows[i][1][inside])
        for c, m in enumerate(mine):
            np.add.at(b[:, c], targets[m][0] - low, targets[m][1])
        w = np.linalg.solve(a.T, b)
        for c, m in enumerate(mine):
            out += [(int(m), int(i) + low, float(w[i, c])) for i in np.nonzero(np.abs(w[:, c]) > NEGLIGIBLE)[0]]
    return out


def between(x: list[float], at: list[float], degree: int) -> list[tuple[int, int, float]]:
    """(place in at, place in x, weight) of the spline through rising labels x; none for places outside of them, nor on too few labels."""
    labels = np.asarray(x, float)
    if len(labels) <= degree:
        return []
    scale = labels[-1] - labels[0]
    u = (labels - labels[0]) / scale * (len(labels) - 1)
    t = knots(u, degree)
    inside = [i for i, v in enumerate(at) if labels[0] <= v <= labels[-1]]
    targets = [basis(t, degree, (at[i] - labels[0]) / scale * (len(labels) - 1), len(labels)) for i in inside]
    return [(inside[m], j, w) for m, j, w in solved([basis(t, degree, v, len(labels)) for v in u], targets)]


def cardinal(degree: int, x: float) -> float:
    """The central B-spline of a degree on whole knots."""
    if degree == 0:
        return 1.0 if -0.5 <= x < 0.5 else 0.0
    h = (degree + 1) / 2
    return ((h + x) * cardinal(degree - 1, x + 0.5) + (h - x) * cardinal(degree - 1, x - 0.5)) / degree


def stretched(source: int, out: int, degree: int) -> list[tuple[int, int, float]]:
    """(out cell, source cell, weight) of the spline through evenly spaced cells, mirrored at its ends, from the first cell to the last."""
    if source == 1:
        return [(o, 0, 1.0) for o in range(out)]

    def row(x: float) -> Row:
        k = np.arange(int(np.ceil(x - (degree + 1) / 2)), int(np.floor(x + (degree + 1) / 2)) + 1)
        around = np.abs(k) % (2 * (source - 1))
        return np.minimum(around, 2 * (source - 1) - around), np.array([cardinal(degree, x - i) for i in k])

    step = (source - 1) / (out - 1) if out > 1 else 0.0
    return solved([row(float(i)) for i in range(source)], [row(min(step * o, source - 1.0)) for o in range(out)])
