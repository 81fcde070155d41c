"""Union of oriented rings by horizontal slabs.

Between two neighbouring heights of corners and crossings no borders meet, so a
slab is a row of trapezoids; those around which the rings wind are inside.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Ring = Sequence[tuple[float, float]]


def _crossing_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which borders a -> b cross each other."""
    found = []
    d = b - a
    for k in range(len(a) - 1):
        e, r = d[k + 1 :], a[k + 1 :] - a[k]
        cross = d[k, 0] * e[:, 1] - d[k, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            s, t = (r[:, 0] * e[:, 1] - r[:, 1] * e[:, 0]) / cross, (r[:, 0] * d[k, 1] - r[:, 1] * d[k, 0]) / cross
        hit = (cross != 0) & (s > 0) & (s < 1) & (t > 0) & (t < 1)
        found.append(a[k, 1] + s[hit] * d[k, 1])
    return np.concatenate(found) if found else np.zeros(0)


def trapezoids(rings: Sequence[Ring]) -> tuple[list[list[tuple[float, float]]], float]:
    """Disjoint trapezoids (counter-clockwise) whose union is all that the rings wind around, and their surface; rings that run clockwise are holes of their own shape only."""
    edges = [(p, q) for ring in rings for p, q in zip(ring, [*ring[1:], *ring[:1]], strict=True) if p[1] != q[1]]
    if not edges:
        return [], 0.0
    a, b = (np.array([e[k] for e in edges], dtype=float) for k in (0, 1))
    turn = np.where(b[:, 1] > a[:, 1], 1, -1)
    low, high = np.where((turn > 0)[:, None], a, b), np.where((turn > 0)[:, None], b, a)
    heights = np.unique(np.concatenate([a[:, 1], b[:, 1], _crossing_heights(a, b)]))
    slope = (high[:, 0] - low[:, 0]) / (high[:, 1] - low[:, 1])
    out, area = [], 0.0
    for y0, y1 in zip(heights[:-1], heights[1:], strict=True):
        some = np.flatnonzero((low[:, 1] <= y0) & (high[:, 1] >= y1))
        x0, x1 = (low[some, 0] + slope[some] * (y - low[some, 1]) for y in (y0, y1))
        order = np.argsort(x0 + x1, kind="stable")
        winding, left = 0, None
        for k in order.tolist():
            before, winding = winding, winding + int(turn[some[k]])
            if before == 0 and winding != 0:
                left = k
            elif before != 0 and winding == 0 and left is not None:
                width = (x0[k] - x0[left]) + (x1[k] - x1[left])
                if width > 0:
                    corners = [(x0[left], y0), (x0[k], y0), (x1[k], y1), (x1[left], y1)]
                    out.append([(float(x), float(y)) for x, y in dict.fromkeys(corners)])
                    area += float(width * (y1 - y0) / 2)
    return out, area
