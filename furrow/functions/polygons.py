"""Small numpy helpers for one shape at a time, called from grouped functions."""

from __future__ import annotations

import heapq
import math

import numpy as np


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull by monotone chains."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2)


def least_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """(long side, short side, angle of the long side in [0, 180)) of the least-area rectangle around points."""
    hull, best = convex_hull(points), None
    for d in np.roll(hull, -1, axis=0) - hull:
        a = math.atan2(d[1], d[0])
        turn = np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
        size = np.ptp(hull @ turn.T, axis=0)
        if best is None or size[0] * size[1] < best[0] - 1e-9:
            best = (size[0] * size[1], size, a)
    _, (w, h), a = best
    angle = math.degrees(a if w >= h else a + math.pi / 2) % 180
    return max(w, h), min(w, h), 0.0 if angle > 180 - 1e-9 else angle


def union_area(boxes: np.ndarray) -> float:
    """Area of the union of boxes (x0, y0, x1, y1), by a sweep over x."""
    total, edges = 0.0, np.unique(boxes[:, [0, 2]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        live = boxes[(boxes[:, 0] < b) & (boxes[:, 2] > a)]
        end, length = -math.inf, 0.0
        for lo, hi in sorted(map(tuple, live[:, [1, 3]].tolist())):
            length += max(0.0, hi - max(lo, end))
            end = max(end, hi)
        total += (b - a) * length
    return total


def grid_path(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int], budget: int = 150_000) -> tuple[str, float, int]:
    """(status, length, expanded nodes) of the shortest 8-neighbour path without corner cutting, by A*."""
    h, w = free.shape
    if not (0 <= start[0] < h and 0 <= start[1] < w and 0 <= goal[0] < h and 0 <= goal[1] < w and free[start] and free[goal]):
        return "ENDPOINT_OUTSIDE", math.nan, 0
    far = lambda p: math.hypot(p[0] - goal[0], p[1] - goal[1])
    cost, heap, done = {start: 0.0}, [(far(start), start)], set()
    while heap:
        _, p = heapq.heappop(heap)
        if p in done:
            continue
        if p == goal:
            return "FOUND", cost[p], len(done)
        if len(done) >= budget:
            return "SEARCH_LIMITED", math.nan, len(done)
        done.add(p)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                q = (p[0] + dy, p[1] + dx)
                if q == p or not (0 <= q[0] < h and 0 <= q[1] < w) or not free[q] or not free[p[0] + dy, p[1]] or not free[p[0], p[1] + dx]:
                    continue
                c = cost[p] + math.hypot(dy, dx)
                if c < cost.get(q, math.inf) - 1e-12:
                    cost[q] = c
                    heapq.heappush(heap, (c + far(q), q))
    return "GEOMETRICALLY_DISCONNECTED", math.nan, len(done)
