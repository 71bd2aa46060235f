"""Guides inside fields against closed forms and a plain search over samples."""

import heapq
import math
import random

import pytest

from furrow.operators import guides as G
from tests.test_overlay import box, edges_of, inside, turned


def ways_of(spark, rows):
    return spark.createDataFrame([(f, w, *map(float, r)) for f, w, *r in rows], "field_id long, way long, x0 double, y0 double, x1 double, y1 double")


def test_ways_of_closed_forms(spark):
    """Straight, round a notch, round a hole, along the border, into the hole, and out of the field."""
    ell = [(0, 0), (40, 0), (40, 20), (20, 20), (20, 50), (0, 50)]
    a = 0.6
    edges = edges_of(spark, [turned(ell, a)], [turned(box(0, 0, 60, 40), a), turned(box(20, 10, 40, 30), a)])
    at = lambda *p: [c for x, y in zip(p[::2], p[1::2]) for c in turned([(x, y)], a)[0]]
    rows = [(0, 1, *at(5, 5, 35, 15)), (0, 2, *at(39, 19, 19, 49)), (1, 1, *at(10, 18, 50, 18)), (1, 2, *at(10, 20, 30, 20)), (1, 3, *at(0, 0, 60, 0)), (0, 3, *at(1, 1, 60, 60)), (1, 4, *at(5, 5, 5, 35))]
    got = {(r.field_id, r.way): (r.length, r.bends) for r in G.guides(edges, ways_of(spark, rows)).collect()}
    assert got[0, 1] == (pytest.approx(math.hypot(30, 10)), 0)
    assert got[0, 2] == (pytest.approx(math.hypot(19, 1) + math.hypot(1, 29)), 1)
    assert got[1, 1] == (pytest.approx(2 * math.hypot(10, 8) + 20), 2)
    assert got[1, 3] == (pytest.approx(60), 0) and got[1, 4] == (pytest.approx(30), 0)
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 3), (1, 4)}
    assert G.guides(edges.limit(0), ways_of(spark, rows)).count() == 0


def test_lengths_keep_the_digits_of_their_nodes(spark):
    """Places that no grid holds: a way round a hole whose length ends just above a half of its fourth digit."""
    w, h, w3, h3 = 71, 179, 23, 59
    turn = lambda *points: [(x * 8 / 17 - y * 15 / 17, x * 15 / 17 + y * 8 / 17) for x, y in points]
    edges = edges_of(spark, [turn(*box(0, 0, w, h)), turn(*box(w3, h3, 2 * w3, 2 * h3))])
    ends = [c for p in turn((w3 / 2, h3 * 1.25), (w3 * 2.5, h3 * 1.25)) for c in p]
    (got,) = G.guides(edges, ways_of(spark, [(0, 1, *ends)])).collect()
    exact = w3 + 2 * math.hypot(w3 / 2, h3 / 4)
    assert abs(got.length - exact) < 1e-10 and round(got.length, 4) == round(exact, 4) and got.bends == 2


def test_several_holes_against_a_plain_search(spark):
    rng = random.Random(5)
    holes = [turned(box(-d, -d, d, d), rng.uniform(0, 1.5), x, y) for x in (20, 45, 70) for y in (15, 40) for d in (rng.uniform(5, 8),)]
    field = [box(0, 0, 90, 55), *holes]
    ends = [(2, 2, 88, 53), (2, 50, 88, 4), (33, 1, 57, 54)]
    got = {r.way: r.length for r in G.guides(edges_of(spark, field), ways_of(spark, [(0, k, *e) for k, e in enumerate(ends)])).collect()}
    import numpy as np

    def sees(p, q):
        t = np.linspace(0, 1, 400)
        x, y = p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t
        # a little inside the holes only
        return not any(inside([[(cx + (hx - cx) * 0.995, cy + (hy - cy) * 0.995) for hx, hy in h]], x, y).any() for h in holes for cx, cy in [(sum(v[0] for v in h) / 4, sum(v[1] for v in h) / 4)])

    for k, (x0, y0, x1, y1) in enumerate(ends):
        nodes = [(x0, y0), (x1, y1), *(v for h in holes for v in h)]
        best, queue = {0: 0.0}, [(0.0, 0)]
        while queue:
            d, i = heapq.heappop(queue)
            if d > best[i]:
                continue
            for j, p in enumerate(nodes):
                if j != i and (e := d + math.dist(nodes[i], p)) < best.get(j, 1e9) and sees(nodes[i], p):
                    best[j] = e
                    heapq.heappush(queue, (e, j))
        assert got[k] == pytest.approx(best[1], rel=1e-6)
