"""Widths of ways: through an arm of a turned L, on the wider side of a hole, and where there is none."""

import math

from furrow.operators import bottlenecks as B


def ring(points, angle=0.0):
    c, s = math.cos(angle), math.sin(angle)
    p = [(x * c - y * s, x * s + y * c) for x, y in points]
    return [(*a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True)]


def box(x0, y0, x1, y1, angle=0.0):
    return ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], angle)


def test_widths_of_turned_areas(spark):
    t = 0.4
    table = lambda *rows: spark.createDataFrame([(k, *e) for k, edges in rows for e in edges], "f long, ax double, ay double, bx double, by double")
    hole = [(c, d, a, b) for a, b, c, d in box(7, 10, 20, 20, t)]
    areas = table((1, ring([(0, 0), (30, 0), (30, 20), (11.5, 20), (11.5, 40), (0, 40)], t)), (2, box(0, 0, 30, 30, t) + hole), (3, box(0, 0, 4, 4) + box(6, 0, 10, 4)))
    first = table((1, box(0, 0, 30, 20, t)), (2, box(0, 0, 30, 10, t)), (3, box(0, 0, 4, 4)))
    second = table((1, box(0, 20, 11.5, 40, t)), (2, box(0, 20, 30, 30, t)), (3, box(6, 0, 10, 4)), (4, box(0, 0, 1, 1)))
    got = {r["f"]: r["width"] for r in B.bottleneck_widths(areas, first, second, ["f"], clearance=0.5, precision=0.02, ways=31).collect()}
    # an arm of 11.5, and 10 beside the hole, each with the clearance of both sides
    assert set(got) == {1, 2, 3} and got[3] == 0.0
    assert 12.5 - 0.04 <= got[1] <= 12.5 + 1e-6 and 11.0 - 0.04 <= got[2] <= 11.0 + 1e-6
