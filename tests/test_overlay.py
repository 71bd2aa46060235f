"""Overlay, offset and cover of polygons against closed forms and against sums over fine grids."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import overlay as O
from furrow.operators import rings as R
from furrow.operators.graph import shared_folder
from furrow.plans import areal

STEP = 0.25


def rings_of(spark, *shapes):
    rows = [(f, r, i, float(x), float(y)) for f, shape in enumerate(shapes) for r, ring in enumerate(shape) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "field_id long, ring int, i int, x double, y double")


def edges_of(spark, *shapes):
    return R.edges_of(rings_of(spark, *shapes))


def turned(ring, angle, dx=0.0, dy=0.0):
    c, s = math.cos(angle), math.sin(angle)
    return [(x * c - y * s + dx, x * s + y * c + dy) for x, y in ring]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def star(rng, points, low, high, dx=0.0, dy=0.0):
    return [(dx + math.cos(k / points * math.tau) * (r := rng.uniform(low, high)), dy + math.sin(k / points * math.tau) * r) for k in range(points)]


def inside(rings, x, y):
    """Even-odd over a grid of points."""
    out = np.zeros(x.shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                out ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
    return out


@pytest.mark.parametrize("angle", [0.0, 0.7, math.pi / 2])
def test_boxes(spark, angle):
    """Boxes that cross, touch along an edge, lie inside, are equal, are apart, and one with a hole."""
    a = [turned(box(0, 0, 10, 6), angle)]
    others = [box(4, 2, 14, 9), box(10, 0, 20, 6), box(2, 2, 4, 4), box(0, 0, 10, 6), box(30, 0, 31, 1)]
    want = [(24, 60 + 70 - 24), (0, 120), (4, 60), (60, 60), (0, 61)]
    got = {r.field_id: r for r in O.overlay_areas(edges_of(spark, *[a] * 6), edges_of(spark, *[[turned(o, angle)] for o in others], [turned(box(-1, -1, 11, 7), angle), turned(box(2, 1, 8, 5), angle)])).collect()}
    for k, (both, either) in enumerate(want):
        assert (got[k].both, got[k].either) == pytest.approx((both, either), abs=1e-4)
        assert got[k].only_a == pytest.approx(60 - both, abs=1e-4) and got[k].area_a == pytest.approx(60, abs=1e-4)
    assert (got[5].both, got[5].only_a, got[5].only_b) == pytest.approx((36, 24, 36), abs=1e-4)


def test_random_stars_against_a_grid(spark):
    rng = random.Random(3)
    a = [[star(rng, 24, 10, 40)] for _ in range(4)]
    b = [[star(rng, 31, 10, 40, 9, -4), star(rng, 9, 2, 5, 9, -4)] for _ in range(4)]
    got = {r.field_id: r for r in O.overlay_areas(edges_of(spark, *a), edges_of(spark, *b)).collect()}
    x, y = np.meshgrid(np.arange(-60, 60, 0.1) + 0.05, np.arange(-60, 60, 0.1) + 0.05)
    for k in range(4):
        p, q = inside(a[k], x, y), inside(b[k], x, y)
        for name, cells in (("both", p & q), ("either", p | q), ("only_a", p & ~q), ("only_b", q & ~p)):
            assert getattr(got[k], name) == pytest.approx(cells.sum() * 0.01, rel=0.01, abs=2)
        assert got[k].both + got[k].only_a == pytest.approx(got[k].area_a, abs=1e-3)
        assert got[k].either == pytest.approx(got[k].area_a + got[k].area_b - got[k].both, abs=1e-3)


def test_union_of_many_and_their_repeats(spark):
    """Thirty overlapping boxes of one key: the area covered once or more, and twice or more."""
    rng = random.Random(8)
    boxes = [turned(box(0, 0, rng.uniform(3, 20), rng.uniform(3, 20)), rng.uniform(0, 3), rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(30)]
    rows = [(0, k, 0, i, x, y) for k, ring in enumerate(boxes) for i, (x, y) in enumerate(ring)]
    edges = R.edges_of(spark.createDataFrame(rows, "field_id long, part int, ring int, i int, x double, y double"), ("field_id", "part", "ring"))
    found = O.arranged(edges)
    x, y = np.meshgrid(np.arange(-30, 90, 0.1) + 0.05, np.arange(-30, 90, 0.1) + 0.05)
    covered = sum(inside([b], x, y).astype(int) for b in boxes)
    for least in (1, 2, 3):
        area = O.measures(O.bounding(found, f"{{a}} >= {least}")).first()
        assert (area.area if area else 0) == pytest.approx((covered >= least).sum() * 0.01, rel=0.01, abs=1)


def test_insets_of_closed_forms(spark):
    """Box, L and box with a hole, turned: area and perimeter of what is left; a field that falls apart; one that vanishes."""
    ell = [(0, 0), (40, 0), (40, 20), (20, 20), (20, 50), (0, 50)]
    bell = [*box(0, 0, 20, 20)[:2], (20, 8), (30, 8), (30, 0), (50, 0), (50, 20), (30, 20), (30, 12), (20, 12), (20, 20), (0, 20)]
    shapes = [[box(0, 0, 40, 30)], [ell], [box(0, 0, 60, 60), box(20, 20, 40, 40)], [bell], [box(0, 0, 5, 5)]]
    angle, d = 0.6, 3.0
    edges = edges_of(spark, *[[turned(r, angle) for r in s] for s in shapes])
    got = {r.field_id: r for r in O.measures(O.inset(edges, d, quarter=64)).collect()}
    assert (got[0].area, got[0].perimeter) == pytest.approx((34 * 24, 116), abs=1e-3)
    # at the notch the boundary is an arc of a quarter of a circle
    assert got[1].area == pytest.approx(34 * 14 + 14 * 30 + (9 - math.pi * 9 / 4), abs=0.01)
    assert got[2].area == pytest.approx(54 * 54 - (20 * 20 + 4 * 20 * d + math.pi * d * d), abs=0.02)
    # two squares, each with a bulge into the passage's mouth, between the circles about its corners
    mouth = 2 * (6 - (math.sqrt(5) + 4.5 * math.asin(2 / 3)))
    assert got[3].area == pytest.approx(2 * (14 * 14 + mouth), abs=0.01)
    assert 4 not in got
    square = {r.field_id: r for r in O.measures(O.inset(edges, O.rectangle(d, d, math.degrees(angle)))).collect()}
    assert square[1].area == pytest.approx(34 * 14 + 14 * 30, abs=1e-3)
    assert square[2].area == pytest.approx(54 * 54 - 26 * 26, abs=1e-3)


def test_outsets_and_directions(spark):
    angle = 0.4
    edges = edges_of(spark, [turned(box(0, 0, 40, 30), angle)], [turned(box(0, 0, 40, 30), angle), turned(box(18, 13, 22, 17), angle)])
    got = {r.field_id: r for r in O.measures(O.outset(edges, 2.0, quarter=64)).collect()}
    assert got[0].area == pytest.approx(1200 + 140 * 2 + math.pi * 4, abs=0.01)
    assert got[1].area == pytest.approx(got[0].area, abs=0.01), "the hole closes"
    far = O.measures(O.directional(edges.where("field_id = 0"), math.degrees(angle), 6, 1, False, quarter=64)).first()
    assert far.area == pytest.approx(1200 + 2 * 40 * 1 + 2 * 30 * 6 + math.pi * 6, abs=0.02)
    near = O.measures(O.directional(edges.where("field_id = 0"), math.degrees(angle), 6, 1, True)).first()
    assert near.area == pytest.approx(28 * 28, abs=1e-3)
    grown = O.measures(O.outset(edges.where("field_id = 0"), O.rectangle(3, 2, math.degrees(angle)))).first()
    assert grown.area == pytest.approx(46 * 34, abs=1e-3)


def test_inset_of_a_star_against_a_grid(spark):
    rng = random.Random(5)
    ring = star(rng, 16, 15, 40)
    got = O.measures(O.inset(edges_of(spark, [ring]), 4.0)).first().area
    step = 0.2
    x, y = np.meshgrid(np.arange(-45, 45, step), np.arange(-45, 45, step))
    far = np.full(x.shape, np.inf)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        far = np.minimum(far, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    assert got == pytest.approx((inside([ring], x, y) & (far >= 4)).sum() * step * step, rel=0.01)


def test_results_are_operands(spark):
    """Union, then inset, then difference: edges of results have the inside on the left."""
    a, b = edges_of(spark, [box(0, 0, 10, 10)]), edges_of(spark, [box(10, 0, 20, 10)])
    whole = O.overlaid(a, b, O.UNION)
    assert O.measures(whole).first().perimeter == pytest.approx(60, abs=1e-6)
    inner = O.inset(whole, O.rectangle(1, 1))
    rim = O.measures(O.overlaid(whole, inner, O.DIFFERENCE)).first()
    assert rim.area == pytest.approx(200 - 18 * 8, abs=1e-6)


def test_covers_and_empty_tables(spark):
    a = edges_of(spark, [box(0, 0, 10, 10)], [box(0, 0, 10, 10), box(4, 4, 6, 6)])
    b = edges_of(spark, [box(1, 1, 9, 9)], [box(1, 1, 9, 9)], [box(0, 0, 1, 1)])
    got = {r.field_id: (r.covered, round(r.outside, 6)) for r in O.covers(a, b).collect()}
    assert got == {0: (True, 0), 1: (False, 4), 2: (False, 1)}
    assert O.overlay_areas(a.limit(0), b.limit(0)).count() == 0
    broken = a.withColumn("bx", F.when(F.col("i") == 0, F.lit(float("nan"))).otherwise(F.col("bx")))
    assert O.overlay_areas(broken.where("i = 0"), b.limit(0)).count() == 0


def test_many_short_edges_and_one_long(spark):
    """Ten thousand edges of a traced side and one straight one: work follows the edges, not their boxes."""
    n = 10_000
    ring = [(k * 0.5, 300 + math.sin(k / 40) * 20) for k in range(n)][::-1] + [(0.0, 0.0), (n * 0.5 - 0.5, 150.0)]
    edges = edges_of(spark, [ring])
    cells = O.dealt(O.snapped(edges, ("field_id",), 1e-6).join(O.cell_widths(O.snapped(edges, ("field_id",), 1e-6), ("field_id",)), "field_id")).count()
    assert cells < 6 * n
    area = abs(sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))) / 2
    got = O.overlay_areas(edges, edges_of(spark, [box(-10, -100, 5100, 310)])).first()
    assert got.area_a == pytest.approx(area, rel=1e-9) and got.both + got.only_a == pytest.approx(area, rel=1e-9)


def test_few_edges_are_one_cell(spark, monkeypatch):
    """Edges of a small key are dealt once, far from the origin too; many cells give the same areas."""
    rng = random.Random(5)
    a, b = [[star(rng, 7, 10, 40, 4e5, 5e6)] for _ in range(6)], [[star(rng, 8, 10, 40, 4e5 + 9, 5e6 - 4)] for _ in range(6)]
    one = lambda shapes: edges_of(spark, *shapes)
    edges = O.snapped(one(a), O.FIELD, O.UNIT)
    dealt = lambda: O.dealt(edges.join(O.cell_widths(edges, O.FIELD), "field_id")).count()
    areas = lambda: {r.field_id: tuple(r)[1:] for r in O.overlay_areas(one(a), one(b)).collect()}
    assert dealt() == edges.count()
    found = areas()
    monkeypatch.setattr(O, "FEW", 0)
    assert dealt() > edges.count()
    for k, v in areas().items():
        assert v == pytest.approx(found[k], abs=1e-3)


def test_steps_leave_one_table(spark):
    """Of the tables that an overlay writes, its result stays."""
    folder = shared_folder(spark).removeprefix("file:")
    a, b = edges_of(spark, [box(0, 0, 9, 9)]), edges_of(spark, [box(3, 3, 12, 12)])
    before = set(os.listdir(folder))
    out = O.overlaid(a, b, O.UNION)
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and out.inputFiles()[0].split("/")[-2] in new
    assert O.measures(out).first().area == pytest.approx(126, abs=1e-6)


def test_strips_are_dealt_out_before_they_become_edges(spark, small):
    """A supplier table of one small file makes its strips in many tasks."""
    assert areal._strips(spark, small).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
