"""Faces of regions cut by lines: areas, borders and holes against closed forms and counts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import faces as S
from furrow.operators import overlay as O
from furrow.operators import rings as R
from tests.test_overlay import box, edges_of, inside, star, turned


def lines_of(spark, rows):
    return spark.createDataFrame([(f, *map(float, r)) for f, *r in rows], "field_id long, ax double, ay double, bx double, by double")


def areas(faces):
    out = {}
    for r in S.face_measures(faces).collect():
        out.setdefault(r.field_id, []).append(round(r.area, 4))
    return {k: sorted(v) for k, v in out.items()}


def test_boxes_cut_by_chords(spark):
    """No chord, one, two that cross, one that ends inside, one outside, one along the border, a T."""
    b = [box(0, 0, 10, 6)]
    region = edges_of(spark, *[b] * 7)
    lines = lines_of(spark, [(1, 4, -1, 4, 7), (2, 4, -1, 4, 7), (2, -1, 2, 11, 2), (3, 4, -1, 4, 3), (4, 20, 0, 20, 6), (5, 0, 0, 10, 0), (6, 4, 0, 4, 6), (6, 4, 3, 10, 3)])
    faces = S.subdivided(region, lines)
    assert areas(faces) == {0: [60], 1: [24, 36], 2: [8, 12, 16, 24], 3: [60], 4: [60], 5: [60], 6: [18, 18, 24]}
    borders = {(r.field_id, round(r.length, 6)) for r in S.shared_borders(faces).collect()}
    assert borders == {(1, 6), (2, 2), (2, 4), (2, 6), (6, 3), (6, 6)}
    assert S.subdivided(region.limit(0), lines.limit(0)).count() == 0


def test_holes_belong_to_their_faces(spark):
    """Two holes in one part, an island in a hole, a hole that a chord meets, all turned."""
    shape = [box(0, 0, 60, 40), box(10, 10, 20, 20), box(30, 10, 50, 30)]
    rows = [(0, 0, r, i, *p) for r, ring in enumerate(shape) for i, p in enumerate(turned(ring, 0.3))]
    rows += [(0, 1, 0, i, *p) for i, p in enumerate(turned(box(35, 15, 45, 25), 0.3))]
    rows += [(1, 0, r, i, *p) for r, ring in enumerate(shape) for i, p in enumerate(turned(ring, 0.3))]
    region = R.edges_of(spark.createDataFrame(rows, "field_id long, part int, ring int, i int, x double, y double"), ("field_id", "part", "ring"))
    (ax, ay), (bx, by) = turned([(15, -5), (15, 45)], 0.3)
    faces = S.subdivided(region, lines_of(spark, [(1, ax, ay, bx, by)]))
    assert areas(faces) == {0: [100, 2400 - 100 - 400], 1: [15 * 40 - 50, 45 * 40 - 50 - 400]}


def crossings(lines):
    """Points at which pairs of segments cross."""
    out = []
    for k, (a, b, c, d) in enumerate(lines):
        for e, f, g, h in lines[:k]:
            det = (c - a) * (h - f) - (d - b) * (g - e)
            t, u = ((e - a) * (h - f) - (f - b) * (g - e)) / det, ((e - a) * (d - b) - (f - b) * (c - a)) / det
            if 0 < t < 1 and 0 < u < 1:
                out.append((a + t * (c - a), b + t * (d - b)))
    return out


def test_random_lines_cut_as_many_faces_as_euler_says(spark):
    """A star and chords through it: one face, one more for each piece of a chord inside and for each crossing inside."""
    rng = random.Random(4)
    ring = star(rng, 40, 20, 45)
    around = lambda: (60 * math.cos(t := rng.uniform(0, math.tau)), 60 * math.sin(t))
    chords = [(*around(), *around()) for _ in range(14)]
    region = edges_of(spark, [ring])
    faces = S.subdivided(region, lines_of(spark, [(0, *c) for c in chords]))
    got = areas(faces)[0]
    sides = [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    pieces = sum(len(crossings([c, s])) for c in chords for s in sides) // 2
    met = crossings(chords)
    x, y = np.array([p[0] for p in met]), np.array([p[1] for p in met])
    assert len(got) == 1 + pieces + int(inside([ring], x, y).sum())
    assert sum(got) == pytest.approx(O.measures(region).first().area, abs=1e-2)


def test_long_boundary_takes_few_rounds(spark):
    ring = [(math.cos(k / 3000 * math.tau) * 500, math.sin(k / 3000 * math.tau) * 500) for k in range(3000)]
    faces = S.subdivided(edges_of(spark, [ring]), lines_of(spark, [(0, -600, 1, 600, 1)]))
    got = areas(faces)[0]
    assert len(got) == 2 and sum(got) == pytest.approx(3000 / 2 * 500 * 500 * math.sin(math.tau / 3000), rel=1e-9)


def test_parts_of_a_result(spark):
    """An inset that falls apart gives two parts; the union of touching boxes one."""
    bell = [(0, 0), (20, 0), (20, 8), (30, 8), (30, 0), (50, 0), (50, 20), (30, 20), (30, 12), (20, 12), (20, 20), (0, 20)]
    left = O.inset(edges_of(spark, [bell], [box(0, 0, 10, 10)]), O.rectangle(3, 3))
    assert {k: len(v) for k, v in areas(S.parts_of(left)).items()} == {0: 2, 1: 1}
    both = O.overlaid(edges_of(spark, [box(0, 0, 10, 10)]), edges_of(spark, [box(10, 5, 20, 15)]), O.UNION)
    assert areas(S.parts_of(both)) == {0: [200]}
    assert S.parts_of(both).agg(F.countDistinct("face")).first()[0] == 1
