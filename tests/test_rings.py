"""Polygons in general position, scenes and exchange formats."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.operators import rings as R
from furrow.sources import scene, store
from furrow.sources.geopackage import layer_vertices, points_of


def rings_of(spark, *shapes):
    """Vertices of fields, each a list of rings of points."""
    rows = [(f, r, i, float(x), float(y)) for f, shape in enumerate(shapes) for r, ring in enumerate(shape) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "field_id long, ring int, i int, x double, y double")


BOX = [(0, 0), (100, 0), (100, 160), (0, 160)]
NOTCHED = [(0, 0), (140, 0), (140, 65), (80, 65), (80, 160), (0, 160)]
HOLED = [[(0, 0), (140, 0), (140, 160), (0, 160)], [(50, 55), (90, 55), (90, 105), (50, 105)]]


def test_status_of_polygons(spark):
    bow = [(0, 0), (10, 10), (10, 0), (0, 10)]
    shapes = [[BOX], [NOTCHED[::-1]], HOLED, [bow], [[(0, 0), (5, 5), (10, 10)]], [[(0, 0), (float("nan"), 1), (3, 3)]]]
    got = {r.field_id: (r.status, r.area and round(r.area, 6)) for r in R.polygon_status(rings_of(spark, *shapes)).collect()}
    assert got[0] == ("VALID", 16000) and got[1] == ("VALID", 16700) and got[2] == ("VALID", 20400)
    assert got[3][0] == "SELF_CROSSING" and got[4][0] == "NO_AREA" and got[5][0] == "NOT_FINITE"
    assert R.polygon_status(rings_of(spark, [BOX]).limit(0)).count() == 0


def test_status_of_parts_holes_and_touching_rings(spark):
    """Rings that touch themselves or run along each other, holes outside or nested, parts apart, overlapping or crossing."""
    box = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    pinched = [(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)]
    eight = [(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10)]
    shapes = {
        "RING_TOUCH": [[[pinched]], [[eight]]], "MISPLACED": [[[box(0, 0, 10), box(20, 0, 5)]], [[box(0, 0, 30), box(5, 5, 10), box(7, 7, 2)]], [[box(0, 0, 30)], [box(5, 5, 10)]]],
        "EDGE_OVERLAP": [[[box(0, 0, 10), box(0, 2, 5)]], [[box(0, 0, 10)], [box(10, 0, 10)]]], "SELF_CROSSING": [[[box(0, 0, 10)], [box(5, 5, 10)]], [[box(0, 0, 10), box(5, 5, 10)]]],
        "VALID": [[[box(0, 0, 10)], [box(20, 0, 10)]], [[box(0, 0, 10)], [box(10, 10, 10)]], [[box(0, 0, 20), [(0, 5), (5, 2), (5, 8)]]], [[box(0, 0, 30), box(5, 5, 20)], [box(8, 8, 4)]]],
    }
    rows, want = [], {}
    for status, some in shapes.items():
        for shape in some:
            f = len(want)
            want[f] = status
            rows += [(f, p, r, i, float(x), float(y)) for p, rings in enumerate(shape) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]
    df = spark.createDataFrame(rows, "field_id long, part int, ring int, i int, x double, y double")
    assert {r.field_id: r.status for r in R.polygon_status(df).collect()} == want


def test_contacts_follow_edges(spark):
    """A thousand short edges and a long diagonal one: cells along the edges, one crossing."""
    ring = [(k * 0.1, 100 + 5 * math.sin(k)) for k in range(1000)] + [(100.0, 0.0), (0.0, 0.0)]
    zigzag = [(0.0, 0.0), (100.0, 90.0), (100.0, 0.0), (50.0, 80.0)]
    df = rings_of(spark, [ring[::-1]], [zigzag])
    got = {r.field_id: r.n_crossings for r in R.edge_contacts(R.edges_of(df)).collect()}
    assert got.get(0, 0) == 0 and got[1] == 1


def test_spikes(spark):
    spiked = [(0, 0), (100, 0), (130, 0), (100, 0), (100, 160), (100, 190), (100, 160), (0, 160)]
    clean = R.without_spikes(rings_of(spark, [spiked], [BOX]))
    assert {(r.field_id, r.n) for r in clean.groupBy("field_id").agg(F.count("*").alias("n")).collect()} == {(0, 4), (1, 4)}
    assert {r.area for r in R.polygon_status(clean).collect()} == {16000.0}


def test_irregular_polygon_against_samples(spark):
    """A star of random radii: areas of strips and half planes, and points, against plain loops."""
    rng = random.Random(9)
    star = [(round(math.cos(k / 20 * math.tau) * (rad := rng.uniform(30, 90)), 3), round(math.sin(k / 20 * math.tau) * rad, 3)) for k in range(20)]
    edges = R.edges_of(rings_of(spark, [star]))
    angle = 0.7
    framed = R.in_frame(edges, F.lit(angle))
    area = sum(a * d - c * b for (a, b), (c, d) in zip(star, star[1:] + star[:1])) / 2
    strips = R.strip_areas(framed, 5.0).collect()
    assert sum(r.area for r in strips) == pytest.approx(area) and all(r.area >= 0 for r in strips)
    cuts = spark.createDataFrame([(0, 1, 3.0)], "field_id long, cut int, level double")
    half = R.half_plane_areas(framed, cuts).first()
    assert half.below + half.above == pytest.approx(area)
    # lines every 0.05 m integrate to the same area
    lines = R.parallel_segments(framed, 0.05, 0.025).agg(F.sum(F.col("u1") - F.col("u0")).alias("l")).first().l
    assert lines * 0.05 == pytest.approx(area, rel=1e-3)
    points = [(k, rng.uniform(-90, 90), rng.uniform(-90, 90)) for k in range(300)]

    def inside(x, y):
        return sum(((b > y) != (d > y)) and x < a + (y - b) / (d - b) * (c - a) for (a, b), (c, d) in zip(star, star[1:] + star[:1])) % 2 == 1

    df = spark.createDataFrame([(0, *p) for p in points] + [(5, 900, 0.0, 0.0)], "field_id long, k int, x double, y double")
    got = {r.k: r.inside for r in R.points_inside(df, edges, ["k"]).collect()}
    assert all(got[k] == inside(x, y) for k, x, y in points) and got[900] is False


def test_column_rules(spark):
    df = spark.createDataFrame([(10.0, 10.0, 0.0, math.pi / 2)], "dx double, dy double, a double, b double")
    r = df.select(
        C.gentle_radius(F.col("dx"), F.col("dy"), F.col("a"), F.col("b"), 0.15, 1.0).alias("g"), C.gentle_radius(F.col("dx"), F.col("dy"), F.col("a"), F.col("a"), 0.15, 1.0).alias("none"),
        C.same_crs(F.lit("LOCAL_METRIC"), F.lit("LOCAL_CS[x]")).alias("c"), C.same_crs(F.lit("EPSG:1"), F.lit("EPSG:2")).alias("d"),
        C.terminal_shape(F.lit(0.03), F.lit(1), F.lit(0), F.lit(1.3)).alias("t"), C.terminal_shape(F.lit(0.2), F.lit(0), F.lit(0), F.lit(1.0)).alias("u"),
        C.transfer_class(F.lit(4), F.lit(2), F.lit(6.1)).alias("x"), C.transfer_class(F.lit(5), F.lit(2), F.lit(1.0)).alias("y"),
        C.stage_status(F.lit(2), F.lit(2), F.lit(True), F.lit(False)).alias("s"),
    ).first()
    assert r.g * math.tan(math.pi / 4) + 1 / (0.3 * r.g) == pytest.approx(10) and r.none is None
    assert r.c and not r.d and r.t and not r.u and r.x == "BLOCK_TRANSFER" and r.y is None and r.s == "SWATHS_PARTIAL"


def test_scenes(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[*map(list, BOX), list(BOX[0])], [[10, 10], [30, 10], [30, 30], [10, 30], [10, 10]]]}
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text(json.dumps({"name": "a", "crs": "EPSG:32650", "target": shape, "start": [1, 2, 0], "vehicle": {"working_width_m": 3.75}}))
    (tmp_path / "good" / "b.json").write_text(json.dumps({"name": "b", "crs": "LOCAL_METRIC", "target": {"type": "MultiPolygon", "coordinates": [shape["coordinates"], shape["coordinates"][:1]]}, "obstacles": shape}))
    got = scene.scene_vertices(scene.read_scenes(spark, str(tmp_path / "good")))
    counts = {(r.scene, r.layer): r.n for r in got.groupBy("scene", "layer").agg(F.count("*").alias("n")).collect()}
    assert counts == {("a.json", "target"): 8, ("a.json", "travel"): 8, ("b.json", "target"): 12, ("b.json", "travel"): 12, ("b.json", "obstacles"): 8}
    for k, (bad, why) in enumerate([({"name": "x", "crs": "EPSG:1", "target": shape, "colour": 1}, "unknown keys: colour"), ({"crs": "EPSG:1"}, "target is missing"), ({"crs": "EPSG:4326", "target": shape}, "not metric")]):
        (tmp_path / f"bad{k}").mkdir()
        (tmp_path / f"bad{k}" / "s.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match=why):
            scene.read_scenes(spark, str(tmp_path / f"bad{k}")).collect()


def polygon_wkb(rings):
    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        closed = [*r, r[0]]
        out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed)
    return out


def test_vertices_of_layers(spark):
    several = struct.pack("<BII", 1, 6, 2) + polygon_wkb(HOLED) + polygon_wkb([BOX])
    assert len(points_of(polygon_wkb(HOLED))) == 8 and points_of(None) == []
    df = spark.createDataFrame([("a", bytearray(several)), ("b", None), ("c", bytearray(polygon_wkb([NOTCHED])))], "fid string, geom binary")
    got = layer_vertices(df, "fid").groupBy("fid", "part", "ring").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {("a", 0, 0, 4), ("a", 0, 1, 4), ("a", 1, 0, 4), ("c", 0, 0, 6)}
    assert layer_vertices(df.where("fid = 'b'"), "fid").count() == 0


def test_text_formats(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5, [[0.0, 1.0], [2.0, 3.0]]), ("8", 2.5, None)], "field_id string, length double, line array<array<double>>")
    store.write_csv(df, str(tmp_path / "c"), ["length", "field_id"])
    back = store.text_records(spark, str(tmp_path / "c"))
    assert back.columns == ["length", "field_id"] and store.rows_of(spark, str(tmp_path / "c"), "007").first().length == "1.5"
    store.write_geojson(store.geojson(df, "LineString", "line", ["length"]), str(tmp_path / "g"))
    found = {r.field_id: json.loads(r.value) for r in spark.read.schema("value string, field_id string").text(str(tmp_path / "g")).collect()}
    assert len(found) == 2 and sum(f["geometry"] is None for f in found.values()) == 1
    store.write_layers(df.drop("line").withColumns({"kind": F.lit("swath"), "crs": F.lit("EPSG:32650")}), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l" / "kind=swath")).count() == 2
    assert store.collected([df.select("field_id"), df.select("field_id", "length")]).count() == 4
