"""Agglomeration against a sequential search in plain Python, on chains, grids and random graphs."""

import random

from pyspark.sql import functions as F

from furrow.operators import merging as M
from tests.test_overlay import box, edges_of


def sequential(areas, borders):
    """One best pair after another by (joint area, -border, lesser ids)."""
    areas, borders, out = dict(areas), dict(borders), []
    while borders:
        a, b = min(borders, key=lambda p: (areas[p[0]] + areas[p[1]], -borders[p], *p))
        out.append((a, b))
        areas[a] += areas.pop(b)
        moved = {}
        for (x, y), length in borders.items():
            x, y = (a if x == b else x), (a if y == b else y)
            if x != y:
                key = (min(x, y), max(x, y))
                moved[key] = moved.get(key, 0) + length
        borders = moved
    return out


def tables(spark, fields):
    regions = [(f, r, float(a)) for f, (areas, _) in fields.items() for r, a in areas.items()]
    borders = [(f, a, b, float(n)) for f, (_, links) in fields.items() for (a, b), n in links.items()]
    return spark.createDataFrame(regions, "field_id long, region long, sum_area double"), spark.createDataFrame(borders, "field_id long, a long, b long, length double")


def joint():
    return F.col("a_sum_area") + F.col("b_sum_area")


def test_one_each_is_the_sequential_search(spark):
    rng = random.Random(3)
    fields = {}
    for f in range(12):
        n = rng.randrange(1, 9)
        links = {(min(a, b), max(a, b)): rng.randrange(1, 5) for a in range(n) for b in rng.sample(range(n), min(2, n)) if a != b}
        fields[f] = ({r: rng.randrange(1, 6) for r in range(n)}, links)
    got = M.agglomerated(*tables(spark, fields), joint(), one_each=True).collect()
    for f, (areas, links) in fields.items():
        assert [(r.kept, r.gone) for r in sorted(got, key=lambda r: r.level) if r.field_id == f] == sequential(areas, links)


def test_a_long_chain_takes_few_rounds(spark):
    """Two thousand equal cells in a row: each round takes a share of them; in the end there is one."""
    n = 2_000
    regions = spark.range(n).select(F.lit(1).cast("long").alias("field_id"), F.col("id").alias("region"), F.lit(1.0).alias("sum_area"))
    borders = spark.range(n - 1).select(F.lit(1).cast("long").alias("field_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("length"))
    got = M.agglomerated(regions, borders, joint())
    assert got.count() == n - 1 and got.agg(F.max("level")).first()[0] <= 30
    assert got.select("gone").distinct().count() == n - 1 and got.where("gone = 0").isEmpty()


def test_mutual_pairs_are_each_others_best(spark):
    fields = {1: ({0: 1, 1: 5, 2: 1, 3: 1, 4: 9}, {(0, 1): 1, (1, 2): 1, (2, 3): 1, (3, 4): 1}), 2: ({0: 1, 1: 1}, {}), 3: ({0: 3}, {})}
    got = sorted((r.field_id, r.level, r.kept, r.gone) for r in M.agglomerated(*tables(spark, fields), joint()).collect())
    # 2+3 is best of both; 0's best is 1, whose best is 0 as soon as 2 has grown
    assert got[0] == (1, 1, 2, 3) and {g[0] for g in got} == {1} and len(got) == 4
    levels = M.assignments(tables(spark, fields)[0], M.agglomerated(*tables(spark, fields), joint()))
    assert levels.where("level = 0").count() == 8
    assert {r.root for r in levels.where("field_id = 1").where(f"level = {max(g[1] for g in got)}").collect()} == {0}


def test_only_wanted_mergers_and_empty_tables(spark):
    fields = {1: ({0: 1, 1: 9, 2: 9, 3: 2}, {(0, 1): 1, (1, 2): 5, (2, 3): 1})}
    small = (F.col("a_sum_area") < 3) | (F.col("b_sum_area") < 3)
    got = M.agglomerated(*tables(spark, fields), joint(), one_each=True, wanted=small, first=F.least("a_sum_area", "b_sum_area")).collect()
    assert [(r.kept, r.gone) for r in sorted(got, key=lambda r: r.level)] == [(0, 1), (2, 3)]
    regions, borders = tables(spark, fields)
    assert M.agglomerated(regions.limit(0), borders.limit(0), joint()).count() == 0


def test_hulls(spark):
    """A box's hull is itself, an L's concavity that of its notch, and a union's hull that of both."""
    ell = [(0, 0), (40, 0), (40, 20), (20, 20), (20, 50), (0, 50)]
    edges = edges_of(spark, [box(3, 4, 13, 9)], [ell])
    got = {r.field_id: r.h for r in M.supports(edges, ["field_id"]).select("field_id", M.hull_area(F.col("far_hull")).alias("h")).collect()}
    assert abs(got[0] - 50) < 1e-9
    hull = 2000 - 20 * 30 / 2
    assert hull <= got[1] < hull * 1.01
    both = M.supports(edges, ["field_id"]).groupBy().agg(F.max_by("far_hull", "field_id").alias("a"), F.min_by("far_hull", "field_id").alias("b"))
    assert both.select(M.hull_area(F.zip_with("a", "b", lambda x, y: F.greatest(x, y))).alias("h")).first().h >= got[1] - 1e-9
