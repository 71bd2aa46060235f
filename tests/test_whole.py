"""Queries over planted tables that are larger or longer than the given ones."""

from furrow.plans import catalog


def planted(spark, folder, table, rows, columns):
    spark.createDataFrame(rows, columns).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_spatial_order_of_all_fields(spark, tmp_path):
    d = planted(spark, tmp_path, "supplier", [(i,) for i in range(1, 1201)], "s_suppkey long")
    regions = []
    for i in range(1, 1201):
        kind, w, h = i % 3, 60 + i * 37 % 120, 80 + i * 53 % 160
        a, b, c = w // 3, h // 3, w // 2
        found = [(0, 0, w, h)] if kind == 0 else [(0, 0, w, h // 2), (0, h // 2, c, h)] if kind == 1 else [(0, 0, w, b), (0, b, a, 2 * b), (2 * a, b, w, 2 * b), (0, 2 * b, w, h)]
        regions += [(x0, y0, -(x1 - x0) * (y1 - y0), i, k) for k, (x0, y0, x1, y1) in enumerate(found, 1)]
    truth = {(r[3], r[4]): k for k, r in enumerate(sorted(regions), 1)}
    assert {(r.field_id, r.region_id): r.place for r in catalog.queries()["geo_spatial_order"](spark, d).collect()} == truth


def test_samples_of_a_long_track(spark, tmp_path):
    d = planted(spark, tmp_path, "events", [(7, i, i, "view" if i % 3 else "purchase") for i in range(900)], "user_id long, ts long, event_id long, event_type string")
    at = [(i * 7919 % 101, i * 104729 % 97) for i in range(900)]
    total = sum(abs(a - c) + abs(b - e) for (a, b), (c, e) in zip(at, at[1:]))
    blocks = sorted(catalog.queries()["win_local_speed_blocks"](spark, d).collect(), key=lambda r: r.block)
    assert total > 20_000 and blocks[0].start_m == 0 and blocks[-1].end_m == -(-total // 25) * 25
    assert all(a.end_m == b.start_m and a.slow != b.slow for a, b in zip(blocks, blocks[1:]))


def test_samples_of_a_long_chain(spark, tmp_path):
    rows = [(3, i, 1, 1, 0, 1.0, 50.0, "A") for i in range(100)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate int, l_extendedprice double, l_quantity double, l_returnflag string"
    d = planted(spark, tmp_path, "lineitem", rows, columns)
    got = {r.sample: (r.sequence, r.share) for r in catalog.queries()["joi_asof_samples"](spark, d).collect()}
    assert got == {k: (40 * k // 50 + 1, 40 * k % 50 / 50) for k in range(125)}
