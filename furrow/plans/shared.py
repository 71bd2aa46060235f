"""Queries that both engines read from one text. Floats are rounded to 4 places; ranks are total."""

from __future__ import annotations

SHARED: dict[str, str] = {}


def _(name: str, text: str) -> None:
    SHARED[name] = text


# scans and point reads
_("src_fields", """SELECT field_id, kind, w, h, CAST(w * h - CASE kind WHEN 0 THEN 0 WHEN 1 THEN (w - floor(w / 2)) * (h - floor(h / 2)) ELSE floor(w / 3) * floor(h / 3) END AS BIGINT) AS area FROM {v_fields}""")
_("src_field_slice", """SELECT field_id, sequence, kind, a_x, a_y, b_x, b_y FROM {v_route} WHERE field_id IN (1, 2, 5)""")
_("src_point_lookup", """SELECT l_linenumber, l_partkey, l_suppkey, l_quantity FROM {lineitem} WHERE l_orderkey = 7""")
_("src_duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
_("src_reassembled_fields", """SELECT f.field_id, count(DISTINCT g.region_id) AS n_regions, count(*) AS n_tasks, round(sum(s.x1 - s.x0), 4) AS work_m
    FROM {v_fields} f JOIN {v_regions} g ON g.field_id = f.field_id JOIN {v_swaths} s ON s.field_id = g.field_id AND s.region_id = g.region_id GROUP BY f.field_id""")
_("src_poison_rows", """SELECT field_id, CASE WHEN status = 'FAILED' THEN 'INPUT_REJECTED' WHEN seconds IS NULL OR seconds < 1000 THEN 'INPUT_SUSPECT' ELSE 'OK' END AS input_status FROM {v_status}""")

# filters and predicates
_("fil_finite_numbers", """SELECT c_custkey, c_acctbal, c_acctbal IS NOT NULL AND abs(c_acctbal) < 1E308 AS finite FROM {customer}""")
_("fil_positive_parts", """SELECT field_id, row_index, piece, x1 - x0 AS length FROM {v_segments} WHERE x1 - x0 > 1E-7""")
_("fil_meaningful_components", """SELECT field_id, region_id, area, CAST(row_number() OVER (PARTITION BY field_id ORDER BY x0, y0, -area) AS INT) AS place FROM
    (SELECT field_id, region_id, x0, y0, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, sum(CAST((x1 - x0) * (y1 - y0) AS DOUBLE)) OVER (PARTITION BY field_id) AS whole FROM {v_regions}) q
    WHERE area >= greatest(1E-9 * whole, 600)""")
_("fil_body_pool", """WITH c AS (SELECT l_suppkey AS field_id, l_partkey % 40 AS candidate, sum(l_quantity) AS area, CAST(count(*) AS INT) AS segments, min(l_linestatus) = 'F' AS ok FROM {lineitem} GROUP BY l_suppkey, l_partkey % 40),
    v AS (SELECT *, max(area) OVER (PARTITION BY field_id) AS most FROM c WHERE ok),
    r AS (SELECT *, min(segments) OVER (PARTITION BY field_id) AS least FROM v WHERE area + 1E-8 >= 0.95E0 * most)
    SELECT field_id, candidate, area, segments FROM r WHERE segments = least""")
_("fil_config_ranges", """SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'MISSING' WHEN p_size <= 0 THEN 'NOT_POSITIVE' WHEN p_retailprice > 1500 THEN 'TOO_LARGE' WHEN p_type NOT LIKE '%BRASS%' THEN 'UNKNOWN_KIND' ELSE 'OK' END AS reason FROM {part}""")
_("fil_route_accepted", """SELECT field_id, bool_and(kind = 'WORK' OR (abs(b_x - a_x) <= 200 AND abs(b_y - a_y) <= 4)) AND count(*) >= 3 AS accepted FROM {v_route} GROUP BY field_id""")
_("fil_pose_close", """SELECT chain, i, nx IS NOT NULL AND sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) <= 40 AND abs(dy - 6.283185307179586E0 * floor((dy + 3.141592653589793E0) / 6.283185307179586E0)) <= 1.0E0 AS close FROM
    (SELECT chain, i, x, y, lead(x) OVER (PARTITION BY chain ORDER BY i) AS nx, lead(y) OVER (PARTITION BY chain ORDER BY i) AS ny, lead(yaw) OVER (PARTITION BY chain ORDER BY i) - yaw AS dy FROM {v_track}) q""")

# joins
_("joi_seam_pairs", """WITH p AS (SELECT a.field_id, a.region_id AS region_a, b.region_id AS region_b,
      CAST(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS DOUBLE) AS dx, CAST(greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE) AS dy,
      greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1.875E0) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1.875E0) AS overlap
    FROM {v_regions} a JOIN {v_regions} b ON a.field_id = b.field_id AND a.region_id < b.region_id
      AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
    SELECT field_id, region_a, region_b, dx + dy AS seam_m, round(overlap, 4) AS overlap_m2, round(3.75E0 * 0.3E0 * (dx + dy) + 2 * 3.75E0 * 2.5E0, 4) AS budget_m2,
      CASE WHEN overlap <= 3.75E0 * 0.3E0 * (dx + dy) + 2 * 3.75E0 * 2.5E0 THEN 'PASS' ELSE 'EXCESS_OVERLAP' END AS status FROM p""")
_("joi_task_overlaps", """SELECT a.field_id, a.row_index AS row_a, a.piece AS piece_a, b.row_index AS row_b, b.piece AS piece_b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (3.75E0 - (b.y - a.y)), 4) AS overlap_m2
    FROM {v_segments} a JOIN {v_segments} b ON a.field_id = b.field_id AND b.row_index = a.row_index + 1 AND a.x0 < b.x1 AND b.x0 < a.x1 WHERE b.y - a.y < 3.75E0""")
_("joi_row_links_degree1", """WITH l AS (SELECT a.field_id, a.row_index, a.piece AS piece_a, b.piece AS piece_b, count(*) OVER (PARTITION BY a.field_id, a.row_index, a.piece) AS da,
      count(*) OVER (PARTITION BY b.field_id, b.row_index, b.piece) AS db FROM {v_segments} a JOIN {v_segments} b ON a.field_id = b.field_id AND b.row_index = a.row_index + 1
      AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1E-6)
    SELECT field_id, row_index, piece_a, piece_b FROM l WHERE da = 1 AND db = 1""")
_("joi_corridor_groups", """WITH n AS (SELECT *, count(*) OVER (PARTITION BY field_id, row_index) AS n FROM {v_segments})
    SELECT a.field_id, a.row_index, a.piece AS piece_a, b.piece AS piece_b FROM n a JOIN n b ON a.field_id = b.field_id AND b.row_index = a.row_index + 1 AND a.n = b.n
    WHERE abs(b.y - a.y) <= 1.6E0 * 3.75E0 AND greatest(a.x1 - a.x0, b.x1 - b.x0) <= 2.2E0 * least(a.x1 - a.x0, b.x1 - b.x0)
      AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.45E0 * least(a.x1 - a.x0, b.x1 - b.x0)""")
_("joi_continuous_runs", """SELECT a.field_id, a.region_id AS region_a, b.region_id AS region_b, a.row_index AS row_a, b.row_index AS row_b, round(b.x1 - a.x0, 4) AS length
    FROM {v_swaths} a JOIN {v_swaths} b ON a.field_id = b.field_id AND a.region_id < b.region_id AND a.x1 <= b.x0 AND abs(a.y - b.y) <= 1E-5""")
_("joi_asof_samples", """WITH e AS (SELECT chain, sequence, length, sum(length) OVER (PARTITION BY chain ORDER BY sequence) AS e FROM {v_legs}),
    t AS (SELECT chain, max(e) AS total FROM e GROUP BY chain), s AS (SELECT t.chain, k.id AS sample, k.id * 40.0E0 AS at FROM t JOIN (SELECT * FROM range(0, 30) AS r(id)) k ON k.id * 40 < t.total)
    SELECT s.chain, s.sample, e.sequence, round((s.at - (e.e - e.length)) / e.length, 4) AS share FROM s JOIN e ON e.chain = s.chain AND e.e - e.length <= s.at AND s.at < e.e""")
_("joi_component_of_point", """SELECT t.chain, t.i, coalesce(min(g.region_id), -1) AS component FROM (SELECT t.*, 1 + t.chain % (SELECT count(*) FROM {supplier}) AS field_id FROM {v_track} t) t LEFT JOIN {v_regions} g ON g.field_id = t.field_id AND t.x BETWEEN g.x0 AND g.x1 AND t.y BETWEEN g.y0 AND g.y1 GROUP BY t.chain, t.i""")
_("joi_single_part_of_point", """SELECT t.chain, t.i, CASE WHEN count(g.region_id) = 1 THEN min(g.region_id) END AS part FROM (SELECT t.*, 1 + t.chain % (SELECT count(*) FROM {supplier}) AS field_id FROM {v_track} t) t LEFT JOIN {v_regions} g ON g.field_id = t.field_id AND t.x BETWEEN g.x0 AND g.x1 AND t.y BETWEEN g.y0 AND g.y1 GROUP BY t.chain, t.i""")
_("joi_insertion_places", """WITH g AS (SELECT field_id, task, xe, y, lead(xs) OVER (PARTITION BY field_id ORDER BY task) AS nx, lead(y) OVER (PARTITION BY field_id ORDER BY task) AS ny FROM {v_ordered}),
    c AS (SELECT field_id, task, round(abs(30 - xe) + abs(40 - y) + abs(nx - 30) + abs(ny - 40) - abs(nx - xe) - abs(ny - y), 4) AS detour FROM g WHERE nx IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY detour, task) AS place FROM c) SELECT field_id, task, detour, CAST(place AS INT) AS place FROM r WHERE place <= 3""")
_("joi_semi_pairs", """SELECT s.field_id, s.region_id, s.row_index FROM {v_swaths} s WHERE EXISTS (SELECT 1 FROM {v_fields} f WHERE f.field_id = s.field_id AND f.kind = 2)""")
_("joi_outer_sources", """SELECT o.field_id, f.kind, f.w FROM {v_status} o LEFT JOIN {v_fields} f ON f.field_id = o.field_id""")

# aggregates
_("agg_status_counts", """WITH s AS (SELECT * FROM (VALUES ('ESTIMATED'), ('PENDING'), ('FAILED'), ('RUNNING'), ('INCOMPLETE')) AS t(status))
    SELECT s.status, count(o.field_id) AS n FROM s LEFT JOIN {v_status} o ON o.status = s.status GROUP BY s.status""")
_("agg_runtime_percentiles", """SELECT batch, round(median(seconds), 4) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY seconds) AS p90, percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds) AS p95, max(seconds) AS most FROM {v_status} GROUP BY batch""")
_("agg_exit_code", """SELECT batch, CASE WHEN count(*) > 0 AND bool_and(status = 'ESTIMATED') THEN 0 ELSE 1 END AS code FROM {v_status} GROUP BY batch""")
_("agg_verdict", """SELECT batch, bool_and(status <> 'FAILED') AS passed, count(*) FILTER (WHERE status = 'FAILED') AS n_failed, count(DISTINCT attempts) AS n_attempts FROM {v_status} GROUP BY batch""")
_("agg_area_ledger", """WITH r AS (SELECT field_id, sum(CAST((x1 - x0) * (y1 - y0) AS DOUBLE)) AS parts FROM {v_regions} GROUP BY field_id),
    o AS (SELECT a.field_id, sum(CAST(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE)) AS shared
      FROM {v_regions} a JOIN {v_regions} b ON a.field_id = b.field_id AND a.region_id < b.region_id GROUP BY a.field_id),
    t AS (SELECT field_id, CAST(w * h - CASE kind WHEN 0 THEN 0 WHEN 1 THEN (w - floor(w / 2)) * (h - floor(h / 2)) ELSE floor(w / 3) * floor(h / 3) END AS DOUBLE) AS target FROM {v_fields})
    SELECT t.field_id, t.target, r.parts, coalesce(o.shared, 0) AS shared, t.target - r.parts + coalesce(o.shared, 0) AS delta, abs(t.target - r.parts + coalesce(o.shared, 0)) <= greatest(2E-4, 1E-8 * t.target) AS closed
    FROM t JOIN r ON r.field_id = t.field_id LEFT JOIN o ON o.field_id = t.field_id""")
_("agg_coverage_union", """WITH s AS (SELECT field_id, region_id, x1 - x0 AS width, y - 1.875E0 AS lo, y + 1.875E0 AS hi, max(y + 1.875E0) OVER (PARTITION BY field_id, region_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {v_swaths}),
    u AS (SELECT field_id, region_id, sum(width * (hi - lo)) AS total, sum(width * greatest(0, hi - greatest(lo, coalesce(before, lo)))) AS covered FROM s GROUP BY field_id, region_id)
    SELECT u.field_id, u.region_id, round(total, 4) AS swept_m2, round(covered, 4) AS union_m2, round(total - covered, 4) AS repeat_m2, round(greatest(0, (g.x1 - g.x0) * (g.y1 - g.y0) - covered), 4) AS residual_m2
    FROM u JOIN {v_regions} g ON g.field_id = u.field_id AND g.region_id = u.region_id""")
_("agg_style_status", """WITH c AS (SELECT r.field_id, r.sequence, r.kind, r.b_x - r.a_x AS dx, r.b_y - r.a_y AS dy, lag(r.b_x - r.a_x) OVER w AS px, lag(r.b_y - r.a_y) OVER w AS py, lead(r.b_x - r.a_x) OVER w AS nx, lead(r.b_y - r.a_y) OVER w AS ny
      FROM {v_route} r WINDOW w AS (PARTITION BY r.field_id ORDER BY r.sequence)),
    a AS (SELECT field_id, kind = 'CONNECTION' AND (px * dx + py * dy < 0 OR dx * nx + dy * ny < 0) AS sharp, kind = 'CONNECTION' AND sqrt(dx * dx + dy * dy) > 30 AS far FROM c)
    SELECT field_id, count(*) FILTER (WHERE sharp) AS n_sharp, count(*) FILTER (WHERE far) AS n_long, CASE WHEN count(*) FILTER (WHERE sharp) > 2 THEN 'FAIL' WHEN count(*) FILTER (WHERE far) > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM a GROUP BY field_id""")
_("agg_efficiency_by_class", """SELECT field_id, round(sum(CASE WHEN category = 'WORK' THEN length ELSE 0 END), 4) AS work_m, round(sum(CASE WHEN category = 'TURN' THEN length ELSE 0 END), 4) AS turn_m,
    round(sum(CASE WHEN category = 'TRANSIT' THEN length ELSE 0 END), 4) AS transit_m, round(100 * sum(CASE WHEN category = 'WORK' THEN length / cap ELSE 0 END) / sum(length / cap), 4) AS efficiency_pct,
    round(sum(CASE WHEN category = 'WORK' THEN length ELSE 0 END) * 3.75E0 / 10000 / (sum(length / cap) / 3600), 4) AS ha_per_h FROM {v_legs} GROUP BY field_id""")
_("agg_weighted_quantile", """WITH s AS (SELECT field_id, row_index, piece, x1 - x0 AS len, sum(x1 - x0) OVER (PARTITION BY field_id ORDER BY x1 - x0, row_index, piece) AS run, sum(x1 - x0) OVER (PARTITION BY field_id) AS total FROM {v_segments})
    SELECT field_id, round(sum(len * len) / sum(len), 4) AS mean_m, min(CASE WHEN run >= 0.2E0 * total THEN len END) AS p20_m, round(sum(CASE WHEN len < 30 THEN len ELSE 0 END) / sum(len), 4) AS short_share FROM s GROUP BY field_id""")
_("agg_harmonic_cost", """SELECT field_id, region_id, round(count(*) / sum(1 / (x1 - x0)), 4) AS harmonic_m, round(max(y) - min(y), 4) AS span_m, count(*) AS n FROM {v_swaths} GROUP BY field_id, region_id""")
_("agg_fanned_out", """SELECT field_id, region_id, count(*) AS n_rows, min(row_index) AS first_row, max(row_index) AS last_row, round(sum(x1 - x0), 4) AS length_m FROM {v_swaths} GROUP BY field_id, region_id""")

# windows and orders
_("win_serpentine", """SELECT field_id, row_index, piece, CAST(row_number() OVER (PARTITION BY field_id ORDER BY row_index, CASE WHEN row_index % 2 = 1 THEN -x0 ELSE x0 END) AS INT) AS place, row_index % 2 = 1 AS reversed FROM {v_segments}""")
_("win_skip_fill", """SELECT field_id, row_index, piece, CAST(row_number() OVER (PARTITION BY field_id ORDER BY row_index % 2, row_index, x0) AS INT) AS place FROM {v_segments}""")
_("win_skip_order", """WITH r AS (SELECT field_id, row_index, piece, row_number() OVER (PARTITION BY field_id ORDER BY row_index, piece) - 1 AS i FROM {v_segments})
    SELECT field_id, row_index, piece, CAST(row_number() OVER (PARTITION BY field_id ORDER BY i % 3, CASE WHEN (i % 3) % 2 = 1 THEN -i ELSE i END) AS INT) AS place FROM r""")
_("win_candidates4", """WITH p AS (SELECT s.field_id, s.row_index, s.piece, s.x0, k.skip, k.flip, dense_rank() OVER (PARTITION BY s.field_id, k.skip, k.flip ORDER BY CASE WHEN k.skip = 2 THEN s.row_index % 2 ELSE 0 END, s.row_index) - 1 AS spot
      FROM {v_segments} s CROSS JOIN (SELECT * FROM (VALUES (1, 0), (1, 1), (2, 0), (2, 1)) AS t(skip, flip)) k)
    SELECT field_id, skip, flip, row_index, piece, CAST(row_number() OVER (PARTITION BY field_id, skip, flip ORDER BY spot, CASE WHEN (spot + flip) % 2 = 1 THEN -x0 ELSE x0 END) AS INT) AS place, (spot + flip) % 2 = 1 AS reversed FROM p""")
_("win_phase_values", """WITH e AS (SELECT DISTINCT field_id, CAST(y0 AS DOUBLE) - 3.675E0 * floor(y0 / 3.675E0) AS m FROM {v_regions}),
    g AS (SELECT field_id, m, coalesce(lead(m) OVER (PARTITION BY field_id ORDER BY m), first_value(m) OVER (PARTITION BY field_id ORDER BY m) + 3.675E0) - m AS gap FROM e)
    SELECT field_id, round(m, 4) AS edge, round(gap, 4) AS gap, CAST(row_number() OVER (PARTITION BY field_id ORDER BY round(gap, 6) DESC, m) AS INT) AS place FROM g""")
_("win_route_continuity", """SELECT field_id, sequence FROM (SELECT field_id, sequence, a_x, a_y, lag(b_x) OVER (PARTITION BY field_id ORDER BY sequence) AS px, lag(b_y) OVER (PARTITION BY field_id ORDER BY sequence) AS py FROM {v_route}) q WHERE px IS NOT NULL AND (abs(a_x - px) > 1E-5 OR abs(a_y - py) > 1E-5)""")
_("win_body_blocks", """SELECT chain, block, min(sequence) AS first_seq, max(sequence) AS last_seq, count(*) AS n, round(sum(length), 4) AS length FROM
    (SELECT chain, sequence, length, CAST(floor((sum(CASE WHEN working THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY sequence) - 1) / 2) AS BIGINT) AS block FROM {v_legs}) q GROUP BY chain, block""")
_("win_itineraries", """SELECT field_id, count(*) AS n, min(sequence) AS first_seq, max(sequence) AS last_seq, round(sum(abs(b_x - a_x) + abs(b_y - a_y)), 4) AS walked FROM {v_route} GROUP BY field_id""")
_("win_review_rank", """SELECT field_id, batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY seconds, field_id) AS INT) AS place, row_number() OVER (PARTITION BY batch ORDER BY seconds, field_id) = 1 AS lowest FROM {v_status}""")
_("win_running_advance", """SELECT chain, sequence, round(sum(CASE WHEN working THEN length ELSE 0 END) OVER (PARTITION BY chain ORDER BY sequence), 4) AS worked_m, CAST(sum(CASE WHEN working THEN 1 ELSE 0 END) OVER (PARTITION BY chain ORDER BY sequence) AS BIGINT) AS n_done FROM {v_legs}""")

# top k
_("top_best_attempt", """SELECT batch, field_id FROM (SELECT batch, field_id, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN status = 'ESTIMATED' THEN 0 ELSE 1 END, -attempts, seconds, field_id) AS r FROM {v_status}) q WHERE r = 1""")
_("top_widest_portal", """WITH s AS (SELECT a.field_id, a.region_id AS region_a, b.region_id AS region_b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS dx, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS dy, greatest(a.x0, b.x0) AS sx, greatest(a.y0, b.y0) AS sy
      FROM {v_regions} a JOIN {v_regions} b ON a.field_id = b.field_id AND a.region_id < b.region_id WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
    SELECT field_id, region_a, region_b, sx + dx / 2.0E0 AS px, sy + dy / 2.0E0 AS py FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY dx + dy DESC, sx, sy, region_a, region_b) AS r FROM s) q WHERE r = 1""")
_("top_ranked_tasks", """SELECT field_id, task, CAST(r AS INT) AS place FROM (SELECT field_id, task, row_number() OVER (PARTITION BY field_id ORDER BY CASE WHEN piece = 2 THEN 0 ELSE 1 END, round(least(abs(xs - 10) + abs(y - 10), abs(xe - 10) + abs(y - 10)), 6), task) AS r FROM {v_ordered}) q""")
_("top_diverse_candidates", """WITH c AS (SELECT l_suppkey AS field_id, CAST(l_linenumber AS INT) AS parts, l_partkey AS candidate, min(l_extendedprice) AS cost, max(l_quantity) AS len FROM {lineitem} GROUP BY l_suppkey, l_linenumber, l_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY field_id, parts ORDER BY cost, candidate) AS a, row_number() OVER (PARTITION BY field_id, parts ORDER BY len DESC, candidate) AS b FROM c)
    SELECT DISTINCT field_id, parts, candidate FROM r WHERE a <= 6 OR b <= 6""")
_("top_candidate_specs", """SELECT direction, pattern, split, CAST(row_number() OVER (ORDER BY direction + pattern + split, direction, pattern, split) AS INT) AS place FROM (SELECT d.id AS direction, p.id AS pattern, s.id AS split FROM (SELECT DISTINCT c_nationkey % 4 AS id FROM {customer}) d
    CROSS JOIN (SELECT DISTINCT c_nationkey % 3 AS id FROM {customer}) p CROSS JOIN (SELECT DISTINCT c_nationkey % 2 AS id FROM {customer}) s) q""")
_("top_time_slack", """WITH m AS (SELECT *, min(seconds) OVER (PARTITION BY batch) AS least_s FROM {v_status}) SELECT batch, field_id FROM (SELECT batch, field_id, row_number() OVER (PARTITION BY batch ORDER BY attempts, seconds, field_id) AS r FROM m WHERE seconds <= 1.05E0 * least_s) q WHERE r = 1""")

# sets
_("set_task_multiset", """WITH e AS (SELECT field_id, row_index, piece, count(*) AS n FROM {v_segments} GROUP BY field_id, row_index, piece), p AS (SELECT o.field_id, o.row_index, o.piece, count(*) AS n FROM {v_ordered} o JOIN {v_route} r ON r.field_id = o.field_id AND r.task = o.task AND r.kind = 'WORK' GROUP BY o.field_id, o.row_index, o.piece)
    SELECT coalesce(e.field_id, p.field_id) AS field_id, bool_and(e.n IS NOT NULL AND p.n IS NOT NULL AND e.n = p.n) AS same FROM e FULL OUTER JOIN p ON e.field_id = p.field_id AND e.row_index = p.row_index AND e.piece = p.piece GROUP BY coalesce(e.field_id, p.field_id)""")
_("set_except_all", """SELECT l_orderkey, l_linenumber FROM {lineitem} EXCEPT ALL SELECT DISTINCT l_orderkey, l_linenumber FROM {lineitem}""")
_("set_manifest", """SELECT batch, count(DISTINCT field_id) = count(*) AS unique_ids, count(*) AS n FROM {v_status} GROUP BY batch""")
_("set_missing_both_ways", """SELECT 'ORDER_WITHOUT_LINES' AS code, o_orderkey AS id FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'LINE_WITHOUT_ORDER', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM {lineitem}) l WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_orderkey = l_orderkey)""")

# geometry in closed form
_("geo_section_levels", """SELECT field_id, row_index, count(*) AS pieces, round(sum(x1 - x0), 4) AS width, round(min(x0), 4) AS first_x FROM {v_segments} GROUP BY field_id, row_index""")
_("geo_effective_width", """SELECT field_id, region_id, least(CAST(least(x1 - x0, y1 - y0) AS DOUBLE), round(4.0E0 * (x1 - x0) * (y1 - y0) / (2 * ((x1 - x0) + (y1 - y0))), 4)) AS width FROM {v_regions}""")
_("geo_swept_rectangles", """SELECT field_id, task, round(abs(xe - xs) + 2.5E0, 4) AS length, round((abs(xe - xs) + 2.5E0) * 3.75E0, 4) AS area, round(least(xs, xe) - 1.25E0, 4) AS x_min, round(greatest(xs, xe) + 1.25E0, 4) AS x_max FROM {v_ordered}""")
_("geo_anisotropic_core", """SELECT field_id, region_id, x0 + 7.5E0 AS cx0, y0 + 1.5E0 AS cy0, x1 - 7.5E0 AS cx1, y1 - 1.5E0 AS cy1, round((x1 - x0 - 15.0E0) * (y1 - y0 - 3.0E0), 4) AS area FROM {v_regions} WHERE x1 - x0 > 15 AND y1 - y0 > 3""")
_("geo_shared_interfaces", """SELECT a.field_id, a.region_id AS region_a, b.region_id AS region_b, CASE WHEN a.x1 = b.x0 OR b.x1 = a.x0 THEN least(a.y1, b.y1) - greatest(a.y0, b.y0) ELSE least(a.x1, b.x1) - greatest(a.x0, b.x0) END AS length
    FROM {v_regions} a JOIN {v_regions} b ON a.field_id = b.field_id AND a.region_id < b.region_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
_("geo_snapped", """SELECT chain, i, round(x / 0.5E0) * 0.5E0 AS gx, round((y + 0.3E0) / 0.5E0) * 0.5E0 AS gy FROM {v_track}""")
_("geo_spatial_order", """SELECT field_id, region_id, CAST(row_number() OVER (ORDER BY x0, y0, -(x1 - x0) * (y1 - y0), field_id, region_id) AS INT) AS place FROM {v_regions}""")

# kinematics
_("kin_interval_class", """SELECT chain, category, round(sum(d), 4) AS distance_m, count(*) AS n FROM (SELECT chain, i, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS d, CASE WHEN working AND gear > 0 THEN 'WORK' WHEN working THEN 'WORK_REVERSE' WHEN gear < 0 THEN 'REVERSE'
    WHEN abs(ny - y) > 2 * abs(nx - x) THEN 'TURN' ELSE 'TRANSIT' END AS category FROM (SELECT *, lead(x) OVER (PARTITION BY chain ORDER BY i) AS nx, lead(y) OVER (PARTITION BY chain ORDER BY i) AS ny FROM {v_track}) p WHERE nx IS NOT NULL) q GROUP BY chain, category""")
_("kin_gear_runs", """SELECT chain, run, gear, count(*) AS n, min(i) AS first_i FROM (SELECT chain, i, gear, sum(shift) OVER (PARTITION BY chain ORDER BY i) AS run FROM (SELECT chain, i, gear, CASE WHEN lag(gear) OVER (PARTITION BY chain ORDER BY i) = gear THEN 0 ELSE 1 END AS shift FROM {v_track}) a) b GROUP BY chain, run, gear""")
_("kin_template_class", """WITH r AS (SELECT chain, i, gear, CASE WHEN lag(gear) OVER (PARTITION BY chain ORDER BY i) = gear THEN 0 ELSE 1 END AS shift FROM {v_track}), s AS (SELECT chain, sum(shift) - 1 AS shifts, count(*) FILTER (WHERE gear < 0 AND shift = 1) AS reverse_runs FROM r GROUP BY chain)
    SELECT chain, shifts, reverse_runs, CASE WHEN shifts = 0 THEN 'LOCAL_U' WHEN shifts <= 2 AND reverse_runs <= 1 THEN 'LOCAL_3LEG' WHEN shifts <= 4 AND reverse_runs <= 2 THEN 'LOCAL_5LEG' ELSE 'REJECT' END AS template FROM s""")
_("kin_issue_codes", """SELECT chain, code, count(*) AS n FROM (SELECT chain, CASE WHEN d > 100 THEN 'POSITION_JUMP' WHEN abs(dyaw) > 3 THEN 'HEADING_JUMP' WHEN gear < 0 AND working THEN 'REVERSE_WORK' ELSE 'OK' END AS code FROM
    (SELECT chain, gear, working, abs((lead(x) OVER w) - x) + abs((lead(y) OVER w) - y) AS d, (lead(yaw) OVER w) - yaw AS dyaw FROM {v_track} WINDOW w AS (PARTITION BY chain ORDER BY i)) p WHERE d IS NOT NULL) q GROUP BY chain, code""")
_("kin_dense_points", """WITH e AS (SELECT chain, i, x, y, nx, ny, greatest(1, CAST(ceil(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) / 20) AS INT)) AS n FROM (SELECT *, lead(x) OVER (PARTITION BY chain ORDER BY i) AS nx, lead(y) OVER (PARTITION BY chain ORDER BY i) AS ny FROM {v_track}) p WHERE nx IS NOT NULL)
    SELECT e.chain, e.i, CAST(k.id AS INT) AS step, round(x + (nx - x) * k.id / n, 4) AS px, round(y + (ny - y) * k.id / n, 4) AS py FROM e JOIN (SELECT * FROM range(0, 20) AS t(id)) k ON k.id < e.n""")

# swaths, partition, routing, headlands
_("swa_lines", """SELECT field_id, region_id, row_index, round(x0, 4) AS x0, round(x1, 4) AS x1, round(y, 4) AS y FROM {v_swaths}""")
_("swa_clip_hole", """SELECT field_id, row_index, piece, round(x0, 4) AS x0, round(x1, 4) AS x1, round(y, 4) AS y FROM {v_segments}""")
_("swa_main_area_bound", """SELECT field_id, region_id, round(greatest(0, x1 - x0 - 2 * 5.0E0) * (y1 - y0 - 2 * 0.3E0), 4) AS bound_m2 FROM {v_regions}""")
_("swa_short_segments", """SELECT field_id, row_index, piece, x1 - x0 AS length, CASE WHEN x1 - x0 < 20 AND piece = 2 THEN 'REMOVED_REDUNDANT_SHORT_WORK' WHEN x1 - x0 < 25 THEN 'RETAINED_REQUIRED_COVERAGE_LAG_PENDING' ELSE 'KEPT' END AS status FROM {v_segments}""")
_("swa_candidates", """SELECT s.field_id, s.region_id, k.step, count(*) AS n, round(sum(s.x1 - s.x0) * 3.75E0, 4) AS area_m2 FROM {v_swaths} s JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(step)) k ON true JOIN {v_regions} g ON g.field_id = s.field_id AND g.region_id = s.region_id AND s.y + k.step * 3.675E0 / 4 <= g.y1 GROUP BY s.field_id, s.region_id, k.step""")
_("par_adjacency", """SELECT field_id, region_a, region_b, length FROM (SELECT a.field_id, a.region_id AS region_a, b.region_id AS region_b, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS length
    FROM {v_regions} a JOIN {v_regions} b ON a.field_id = b.field_id AND a.region_id < b.region_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1) q""")
_("par_width_class", """SELECT field_id, region_a, region_b, CASE WHEN length = 0 THEN 'POINT_CONTACT' WHEN length < 6 THEN 'TOO_NARROW' WHEN length < 25 THEN 'NARROW' ELSE 'WIDE' END AS width_class FROM (SELECT a.field_id, a.region_id AS region_a, b.region_id AS region_b, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS length
    FROM {v_regions} a JOIN {v_regions} b ON a.field_id = b.field_id AND a.region_id < b.region_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1) q""")
_("par_slabs", """SELECT field_id, y AS y_lo, next_y AS y_hi FROM (SELECT field_id, y, lead(y) OVER (PARTITION BY field_id ORDER BY y) AS next_y FROM (SELECT DISTINCT field_id, y FROM {v_rings}) d) q WHERE next_y - y >= 5""")
_("par_nearest_core", """SELECT chain, i, region_id FROM (SELECT t.chain, t.i, g.region_id, row_number() OVER (PARTITION BY t.chain, t.i ORDER BY abs(t.x - (g.x0 + g.x1) / 2.0E0) + abs(t.y - (g.y0 + g.y1) / 2.0E0), g.region_id) AS r FROM (SELECT t.*, 1 + t.chain % (SELECT count(*) FROM {supplier}) AS field_id FROM {v_track} t) t JOIN {v_regions} g ON g.field_id = t.field_id) q WHERE r = 1""")
_("par_reachability", """SELECT field_id, region_id, CASE WHEN least(x1 - x0, y1 - y0) >= 30 THEN 'FULL_ENVELOPE_SAFE' WHEN least(x1 - x0, y1 - y0) >= 10 THEN 'STRAIGHT_ONLY' ELSE 'UNREACHABLE_REVIEW' END AS reach FROM {v_regions}""")
_("nav_connections", """SELECT field_id, sequence, round(abs(b_x - a_x) + abs(b_y - a_y), 4) AS length, CASE WHEN abs(b_x - a_x) + abs(b_y - a_y) <= 1E-5 THEN 'COINCIDENT' WHEN abs(b_x - a_x) <= 1E-5 THEN 'DIRECT_FOLD' WHEN abs(b_y - a_y) <= 1E-5 THEN 'GRID_DETOUR' ELSE 'SMOOTH_TEMPLATE' END AS method FROM {v_route} WHERE kind = 'CONNECTION'""")
_("nav_route_status", """SELECT f.field_id, CASE WHEN count(r.sequence) = 0 THEN 'NO_BODY_TASKS' WHEN count(*) FILTER (WHERE r.kind = 'WORK') = count(*) FILTER (WHERE r.kind = 'CONNECTION') + 1 THEN 'COMPLETE_CONNECTED' ELSE 'PARTIAL_CONNECTED' END AS status FROM {v_fields} f LEFT JOIN {v_route} r ON r.field_id = f.field_id GROUP BY f.field_id""")
_("nav_sequence_cost", """SELECT field_id, round(sum(len) + 50 * 3.75E0 * count(*) FILTER (WHERE diag) , 4) AS cost, count(*) AS n FROM (SELECT field_id, sqrt((b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y)) AS len, abs(b_x - a_x) > abs(b_y - a_y) AS diag FROM {v_route} WHERE kind = 'CONNECTION') q GROUP BY field_id""")
_("nav_direct_motions", """SELECT field_id, sequence, CASE WHEN abs(b_y - a_y) <= 1E-9 THEN round(abs(b_x - a_x) / 2.36E0, 4) END AS seconds FROM {v_route}""")
_("nav_task_variants", """SELECT o.field_id, o.task, d.rev, CASE WHEN d.rev = 1 THEN o.xe ELSE o.xs END AS start_x, CASE WHEN d.rev = 1 THEN o.xs ELSE o.xe END AS end_x FROM {v_ordered} o CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS t(rev)) d""")
_("hea_rings", """SELECT f.field_id, CAST(k.id AS INT) AS ring, round(2 * ((f.w - 2 * (k.id + 0.5E0) * 3.75E0) + (f.h - 2 * (k.id + 0.5E0) * 3.75E0)), 4) AS length, round((k.id + 0.5E0) * 3.75E0, 4) AS inset FROM {v_fields} f CROSS JOIN (SELECT * FROM range(0, 3) AS t(id)) k WHERE f.w > 2 * (k.id + 0.5E0) * 3.75E0 AND f.h > 2 * (k.id + 0.5E0) * 3.75E0""")
_("hea_edge_tasks", """WITH e AS (SELECT field_id, i, x, y, coalesce(lead(x) OVER (PARTITION BY field_id ORDER BY i), first_value(x) OVER (PARTITION BY field_id ORDER BY i)) AS nx, coalesce(lead(y) OVER (PARTITION BY field_id ORDER BY i), first_value(y) OVER (PARTITION BY field_id ORDER BY i)) AS ny FROM {v_rings} WHERE ring = 0),
    c AS (SELECT e.field_id, e.i, CAST(k.id AS INT) AS offset_no, abs(nx - x) + abs(ny - y) AS len, round((abs(nx - x) + abs(ny - y) - 10) * 3.75E0 / (k.id + 1), 4) AS gain FROM e CROSS JOIN (SELECT * FROM range(0, 4) AS t(id)) k WHERE abs(nx - x) + abs(ny - y) >= 30),
    r AS (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY gain DESC, i, offset_no) AS place FROM c) SELECT field_id, i, offset_no, len, gain, CAST(place AS INT) AS place FROM r WHERE place <= 18""")
_("hea_coverage_status", """SELECT f.field_id, CASE WHEN f.w * f.h - greatest(0, f.w - 22.5E0) * greatest(0, f.h - 22.5E0) >= 0.5E0 * f.w * f.h THEN 'COVERAGE_COMPLETE' ELSE 'COVERAGE_GAP' END AS status FROM {v_fields} f""")

# audits, sinks and state
_("aud_sequence_gaps", """SELECT field_id, bool_and(sequence = r) AS gapless FROM (SELECT field_id, sequence, row_number() OVER (PARTITION BY field_id ORDER BY sequence) AS r FROM {v_route}) q GROUP BY field_id""")
_("aud_orphans", """SELECT l.l_suppkey, count(*) AS n FROM {lineitem} l LEFT JOIN {supplier} s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 5000 WHERE s.s_suppkey IS NULL GROUP BY l.l_suppkey""")
_("aud_tolerant_equality", """SELECT o_orderkey, abs(o_totalprice - s) <= greatest(1E-4, 1E-8 * greatest(abs(o_totalprice), abs(s))) AS equal FROM {orders} JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
_("aud_export_codes", """SELECT field_id, bool_and(n = m) AS tasks_match, bool_and(inside) AS inside FROM (SELECT o.field_id, count(*) OVER (PARTITION BY o.field_id) AS n, max(o.task) OVER (PARTITION BY o.field_id) AS m, o.x0 >= 0 AND o.x1 <= f.w AND o.y >= 0 AND o.y <= f.h AS inside FROM {v_ordered} o JOIN {v_fields} f ON f.field_id = o.field_id) q GROUP BY field_id""")
_("aud_connection_neighbours", """SELECT field_id, count(*) FILTER (WHERE before_kind = 'WORK' AND after_kind = 'WORK') AS good, count(*) AS n FROM (SELECT field_id, kind, lag(kind) OVER (PARTITION BY field_id ORDER BY sequence) AS before_kind, lead(kind) OVER (PARTITION BY field_id ORDER BY sequence) AS after_kind FROM {v_route}) q WHERE kind = 'CONNECTION' GROUP BY field_id""")
_("aud_seam_motion", """SELECT chain, count(*) FILTER (WHERE gap > 80) AS n_far, max(gap) AS most FROM (SELECT chain, abs(x - lag(x) OVER (PARTITION BY chain ORDER BY i)) + abs(y - lag(y) OVER (PARTITION BY chain ORDER BY i)) AS gap FROM {v_track}) q GROUP BY chain""")
_("snk_upsert", """SELECT field_id, status, seconds FROM {v_status} WHERE field_id % 3 <> 0 UNION ALL SELECT field_id, 'ESTIMATED' AS status, seconds * 2 AS seconds FROM {v_status} WHERE field_id % 3 = 0""")
_("snk_extent", """SELECT chain, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM {v_track} GROUP BY chain""")
_("snk_union_layers", """SELECT field_id, 'region' AS layer, CAST(region_id AS BIGINT) AS item, CAST(x1 - x0 AS DOUBLE) AS size FROM {v_regions} UNION ALL SELECT field_id, 'segment', CAST(row_index AS BIGINT), x1 - x0 FROM {v_segments}""")
_("snk_param_dedup", """SELECT DISTINCT attempts, status FROM {v_status}""")
_("sta_resume_pending", """SELECT field_id, attempts FROM {v_status} WHERE status = 'PENDING' OR (status = 'FAILED' AND attempts < 2)""")
_("sta_transitions", """SELECT field_id, CASE WHEN status = 'ESTIMATED' THEN 'COMPLETED' WHEN status = 'PENDING' THEN 'RUNNING' WHEN attempts < 2 THEN 'PENDING' ELSE 'FAILED' END AS next_state, attempts + CASE WHEN status = 'PENDING' THEN 1 ELSE 0 END AS attempts FROM {v_status}""")
_("sta_worker_plan", """SELECT field_id, greatest(1, least(12, attempts * 4, CAST(floor(seconds * 0.75E0 / 768) AS INT))) AS workers FROM {v_status}""")
_("tim_invalidated", """SELECT field_id, status, CASE WHEN batch % 7 = 0 THEN NULL ELSE seconds END AS seconds FROM {v_status}""")
_("tim_reconciled", """SELECT chain, category, round(sum(length), 4) AS distance_m, round(sum(length / cap), 4) AS seconds, min(cap) AS cap FROM {v_legs} GROUP BY chain, category""")

# speed classes from arc-length samples: a sample is slow where the heading of the track changes near it
_("win_local_speed_blocks", """WITH e AS (SELECT chain, i, dx, dy, abs(dx) + abs(dy) AS len, sum(abs(dx) + abs(dy)) OVER (PARTITION BY chain ORDER BY i) AS till FROM (SELECT chain, i, (lead(x) OVER w) - x AS dx, (lead(y) OVER w) - y AS dy FROM {v_track} WINDOW w AS (PARTITION BY chain ORDER BY i)) p WHERE dx IS NOT NULL),
    s AS (SELECT e.chain, CAST(k.id AS INT) AS sample, CASE WHEN e.dx > 0 THEN 1 WHEN e.dx < 0 THEN -1 ELSE 0 END AS hx, CASE WHEN e.dy > 0 THEN 1 WHEN e.dy < 0 THEN -1 ELSE 0 END AS hy FROM e JOIN (SELECT * FROM range(0, 400) AS t(id)) k ON k.id * 25 >= e.till - e.len AND k.id * 25 < e.till),
    c AS (SELECT chain, sample, CASE WHEN hx <> coalesce(lag(hx) OVER w, hx) OR hy <> coalesce(lag(hy) OVER w, hy) OR hx <> coalesce(lead(hx) OVER w, hx) OR hy <> coalesce(lead(hy) OVER w, hy) THEN 1 ELSE 0 END AS slow FROM s WINDOW w AS (PARTITION BY chain ORDER BY sample)),
    r AS (SELECT chain, sample, slow, sum(fresh) OVER (PARTITION BY chain ORDER BY sample) AS block FROM (SELECT *, CASE WHEN lag(slow) OVER (PARTITION BY chain ORDER BY sample) = slow THEN 0 ELSE 1 END AS fresh FROM c) q)
    SELECT chain, CAST(block AS BIGINT) AS block, slow, 25 * min(sample) AS start_m, 25 * (max(sample) + 1) AS end_m, CASE slow WHEN 1 THEN 0.8E0 ELSE 2.36E0 END AS cap FROM r GROUP BY chain, block, slow""")
_("hea_rectilinear_inset", """SELECT field_id, region_id, CAST(k.id AS INT) AS ring, round(x0 + 3.75E0 * (k.id + 0.5E0), 4) AS rx0, round(y0 + 3.75E0 * (k.id + 0.5E0), 4) AS ry0, round(x1 - 3.75E0 * (k.id + 0.5E0), 4) AS rx1, round(y1 - 3.75E0 * (k.id + 0.5E0), 4) AS ry1,
    round(greatest(0, x1 - x0 - 3.75E0 * (2 * k.id + 1)) * greatest(0, y1 - y0 - 3.75E0 * (2 * k.id + 1)), 4) AS inner_m2 FROM {v_regions} CROSS JOIN (SELECT * FROM range(0, 3) AS t(id)) k WHERE x1 - x0 > 3.75E0 * (2 * k.id + 1) AND y1 - y0 > 3.75E0 * (2 * k.id + 1)""")
_("nav_work_replay", """SELECT chain, sequence, category, round(sum(CASE WHEN working THEN length ELSE 0 END) OVER (PARTITION BY chain ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS worked_before,
    NOT working AND coalesce(sum(CASE WHEN working THEN length ELSE 0 END) OVER (PARTITION BY chain ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < length AS over_unworked FROM {v_legs}""")
_("swa_order_modes", """SELECT field_id, mode, row_index, piece, CAST(row_number() OVER (PARTITION BY field_id, mode ORDER BY CASE WHEN mode = 'skip_row_then_fill' THEN row_index % 2 ELSE 0 END, row_index, CASE WHEN row_index % 2 = 1 THEN -x0 ELSE x0 END) AS INT) AS place FROM {v_segments} CROSS JOIN (SELECT * FROM (VALUES ('serpentine'), ('skip_row_then_fill')) AS t(mode)) m""")
_("swa_joint_pairs", """WITH c AS (SELECT field_id, region_id, CAST(y0 AS DOUBLE) - 3.675E0 * floor(y0 / 3.675E0) AS phase, x1 - x0 AS len FROM {v_regions}) SELECT a.field_id, a.region_id AS region_a, b.region_id AS region_b, round(least(abs(a.phase - b.phase), 3.675E0 - abs(a.phase - b.phase)), 4) AS off_m, least(a.len, b.len) >= 0.95E0 * greatest(a.len, b.len) AS alike
    FROM c a JOIN c b ON a.field_id = b.field_id AND a.region_id < b.region_id""")
_("src_metric_digest", """SELECT field_id, sequence, round(sqrt((b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y)), 4) AS length, abs(b_x - a_x) + abs(b_y - a_y) > 1E-7 AS valid FROM {v_route}""")
_("par_merge_step", """WITH small AS (SELECT field_id, region_id, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY field_id ORDER BY (x1 - x0) * (y1 - y0), region_id) AS r FROM {v_regions}),
    cand AS (SELECT s.field_id, s.region_id, b.region_id AS into_region, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS seam FROM small s JOIN {v_regions} a ON a.field_id = s.field_id AND a.region_id = s.region_id JOIN {v_regions} b ON b.field_id = s.field_id AND b.region_id <> s.region_id
      AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 WHERE s.r = 1 AND s.area < 2500)
    SELECT field_id, region_id, into_region, seam FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY seam DESC, into_region) AS r FROM cand WHERE seam > 0) q WHERE r = 1""")
_("fil_short_stubs", """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity < 5 THEN 'STUB' WHEN l_quantity < 10 THEN 'REVIEW' ELSE 'KEEP' END AS verdict FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'""")
