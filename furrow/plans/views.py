"""Deterministic views over the given tables that supply fields, strips, routes and tracks to the operators.

Each view is one SQL text that Spark and a second engine read alike. A text names base tables and other views in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Strip spacing: 3.75 m less 2 % overlap.
SPACING = "3.675E0"

VIEWS: dict[str, str] = {
    # rectangle, L and rectangle with a hole, in whole metres
    "v_fields": """SELECT s_suppkey AS field_id, CAST(s_suppkey % 3 AS INT) AS kind, CAST(60 + (s_suppkey * 37) % 120 AS INT) AS w,
        CAST(80 + (s_suppkey * 53) % 160 AS INT) AS h FROM {supplier}""",
    "v_regions": """SELECT field_id, 1 AS region_id, 0 AS x0, 0 AS y0, w AS x1, CASE kind WHEN 0 THEN h WHEN 1 THEN CAST(floor(h / 2) AS INT) ELSE CAST(floor(h / 3) AS INT) END AS y1 FROM {v_fields}
        UNION ALL SELECT field_id, 2, 0, CAST(floor(h / 2) AS INT), CAST(floor(w / 2) AS INT), h FROM {v_fields} WHERE kind = 1
        UNION ALL SELECT field_id, 2, 0, CAST(floor(h / 3) AS INT), CAST(floor(w / 3) AS INT), 2 * CAST(floor(h / 3) AS INT) FROM {v_fields} WHERE kind = 2
        UNION ALL SELECT field_id, 3, 2 * CAST(floor(w / 3) AS INT), CAST(floor(h / 3) AS INT), w, 2 * CAST(floor(h / 3) AS INT) FROM {v_fields} WHERE kind = 2
        UNION ALL SELECT field_id, 4, 0, 2 * CAST(floor(h / 3) AS INT), w, h FROM {v_fields} WHERE kind = 2""",
    "v_rings": """SELECT f.field_id, r.ring, r.i, CASE r.cx WHEN 0 THEN 0 WHEN 1 THEN f.w WHEN 2 THEN CAST(floor(f.w / 2) AS INT) WHEN 3 THEN CAST(floor(f.w / 3) AS INT) ELSE 2 * CAST(floor(f.w / 3) AS INT) END AS x,
        CASE r.cy WHEN 0 THEN 0 WHEN 1 THEN f.h WHEN 2 THEN CAST(floor(f.h / 2) AS INT) WHEN 3 THEN CAST(floor(f.h / 3) AS INT) ELSE 2 * CAST(floor(f.h / 3) AS INT) END AS y
        FROM {v_fields} f JOIN (SELECT * FROM (VALUES (0, 0, 0, 0, 0), (0, 0, 1, 1, 0), (0, 0, 2, 1, 1), (0, 0, 3, 0, 1),
        (1, 0, 0, 0, 0), (1, 0, 1, 1, 0), (1, 0, 2, 1, 2), (1, 0, 3, 2, 2), (1, 0, 4, 2, 1), (1, 0, 5, 0, 1),
        (2, 0, 0, 0, 0), (2, 0, 1, 1, 0), (2, 0, 2, 1, 1), (2, 0, 3, 0, 1), (2, 1, 0, 3, 3), (2, 1, 1, 3, 4), (2, 1, 2, 4, 4), (2, 1, 3, 4, 3)) AS t(kind, ring, i, cx, cy)) r ON f.kind = r.kind""",
    "v_swaths": f"""SELECT g.field_id, g.region_id, CAST(k.id AS INT) AS row_index, CAST(g.x0 AS DOUBLE) AS x0, CAST(g.x1 AS DOUBLE) AS x1, g.y0 + (k.id + 0.5E0) * {SPACING} AS y
        FROM {{v_regions}} g JOIN (SELECT * FROM range(0, 100) AS t(id)) k ON k.id < floor((g.y1 - g.y0) / {SPACING})""",
    # lines over the whole field, cut b_y the L's corner or b_y the hole
    "v_lines": f"""SELECT f.field_id, f.kind, f.w, f.h, CAST(k.id AS INT) AS row_index, (k.id + 0.5E0) * {SPACING} AS y
        FROM {{v_fields}} f JOIN (SELECT * FROM range(0, 100) AS t(id)) k ON k.id < floor(f.h / {SPACING})""",
    "v_segments": """SELECT field_id, row_index, 1 AS piece, y, CAST(0 AS DOUBLE) AS x0, CAST(CASE WHEN kind = 1 AND y > floor(h / 2) THEN floor(w / 2)
        WHEN kind = 2 AND y > floor(h / 3) AND y < 2 * floor(h / 3) THEN floor(w / 3) ELSE w END AS DOUBLE) AS x1 FROM {v_lines}
        UNION ALL SELECT field_id, row_index, 2, y, CAST(2 * floor(w / 3) AS DOUBLE), CAST(w AS DOUBLE) FROM {v_lines} WHERE kind = 2 AND y > floor(h / 3) AND y < 2 * floor(h / 3)""",
    # serpentine order and traversal direction
    "v_ordered": """SELECT field_id, row_index, piece, y, CASE WHEN row_index % 2 = 0 THEN x0 ELSE x1 END AS xs, CASE WHEN row_index % 2 = 0 THEN x1 ELSE x0 END AS xe, x0, x1,
        CAST(row_number() OVER (PARTITION BY field_id ORDER BY row_index, CASE WHEN row_index % 2 = 0 THEN x0 ELSE -x0 END) AS INT) AS task FROM {v_segments}""",
    "v_route": """SELECT field_id, 2 * task - 1 AS sequence, 'WORK' AS kind, task, xs AS a_x, y AS a_y, xe AS b_x, y AS b_y FROM {v_ordered}
        UNION ALL SELECT field_id, 2 * task, 'CONNECTION', task, xe, y, nx, ny FROM (SELECT field_id, task, xe, y, lead(xs) OVER (PARTITION BY field_id ORDER BY task) AS nx,
        lead(y) OVER (PARTITION BY field_id ORDER BY task) AS ny FROM {v_ordered}) q WHERE nx IS NOT NULL""",
    "v_legs": """SELECT l_orderkey AS chain, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS sequence,
        l_quantity AS length, l_returnflag = 'A' AS working, CASE l_returnflag WHEN 'N' THEN 0.8E0 ELSE 2.36E0 END AS cap,
        CASE l_returnflag WHEN 'A' THEN 'WORK' WHEN 'N' THEN 'TURN' ELSE 'TRANSIT' END AS category, l_suppkey AS field_id FROM {lineitem}""",
    "v_track": """SELECT user_id AS chain, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS i, event_id,
        CAST((event_id * 7919) % 101 AS DOUBLE) AS x, CAST((event_id * 104729) % 97 AS DOUBLE) AS y, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS gear,
        CAST((event_id * 31) % 628 AS DOUBLE) / 100 AS yaw, event_type = 'purchase' AS working FROM {events}""",
    "v_status": """SELECT o_orderkey AS field_id, CASE o_orderstatus WHEN 'F' THEN 'ESTIMATED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
        CAST(o_orderkey % 4 AS INT) AS attempts, o_totalprice AS seconds, o_custkey AS batch FROM {orders}""",
}


def needed(text: str) -> list[str]:
    """Views that a text uses, each after those that it uses."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in re.findall(r"\{(v_\w+)\}", t):
            if name not in out:
                visit(VIEWS[name])
                out.append(name)

    visit(text)
    return out


def standard(text: str, name=lambda table: table) -> str:
    """One statement with the views as common table expressions; `name` says how base tables are written."""
    plain = lambda t: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in VIEWS else name(m[1]), t)
    views, body = needed(text), plain(text).strip()
    if not views:
        return body
    ctes = ",\n".join(f"{v} AS ({plain(VIEWS[v])})" for v in views)
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text as a Spark plan over the tables of a folder."""
    whole = standard(text, lambda t: "{" + t + "}")
    return spark.sql(whole, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", whole))})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"SELECT * FROM {{{name}}}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of small tables, dealt out to all cores by keys before each makes many others: so few files are read by few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
