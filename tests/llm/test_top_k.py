import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.llm.queries import ORACLE_SQL, op1_top_k
from furrow.llm.top_k import exact_top_k, pack, quantized, search, unpack
from tests.llm.oracle import same


def brute(queries, qids, rows, ids, k):
    out = []
    for q, i in zip(queries, qids):
        scored = sorted((-int(np.dot(q, r)), int(j), n) for n, (r, j) in enumerate(zip(rows, ids)) if j != i)[:k]
        out += [(int(i), j, -s) for s, j, _ in scored]
    return sorted(out)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.sampled_from([1, 3, 16, 40]), st.sampled_from([1, 5, 300, 2**33]))
def test_search_against_brute_force(seed, n, width, most):
    rng = np.random.default_rng(seed)
    rows, ids = rng.integers(-most, most + 1, (n, width)), rng.integers(0, n, n)
    qids, at = np.unique(ids, return_index=True)
    q, v, s = search(rows[at], qids, rows, ids, 5)
    assert sorted((int(qids[a]), int(ids[b]), int(c)) for a, b, c in zip(q, v, s)) == brute(rows[at], qids, rows, ids, 5)


def test_many_steps_and_equal_rows():
    rng = np.random.default_rng(1)
    rows = np.concatenate((rng.normal(0, 32, (5000, 24)).astype(np.int64), np.full((3000, 24), 20)))
    ids = rng.permutation(8000)
    q, v, s = search(rows[::400], ids[::400], rows, ids, 5)
    assert sorted((int(ids[::400][a]), int(ids[b]), int(c)) for a, b, c in zip(q, v, s)) == brute(rows[::400], ids[::400], rows, ids, 5)


def test_pack():
    for m in ([[1, -2], [3]], [[2**40, 0]], [[-70000, 5]]):
        assert unpack(pack(m, 2), 2).tolist() == [(r + [0])[:2] for r in m]


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 1.0]), (5, [1.0, 0.5]), (5, [1.0, 0.5]), (6, [-1.0]), (7, []), (100, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "id long, e array<double>").select("id", quantized(F.col("e")).alias("v")).where("v is not null")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top_k(df.where("id % 50 = 0"), df, 3).collect())
    full = 256 * 256 + 128 * 128
    assert [g for g in got if g[0] == 0] == [(0, 1, 5, full), (0, 2, 5, full), (0, 3, 100, full)]
    assert exact_top_k(df.limit(0), df, 3).count() == 0 and exact_top_k(df, df.limit(0), 3).count() == 0


def test_query(spark, small):
    same(op1_top_k(spark, small), ORACLE_SQL["op1_top_k"], small)
