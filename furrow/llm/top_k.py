"""Exact top-k search by MaxScore over integer vectors.

Dimensions are the terms of a query. A shard holds a run of candidate rows and, for each dimension, the span of its
values, so it bounds what a dimension can add to a query's score. Dimensions are taken in falling order of that span:
the essential ones of a query are those without which no row could reach its k-th best score so far. They are traversed
for all rows of the shard, queries with as many essential dimensions together; the other dimensions are probed, some at
a time, while rows are still competitive. Dense
parts are matrix products; once few rows are competitive they are probed one by one. Every shard keeps its k best for
a query, and the shards' lists are merged. Ties go to the smaller id; nothing is approximate.

Queries come as packed blocks of bounded size, shuffled to each group of shards; neither side passes the driver.

Vectors that are null, or hold null or non-finite components, take no part. Shorter vectors count as filled up with 0.
A query's own id is no candidate for it. A repeated id is one query, with the least of its vectors, but each of its
rows is a candidate. Scores are integers of 64 bits. A vector of any length is read whole. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries, and of a group of shards that receives it.
QUERY_ROWS, GROUP_ROWS = 4096, 65_536
#: Blocks of queries that one task scores against a group of shards.
MOST_BLOCKS = 64
#: Rows scored between two updates of the k-th best score; dimensions probed at a time.
STEP_ROWS, PROBE = 2048, 16
FEW = 0.02
MOST_ROWS = 8192


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if the vector can't take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def pack(vectors: list[list[int]], width: int) -> bytes:
    """Rows of one width as bytes, behind one byte for the size of a number."""
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    most = int(np.abs(m).max(initial=0))
    size = next(s for s in (2, 4, 8) if s == 8 or most < 2 ** (8 * s - 1))
    return bytes([size]) + m.astype(f"<i{size}").tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, width).astype(np.int64)


def _best(q: np.ndarray, v: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score, then smaller id) of each q, by q."""
    order = np.lexsort((ids[v], -score, q))
    first = np.flatnonzero(np.diff(q[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def _competitive(q: np.ndarray, part: np.ndarray, rest: np.ndarray, least: np.ndarray, own: np.ndarray, some: np.ndarray, at: int) -> tuple:
    """(query, row, score) of the rows that stay competitive for queries `some`, whose essential dimensions are the first `at`."""
    width, q, rest, least = q.shape[1], q[some], rest[some], least[some]
    score = q[:, :at] @ part[:, :at].T
    open_ = ~own[some] & (score + rest[:, at : at + 1] >= least[:, None])
    while at < width and open_.mean() > FEW:
        to = min(width, at + PROBE)
        score += q[:, at:to] @ part[:, at:to].T
        at = to
        open_ &= score + rest[:, at : at + 1] >= least[:, None]
    qi, vi = np.nonzero(open_)
    s = score[qi, vi]
    while at < width and len(qi):
        to = min(width, at + PROBE)
        s = s + (q[qi, at:to] * part[vi, at:to]).sum(axis=1)
        at = to
        ok = s + rest[qi, at] >= least[qi]
        qi, vi, s = qi[ok], vi[ok], s[ok]
    return some[qi], vi, s


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k best rows of a shard."""
    n, width = rows.shape
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1) < 2.0**52
    kind = np.float64 if exact else np.int64
    q, v = queries.astype(kind), rows.astype(kind)
    low, high = v.min(axis=0), v.max(axis=0)
    most = np.maximum(q * low, q * high)  # what each dimension can add at most
    span = np.abs(q) * (high - low)
    order = np.argsort(-span.sum(axis=0), kind="stable")
    q, v, most, span = q[:, order], v[:, order], most[:, order], span[:, order]
    # rest[:, j]: the most that dimensions from j on can add
    rest = np.concatenate((np.cumsum(most[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), kind)), axis=1)
    bottom = (most - span).sum(axis=1)
    best_q, best_v, best_s = (np.zeros(0, np.int64) for _ in range(3))
    least = np.full(len(q), -np.inf)
    gain = np.cumsum(span[:, ::-1], axis=1)[:, ::-1]  # of the dimensions from j on
    for lo in range(0, n, STEP_ROWS):
        part = v[lo : lo + STEP_ROWS]
        own = query_ids[:, None] == ids[None, lo : lo + len(part)]
        # essential: for each query, the fewest dimensions such that a row at the bottom of them can't reach its k-th best score
        needed = (bottom[:, None] + gain >= least[:, None]).sum(axis=1)
        needed = np.minimum(width, np.maximum(-(-needed // PROBE), 1) * PROBE)
        found = [_competitive(q, part, rest, least, own, np.flatnonzero(needed == at), int(at)) for at in np.unique(needed)]
        qi, vi, s = (np.concatenate(x) for x in zip(*found, strict=True))
        best_q, best_v, best_s = np.concatenate((best_q, qi)), np.concatenate((best_v, vi + lo)), np.concatenate((best_s, s.astype(np.int64)))
        keep = _best(best_q, best_v, best_s, ids, k)
        best_q, best_v, best_s = best_q[keep], best_v[keep], best_s[keep]
        count = np.bincount(best_q, minlength=len(q))
        last = np.cumsum(count) - 1
        full = count >= k
        least[full] = best_s[last[full]]
    return best_q, best_v, best_s


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows. Both tables: (id long, v array<long>), v not null."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    of = queries.groupBy("id").agg(F.min("v").alias("v"))
    asked = of.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(facts["w"] or 0, asked["w"] or 0, 1)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked["n"] // QUERY_ROWS))
    # groups of at most GROUP_ROWS, and enough of them for all cores; a task meets at most MOST_BLOCKS blocks of queries
    groups = max(1, -(-facts["n"] // GROUP_ROWS), min(2 * cores, facts["n"] // STEP_ROWS))
    turns = -(-blocks // MOST_BLOCKS)

    shard_rows = min(MOST_ROWS, max(1, facts["n"] // groups))

    def pack_rows(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, shard_rows):
                some = batch.slice(lo, shard_rows)
                order = np.argsort(some.column(0).to_numpy(zero_copy_only=False), kind="stable")
                ids, vectors = some.column(0).take(pa.array(order)), some.column(1).take(pa.array(order))
                data = ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                group = zlib.crc32(data) % groups
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([data]), pa.array([pack(vectors.to_pylist(), width)])], ["group", "ids", "data"])

    def pack_block(table: pa.Table) -> pa.Table:
        data = table.column("id").to_numpy().astype("<i8").tobytes()
        return pa.table({"qids": pa.array([data]), "qdata": pa.array([pack(table.column("v").to_pylist(), width)])})

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qids, ids = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q, v, s = search(unpack(r["qdata"], width), qids, unpack(r["data"], width), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[v]), pa.array(s)], ["query_id", "vec_id", "score"])

    shards = rows.select("id", "v").mapInArrow(pack_rows, "group long, ids binary, data binary")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    packed = of.groupBy(block).applyInArrow(pack_block, "qids binary, qdata binary")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
    sent = packed.select("qids", "qdata", everywhere, F.pmod(F.xxhash64("qids"), F.lit(turns)).alias("turn"))
    shards = shards.select("group", "ids", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))
    met = shards.repartition(groups * turns, "group", "turn").join(sent.repartition(groups * turns, "group", "turn"), ["group", "turn"])
    found = met.select("qids", "qdata", "ids", "data").mapInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
