"""Importance resampling: payload composition, buckets and ranks against plain Python, edge rows, SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np

from furrow.llm.decontamination import WORD
from furrow.llm.importance import buckets_of, composed, importance_resample
from furrow.llm.queries import ORACLE_SQL, op11_importance_resampling
from tests.llm.oracle import same

FOLD = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain_features(text):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(docs, target, seed=7, percent=25, least=20):
    made = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for i, n, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[2]))
    drawn = [*order[: percent * len(order) // 100]]
    out = []
    for r in rows:
        out.append((r[0], r[2], r[3], r[4], drawn.index(r) + 1 if r in drawn else None))
    return sorted(map(repr, out))


def test_composition_of_payloads():
    rng = random.Random(2)
    for n in (0, 1, 3, 64, 5000):
        a, b = rng.randbytes(7), rng.randbytes(n)
        got = composed(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert got[0] == zlib.crc32(a + b)


def test_buckets_of_odd_texts():
    texts = ["", "one", "A b, a  B", "\x01 x \x01", "é ü 漢字 x" * 3, "w" * 100_000 + " end", "\x7f", "a" + "\U0001f600b c", "  lead and trail  "]
    for cut in (len(texts), 1, 4):
        got = [x for lo in range(0, len(texts), cut) for x in buckets_of(texts[lo : lo + cut])]
        assert [(n, sorted(b.tolist())) for n, b in got] == [(n, sorted(b)) for n, b in map(plain_features, texts)]


def test_against_plain_python_with_edge_rows(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 60])))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "...!"), (None, " ".join(words[:30])), (1003, " ".join(words * 200))]
    target = [" ".join(rng.choices(words[:50], k=80)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame([(i, t, "q", 5, "z") for i, t in docs], "doc_id long, text string, words string, score int, scanned string")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance_resample(df, bench)
    assert out.columns == ["doc_id", "text", "words", "scanned", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain(docs, target)


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(7, text)] * 90 + [(8, text)] * 10, "doc_id long, text string")
    bench = spark.createDataFrame([("w1 w2",)], "text string")
    out = importance_resample(df, bench).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 26)) and len(out) == 100
    assert importance_resample(df.limit(0), bench).count() == 0
    assert {r.weight for r in importance_resample(df.limit(2), bench.limit(0)).collect()} != {None}


def test_query(spark, small):
    same(op11_importance_resampling(spark, small), ORACLE_SQL["op11_importance_resampling"], small)
