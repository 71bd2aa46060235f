import random

import numpy as np
from pyspark.sql import functions as F

from furrow.llm.decontamination import WORD, FmIndex, find, find_contamination, phrases_of, suffix_array, without_spans
from furrow.llm.queries import ORACLE_SQL, op5_decontamination
from tests.llm.oracle import same


def test_suffix_array_and_index():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 400):
        s = np.append(rng.integers(0, 4, n), 0)
        n += 1
        zeros = np.cumsum(s == 0)
        keyed = [(0, int(zeros[i])) if s[i] == 0 else (1, int(s[i])) for i in range(n)]
        assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: keyed[i:])
        index = FmIndex(s)
        for k in (1, 2, 3):
            phrases = rng.integers(1, 5, (6, k))
            which, lo, hi = index.search(phrases)
            found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
            for j, p in enumerate(phrases.tolist()):
                assert found.get(j, []) == [i for i in range(n - k + 1) if s[i : i + k].tolist() == p]


def brute(items, text):
    fold = str.maketrans({c: c + 32 for c in range(65, 91)})
    words, hit, ids = WORD.findall(text.translate(fold)), set(), set()
    for item, t in items:
        w = WORD.findall((t or "").translate(fold))
        for i in range(max(1, len(w) - 9) if w else 0):
            p = w[i : i + 10]
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    ids.add(item)
    return len(words), len(hit), sorted(ids - {None})


def test_against_brute_force_and_blocks():
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "B", "c", "é", "d1"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([0, 1, 4, 10, 12, 14])))) for i in range(12)] + [(None, "zz top"), ("9", None)]
    texts = ["", "zz, TOP!"] + [" - ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)]
    for cut in (len(items), 5):
        blocks = [phrases_of(items[:cut]), phrases_of(items[cut:])]
        got = list(zip(*find([lambda b=b: b for b in blocks], texts)))
        assert [(w, h, i) for w, h, i, _ in got] == [brute(items, t) for t in texts]


def test_spans_edge_rows_and_clashes(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (None, "gamma delta"), (1, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, beta y", "q"), (2, None, "q"), (3, "", "q"), (4, "gamma delta alpha beta", "q"), (4, "gamma delta alpha beta", "q")], "doc_id long, text string, n_hit string")
    out = find_contamination(docs, bench).withColumn("clean", without_spans(F.col("text"), F.col("bench_spans")))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.bench_items, r.clean) for r in out.collect() if r.doc_id != 2)
    assert got == [(1, 4, 2, ["1"], "x  y"), (3, 0, 0, [], ""), (4, 4, 4, ["1"], ""), (4, 4, 4, ["1"], "")]
    assert [(r.n_words, r.n_hit, r.clean) for r in out.where("doc_id = 2").collect()] == [(0, 0, None)]
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in find_contamination(docs, bench.limit(0)).collect()} == {0}
    small = find_contamination(docs, bench, block_bytes=5)
    assert sorted((r.doc_id, r.n_hit) for r in small.collect()) == [(1, 2), (2, 0), (3, 0), (4, 4), (4, 4)]


def test_query(spark, small):
    same(op5_decontamination(spark, small), ORACLE_SQL["op5_decontamination"], small)
