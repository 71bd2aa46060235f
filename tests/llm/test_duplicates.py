import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np

from furrow.llm import line_dedup, links
from furrow.llm.line_dedup import deduplicate_lines, dropped_lines
from furrow.llm.near_duplicates import dart_signatures, near_duplicate_classes, one_of_each_class, scramble
from furrow.llm.queries import op4_near_duplicates, op10_line_dedup
from furrow.operators.graph import linked as components
from furrow.operators.graph import shared_folder


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def words_of(text):
    return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower()).split()


def bag(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    """Classes by all pairs; and the pairs so close to the bound that a sketch may miss them."""
    union, bags = Union(), [(i, t, bag(t)) for i, t in rows if t is not None]
    near = []
    for k, (i, t, x) in enumerate(bags):
        union.find(i)
        for j, u, y in bags[:k]:
            if x and y:
                both = sum((x & y).values())
                if both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                    union.join(i, j)
                elif both and both >= 0.7 * (sum(x.values()) + sum(y.values()) - both):
                    near.append((i, j))
            elif not x and not y and t == u:
                union.join(i, j)
    return {i: union.find(i) for i, _ in rows}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 6, 200).astype(float) / 2, rng.integers(1, 6, 200).astype(float) / 2
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for k in range(40):
        e = scramble(np.arange(200, dtype=np.uint64) + np.uint64(10_000 * k))
        s = dart_signatures(np.repeat([0, 1], 200), np.concatenate((e, e)), np.concatenate((a, b)), 2)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - truth) < 0.03


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 203), (203, 201), (7, 7)]
    got = {r.item: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 203: 200}


def test_classes_on_planted_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(40):  # one group of near copies
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(word() for _ in range(60))) for i in range(30)] + [(200, "same"), (201, "Same!"), (202, ""), (203, ""), (204, "?"), (205, None), (206, None), (207, "a b c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()} == brute_classes(rows)
    again = near_duplicate_classes(df.union(df)).groupBy("doc_id", "class_id").count().collect()
    assert {r["count"] for r in again} == {2} and len(again) == len(rows)
    assert near_duplicate_classes(df.limit(0)).count() == 0


def test_classes_on_the_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in op4_near_duplicates(spark, small).collect()}
    truth = brute_classes(rows)
    assert sum(got[i] == c for i, c in truth.items()) >= 0.995 * len(rows)


def brute_dropped(rows):
    union, first, sets = Union(), {}, {}
    for i, text in sorted((i, t) for i, t in rows if t is not None and i is not None):
        for n, line in enumerate(text.split("\n")):
            body = line.strip(" ").lower()
            if body:
                first.setdefault(body, (i, n))
                sets[body] = {body[k : k + 7] for k in range(max(1, len(body) - 6))}
    bodies = sorted(sets, key=lambda b: first[b])
    for k, x in enumerate(bodies):
        for y in bodies[:k]:
            both = len(sets[x] & sets[y])
            if both and both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                union.join(first[x], first[y])
    gone = {}
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            body = line.strip(" ").lower()
            if body and (i, n) != union.find(first[body]):
                gone.setdefault(i, set()).add(n)
    return {i: sorted(n) for i, n in gone.items()}


def test_lines_on_planted_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = [" ".join(word() for _ in range(n)) for n in (3, 12, 22, 24, 70, 200)]
    rows = []
    for i in range(30):
        own = " ".join(word() for _ in range(8))
        some = [line[(i + k) % 6] for k in range(3)]
        some[1] = some[1][: -1 - i % 5] + "zq"[: i % 3]
        rows.append((i, "\n".join([own, *some, "", own.upper() + " ", "}", "x" * 150])))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "  }  "), (54, "y" * 127 + "\n" + "y" * 131)]
    df = spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, dropped int")
    truth = brute_dropped(rows)
    assert {r.doc_id: r.dropped for r in dropped_lines(df).collect()} == truth
    out = {r.doc_id: r.text for r in deduplicate_lines(df).collect()}
    for i, t in rows:
        assert out[i] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in truth.get(i, [])))
    assert deduplicate_lines(df).columns == ["doc_id", "text", "dropped"]
    assert dropped_lines(df.limit(0)).count() == 0


def test_lines_with_long_shared_tokens(spark):
    """Similar lines of many words whose shared text lies inside long tokens."""
    rng = random.Random(6)
    number = lambda: str(rng.randrange(10**4, 10**5))
    rows = []
    for i in range(40):
        token = "".join(rng.choice("abcdefghijklmnop/") for _ in range(900))
        signs = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(900))
        rows += [(4 * i + k, " ".join(number() for _ in range(14)) + " " + token) for k in range(2)]
        rows += [(4 * i + k, "".join(f"{number()} {signs[60 * j : 60 * j + 60]} " for j in range(15))) for k in (2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute_dropped(rows)
    got = {r.doc_id: r.dropped for r in dropped_lines(df).collect()}
    assert len(truth) > 30 and set(got) <= set(truth)
    assert len(got) >= 0.95 * len(truth)


def test_lines_on_the_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    truth = brute_dropped(rows)
    got = {r.doc_id: r for r in op10_line_dedup(spark, small).collect()}
    assert len(got) == len(rows)
    lines = sum(len((t or "").split("\n")) for _, t in rows)
    wrong = sum(len(set(truth.get(i, [])) ^ {int(x) for x in got[i].dropped.split(",") if x}) for i, _ in rows)
    assert wrong <= 0.002 * lines


def test_minima_left_out_are_taken_again(spark):
    """Signatures are those of all shingles, of lines of different shingles and of lines that repeat themselves."""
    rng = random.Random(21)
    some = ["".join(rng.choice("abcdefghijklmnop \U0001f600") for _ in range(n)) for n in (3, 7, 100, 135, 200, 400, 900, 5000)]
    some += [c * n for c in ("x", "ab", "abcdefgh ") for n in (30, 200, 700)] + [some[4] + some[4][:50] * 20]
    df = spark.createDataFrame([(i, "\n".join(some[i % 3 :])) for i in range(6)], "id long, text string")
    columns = ["k1", "k2", "n", *(f"m{k}" for k in range(16))]
    got = line_dedup.signatures(df)
    whole = line_dedup._minima(line_dedup.lines_of(df), None).select(columns).collect()
    assert sorted(got.select(columns).collect()) == sorted(whole) and len(whole) == len(some)
    assert got.select("item").distinct().count() == len(some)
    first = line_dedup._minima(line_dedup.lines_of(df), line_dedup.SPARE)
    assert 0 < first.where("missed").count() < len(some)


def test_small_buckets_need_no_blocks(spark, monkeypatch):
    """Open buckets of few lines are settled by their own pairs; larger ones by blocks, with the same result."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for base in ([word() for _ in range(40)] for _ in range(12)):
        for k in range(5):  # some pairs of a bucket are links, others aren't
            rows.append((len(rows), " ".join(base[: 40 - 3 * k] + [word() for _ in range(3 * k)])))
    df, truth = spark.createDataFrame(rows, "doc_id long, text string"), brute_dropped(rows)
    made, blocks = [], links.links_between
    monkeypatch.setattr(links, "links_between", lambda *a: made.append(1) or blocks(*a))
    assert {r.doc_id: r.dropped for r in dropped_lines(df).collect()} == truth and not made
    monkeypatch.setattr(line_dedup, "FEW", 2)
    assert {r.doc_id: r.dropped for r in dropped_lines(df).collect()} == truth and made


def test_line_path_is_native(spark, small):
    plan = op10_line_dedup(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_without_any_word(spark):
    df = spark.createDataFrame([(1, ""), (2, ""), (3, "?"), (4, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert dropped_lines(df).count() == 0


def test_rows_of_one_id(spark):
    """Different texts of one id are different rows; equal rows are one."""
    rows = [(1, "A line\nShared", "x"), (1, "Shared\nB line", "y"), (1, "Shared\nB line", "y"), (2, "shared ", "z"), (None, "Shared", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_id string")
    out = sorted((r.doc_id or 0, r.text, r.line_id) for r in deduplicate_lines(df).collect())
    kept = [t for i, t, _ in out if i]
    assert sum(t.count("A line") for t in kept) == 1 and sum("B line" in t for t in kept) == 2
    assert {t.lower().count("shared") for t in kept} == {0, 1} and out[0] == (0, "Shared", "n")
    texts = ["one two three four five six", "six five four three two one", "One two three four five six!", "one two three four five six"]
    df = spark.createDataFrame([(1, texts[0], "b"), (1, texts[1], "b"), (0, texts[2], "b"), (1, texts[3], "a"), (1, texts[1], "a"), (None, texts[0], "q"), (3, None, "q"), (3, None, "q")], "doc_id long, text string, class_id string")
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.class_id) for r in one_of_each_class(df).collect())
    assert kept == sorted([(0, texts[2], "b"), (1, texts[1], "a"), (-1, texts[0], "q"), (3, "", "q"), (3, "", "q")])
    got = sorted(tuple(-1 if x is None else x for x in (r.doc_id, r.class_id)) for r in near_duplicate_classes(df).collect())
    assert got == sorted([(1, 0), (1, 1), (0, 0), (1, 0), (1, 1), (-1, -1), (3, 3), (3, 3)])


def test_very_long_lines_and_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh \U0001f600") for _ in range(400_000))
    words = " ".join(rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randrange(10**6)) for _ in range(150_000))
    df = spark.createDataFrame([(1, long), (2, long[:-40]), (3, words), (4, words + " and more")], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in dropped_lines(df).collect()} == {2: [0], 4: [0]}
    assert {r.doc_id: r.class_id for r in near_duplicate_classes(df.where("doc_id > 2")).collect()} == {3: 3, 4: 3}


def test_one_group_of_a_third_of_all_lines(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghij ") for _ in range(150)).strip() + "x"
    rows = [(i, (base[: 20 + i % 100] + "#" + base[21 + i % 100 :]) if i % 3 == 0 else "".join(rng.choice("klmnopqrst ") for _ in range(80))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in dropped_lines(df).collect()} == brute_dropped(rows)


def test_recall_of_planted_pairs_by_similarity(spark):
    """Pairs of one known similarity each: replaced last words take as many shingles from one side as they add to the other."""
    rng, shingles, each, rows, planted = random.Random(12), 200, 60, [], {}
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    for similarity in (0.6, 0.7, 0.78, 0.805, 0.85, 0.9, 0.95):
        for _ in range(each):
            words = [word() for _ in range(shingles + 4)]
            m = int(shingles * (1 - similarity) / (1 + similarity))
            planted[len(rows)] = (similarity, (shingles - m) / (shingles + m))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-m] + [word() for _ in range(m)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    cls = {r.doc_id: r.class_id for r in near_duplicate_classes(df).collect()}
    found = {}
    for i, (wanted, exact) in planted.items():
        found.setdefault(wanted, []).append(cls[i] == cls[i + 1])
        assert exact >= 0.8 or cls[i] != cls[i + 1], "no link below the threshold"
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    assert recall[0.6] == recall[0.7] == recall[0.78] == 0 and all(recall[k] >= 0.9 for k in (0.805, 0.85, 0.9, 0.95)), recall
    assert recall[0.9] == recall[0.95] == 1.0


def test_line_dedup_lets_go_of_its_tables(spark, small, monkeypatch):
    """Signatures and places of repeated lines are gone when the result is read; texts are hashed, not sorted, to meet many dropped lines."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted(tuple(r) for r in deduplicate_lines(docs).select("doc_id", "text").collect())
    folder = shared_folder(spark)
    before = set(os.listdir(folder.removeprefix("file:")))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    out = deduplicate_lines(docs).select("doc_id", "text")
    new = set(os.listdir(folder.removeprefix("file:"))) - before
    columns = {c for name in new for c in spark.read.parquet(f"{folder}/{name}").columns}
    assert not columns & {"m0", "line_group", "keeper"}
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == want
