"""The prefix trie against brute force: copies, long chains, turnless conversations, many and few shards, SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from furrow.llm import prefix_trie as P
from furrow.llm.queries import ORACLE_SQL, op13_prefix_trie
from tests.llm.oracle import same


def brute(convs):
    """convs: {id: [(role, text), ...]} -> rows of all nodes."""
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        own = (len(who) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(repr((min(w), len(p), min(members[p[:-1]]) if p else None, len(w), len(children[p]), leaves[p], saved[p], digest(ends[p]))) for p, w in members.items())


def brute_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def table_of(spark, convs):
    rows = [(c, t, role, text, "x") for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")


def nodes(df, **more):
    return sorted(repr(tuple(r)) for r in P.prefix_trie(P.paths_of(df), **more).collect())


def some_conversations(rng, n):
    texts = ["hi", "é" * 5, "why", "", "so"]
    return {c: [(rng.choice("ua"), rng.choice(texts)) for _ in range(rng.choice([1, 2, 3, 7]))] for c in rng.sample(range(10 * n), n)}


def test_against_brute_force(spark):
    rng = random.Random(11)
    convs = some_conversations(rng, 400)
    convs |= {5000 + k: [("u", "hot"), ("a", "same"), ("u", "end")] for k in range(200)}
    convs |= {6000 + k: [("u", "hot"), ("a", "same"), ("u", "end"), ("a", f"more {k}")] for k in range(50)}
    convs[7000] = [("u", str(k)) for k in range(900)]
    convs[7001] = [("u", str(k)) for k in range(899)] + [("a", "x")]
    df = table_of(spark, convs)
    want = brute(convs)
    for shard_paths in (100_000, 9):
        assert nodes(P.turn_arrays(df), shard_paths=shard_paths) == want
    rebuilt = brute_rebuilt(convs)
    assert nodes(P.rebuilt(P.turn_arrays(df)), shard_paths=9) == brute(rebuilt)


def test_one_path_and_turnless_conversations(spark):
    """Bases that don't exist take away first turns: conversations without any turn are members of the root alone."""
    convs = {100 * k + 7: [("u", "a")] for k in range(1, 30)}
    rebuilt = brute_rebuilt(convs)
    assert any(not t for t in rebuilt.values())
    assert nodes(P.rebuilt(P.turn_arrays(table_of(spark, convs)))) == brute(rebuilt)
    same_path = {k: [("u", "a"), ("a", "b")] for k in range(60)}
    assert nodes(P.turn_arrays(table_of(spark, same_path)), shard_paths=4) == brute(same_path)
    assert nodes(P.turn_arrays(table_of(spark, {3: [("u", "a")]}))) == brute({3: [("u", "a")]})


def test_null_values_ties_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 0, "u", "a"), (1, 0, "u", "a"), (2, None, "", ""), (None, 0, "u", "a"), (1, 1, "a", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {1: [("", ""), ("u", "a"), ("u", "a"), ("a", "")], 2: [("", "")]}
    assert nodes(P.turn_arrays(df)) == brute(want)
    assert P.prefix_trie(P.paths_of(P.turn_arrays(df.limit(0)))).count() == 0


def test_roles_and_texts_are_told_apart(spark):
    convs = {1: [("u", "1:a")], 2: [("u1", ":a")], 3: [("", "u1:a")]}
    assert nodes(P.turn_arrays(table_of(spark, convs))) == brute(convs)


@pytest.mark.parametrize("a, b, n", [(b"", b"x" * 16, 0), (b"x" * 48, b"x" * 32 + b"y" * 16, 2), (b"x" * 32, b"x" * 32, 2)])
def test_shared_turns(a, b, n):
    assert P.shared_turns(a, b) == n


def test_query(spark, small):
    same(op13_prefix_trie(spark, small), ORACLE_SQL["op13_prefix_trie"], small)
