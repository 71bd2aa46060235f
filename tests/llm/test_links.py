"""Links of crowded buckets: none is lost, and no more pairs are made than the sets call for."""

import random

from furrow.llm import links


def jaccard(x, y):
    return len(x & y) / len(x | y)


def brute_links(sets, comps, least):
    return {(b, a) for a in sets for b in sets if a < b and comps[a] != comps[b] and jaccard(sets[a], sets[b]) >= least}


def frames(spark, sets):
    contents = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "item long, content array<long>").repartition(4)
    sizes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "item long, size long")
    return sizes, lambda wanted: contents.join(wanted, "item")


def joined_by(spark, key, since):
    """Rows made by the joins on `key` without further condition, in the queries from number `since` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    made = 0
    for k in range(since, store.executionsCount()):
        run = store.executionsList(k, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and f" [{key}#" in node.desc() and "(" not in node.desc():
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                        made += int(values.get(metric.accumulatorId()).get().replace(",", ""))
    return made


def most_rows(spark, since):
    """The most rows that one join or generator made in the queries from number `since` on, and the next number."""
    store = spark._jsparkSession.sharedState().statusStore()
    most, n = 0, store.executionsCount()
    for k in range(since, n):
        run = store.executionsList(k, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if any(x in node.name() for x in ("Join", "Generate")):
                for j in range(node.metrics().size()):
                    metric = node.metrics().apply(j)
                    value = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        most = max(most, int(value.get().replace(",", "")))
    return most, n


def test_links_of_sets_near_the_bound(spark):
    """Sizes, shared shares and components of all kinds, with many pairs of a similarity of exactly 0.8."""
    rng = random.Random(31)
    sets = {}
    for family in range(12):
        base = [family * 1000 + k for k in range(rng.choice((5, 9, 10, 20, 45)))]
        for _ in range(12):
            own = [100_000 + len(sets) * 100 + k for k in range(rng.randrange(len(base) // 3 + 1))]
            sets[len(sets)] = set(rng.sample(base, len(base) - rng.randrange(len(base) // 4 + 1)) + own + ([7] if rng.random() < 0.5 else []))
    for k in range(30):  # 8m elements shared of 10m, in every second pair all the others in one of them
        m, at = 1 + k % 5, 200_000 + k * 100
        shared, own = set(range(at, at + 8 * m)), list(range(at + 50, at + 50 + 2 * m))
        cut = m if k % 2 else 2 * m
        sets |= {len(sets): shared | set(own[:cut]), len(sets) + 1: shared | set(own[cut:])}
    comps = {i: i if i % 3 or i >= 144 else i // 12 * 12 for i in sets}
    assert sum(abs(jaccard(sets[a], sets[b]) - 0.8) < 1e-12 for a in sets for b in sets if a < b) >= 30
    truth = brute_links(sets, comps, 0.8)
    assert len(truth) > 70
    items = spark.createDataFrame([(i, c) for i, c in comps.items()], "item long, comp long")
    got = links.links_between(items, *frames(spark, sets), lambda c: c, 0.2 + 1e-12)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(truth)


def test_pairs_of_a_crowded_bucket(spark):
    """Sets of one bucket that share 0.67 and lie apart make no pairs of all with all; links among them are found."""
    n = 600
    sets = {i: set(range(80)) | {1000 + 50 * (i // 2 if i % 100 < 2 else n + i) + k for k in range(20)} for i in range(n)}
    members = spark.createDataFrame([(5, i) for i in range(n)], "bucket long, item long")
    sizes, content_of = frames(spark, sets)
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.item: r.label for r in links.classes(members, sizes, content_of, 0.2 + 1e-12).collect()}
    assert got == {i: i - i % 2 if i % 100 < 2 else i for i in range(n)}
    assert most_rows(spark, before)[0] <= 200 * n, "rows of a step grow with the elements of the sets, not with pairs"


def test_common_elements_of_hot_groups_are_not_joined(spark):
    """Two groups of near copies: of each set only the elements before its last, most frequent ones are joined; links are those of all pairs."""
    rng = random.Random(12)
    sets = {}
    for family, n in ((0, 150), (1, 90)):
        for _ in range(n):
            gone, own = rng.sample(range(100), rng.randrange(8, 16)), 10_000 + 100 * len(sets)
            sets[len(sets)] = {family * 1000 + k for k in range(100) if k not in gone} | {own + k for k in range(rng.randrange(4))}
    comps = {i: i - i % 3 for i in sets}
    items = spark.createDataFrame([(i, c) for i, c in comps.items()], "item long, comp long")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = links.links_between(items, *frames(spark, sets), lambda c: c, 0.2 + 1e-12).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(brute_links(sets, comps, 0.8))
    assert joined_by(spark, "e", before) < 0.4 * sum(map(len, sets.values()))


def test_classes_without_sizes(spark):
    """Sets whose sizes nobody counted, also sets far apart in size: classes are those of all pairs inside buckets."""
    rng = random.Random(3)
    sets, members = {}, []
    for family in range(8):
        for k in range(7):
            sets[len(sets)] = set(rng.sample(range(family * 100, family * 100 + 40), (40, 38, 36, 33, 30, 12, 5)[k]))
            members.append((family, len(sets) - 1))
    members = spark.createDataFrame(members, "bucket long, item long")
    label = {i: i for i in sets}
    for b, a in brute_links(sets, label, 0.8):
        low, high = sorted((label[a], label[b]))
        label = {i: low if c == high else c for i, c in label.items()}
    content_of = frames(spark, sets)[1]
    for few in (0, 32):
        got = {r.item: r.label for r in links.classes(members, None, content_of, 0.2 + 1e-12, few=few).collect()}
        assert got == {i: min(j for j in label if label[j] == label[i]) for i in label}


def test_uncounted_sizes_are_counted_once(spark, monkeypatch):
    """Sizes that nobody counted are kept before pairs are measured by them, so no set is made again for its size alone."""
    rng = random.Random(5)
    sets = {i: set(rng.sample(range(40 * (i % 3), 40 * (i % 3) + 40), 34 + i % 6)) for i in range(60)}
    items = spark.createDataFrame([(i, i) for i in sets], "item long, comp long")
    plans, measured = [], links.measured
    monkeypatch.setattr(links, "measured", lambda pairs, sizes, *a: plans.append(sizes._jdf.queryExecution().optimizedPlan().toString()) or measured(pairs, sizes, *a))
    got = links.links_between(items, None, frames(spark, sets)[1], lambda c: links.F.array_distinct(c), 0.2 + 1e-12).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(brute_links(sets, {i: i for i in sets}, 0.8))
    assert len(plans) == 1 and "array_distinct" not in plans[0]
