"""Classes of similar items from bucketed candidates, with no group in one task and no lost link.

`classes` takes bucket memberships, the sizes of items' sets if they are known, and a function that gives the contents of
items, and returns the connected components of pairs whose Jaccard distance, which is a metric, is within a bound. Sets whose
known sizes alone keep them too far apart are never compared. A bucket isn't expanded into all its pairs:

1. Each member is measured against one hub of its bucket. Pairs within the threshold are links. That settles buckets of two.
2. Other buckets whose members already share one component need no more. In the others, one member of each component is
   measured against a new hub out of the bucket's largest component, for `HUB_ROUNDS` rounds.
3. What is left are members outside the largest component of their bucket, the others outside it, and that component
   unless the triangle inequality over a hub proves them too far apart. Of all these sets, each pair of two components
   that has its first common element early enough for a link, in an order of rare elements first, is measured. That
   loses no link, and sets that differ by elements of their own alone make no pair.

Small buckets may take all their pairs instead of 2 and 3.

All tables are keyed and spread by item or bucket; the steps between rounds are cut by checkpoints in the shared
folder, so a lost executor costs a part of one round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.graph import cut, gathered, linked, ordered_pair, release, stored

HUB_ROUNDS = 2
#: A table of at most so many narrow rows may be broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 400_000
#: The most frequent elements, of at least so many items, that are told apart from the others; a matter of speed alone.
LAST, FREQUENT = 32_768, 16

#: From (item) to (item, content); `elements` below turns a content into the item's set, an array without repeats.
ContentOf = Callable[[DataFrame], DataFrame]
Elements = Callable[[Column], Column]


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a counted table of few narrow rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """`comps` (item, label) after the links `more` (a, b) between its items."""
    ends = [comps.select(F.col("item").alias(c), F.col("label").alias(f"{c}2")) for c in "ab"]
    merged = linked(more.join(ends[0], "a").join(ends[1], "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")))
    return gathered(comps.join(merged.select(F.col("item").alias("label"), F.col("label").alias("to")), "label", "left").select("item", F.coalesce("to", "label").alias("label")))


def _distance(x, y):
    common = F.size(F.array_intersect(x, y))
    return 1 - common / (F.size(x) + F.size(y) - common)


def measured(pairs: DataFrame, sizes: DataFrame | None, content_of: ContentOf, elements: Elements, most: float) -> DataFrame:
    """(a, b, distance, exact) of pairs (a, b): 1 less the exact Jaccard similarity of their sets, or with `sizes` a lower bound over `most`."""
    if sizes is None:
        pairs = gathered(pairs.select("a", "b", F.lit(0.0).alias("distance")))
    else:
        ends = [sizes.select(F.col("item").alias(c), F.col("size").alias(n)) for c, n in (("a", "m"), ("b", "n"))]
        bound = 1 - F.least("m", "n") / F.greatest("m", "n")
        pairs = gathered(pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", F.when((F.col("m") > 0) & (F.col("n") > 0), bound).otherwise(0.0).alias("distance")))
    close = pairs.where(F.col("distance") <= most).select("a", "b")
    contents = content_of(gathered(close.select(F.col("a").alias("item")).union(close.select(F.col("b").alias("item"))).distinct()))
    both = close.join(contents.select(F.col("item").alias("a"), F.col("content").alias("x")), "a").join(contents.select(F.col("item").alias("b"), F.col("content").alias("y")), "b")
    both = both.select("a", "b", elements(F.col("x")).alias("x"), elements(F.col("y")).alias("y"))
    both = both.select("a", "b", _distance(F.col("x"), F.col("y")).alias("distance"), F.lit(True).alias("exact"))
    return both if sizes is None else both.union(pairs.where(F.col("distance") > most).select("a", "b", "distance", F.lit(False).alias("exact")))


def links_between(items: DataFrame, sizes: DataFrame | None, content_of: ContentOf, elements: Elements, most: float) -> DataFrame:
    """All links (a, b) between `items` (item, comp) of different components, whether they share a bucket or not.

    Elements are put into one order for all sets: first those of a single component, then rare before frequent ones. Sets of
    a link have their first common element so early in both that what is left of either suffices for what they must have in
    common. So only those places are joined, and such pairs measured. The most frequent elements of all come last in every
    set that has them: as many as a set must share with any other are only counted there. Pairs inside a component are never
    made: of an element's items those outside its largest component meet the others.
    """
    share = (1 - most) / (2 - most)
    contents = stored(content_of(items.select("item")).join(items, "item").select("item", "comp", "content"))
    if sizes is None:
        # read for the sets and for both ends of their pairs, so counted once and kept
        sizes = gathered(contents.select("item", F.size(elements(F.col("content"))).alias("size")))
    held = contents.select("item", "comp", F.explode(elements(F.col("content"))).alias("e"))
    often = held.groupBy("e").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("e", "n")
    often = gathered(often)
    last = often.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), F.desc("e")).limit(LAST).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "e")), asc=False), lambda x: x.e).alias("last"))
    # the last places of a set, one less than it needs in common with the shortest set that it may be linked to
    needed = F.greatest(F.floor((1 - most) * F.col("size") - 1e-6).cast("int") - 1, F.lit(0))
    sets = contents.join(sizes, "item").crossJoin(F.broadcast(last)).select("item", "comp", "size", elements(F.col("content")).alias("es"), "last")
    # the intersection keeps the order of its first array
    sets = sets.select("item", "comp", "size", F.size("es").alias("all"), F.array_except("es", F.slice(F.array_intersect("last", "es"), F.lit(1), needed)).alias("rest"))
    head = sets.select("item", "comp", "size", (F.col("all") - F.size("rest")).alias("counted"), F.explode("rest").alias("e"))
    orders = head.join(small_side(often, often.count()), "e").groupBy("item", "comp", "size", "counted").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("es"))
    orders = orders.select("item", "comp", "size", (F.size("es") + F.col("counted")).alias("shared"), "es")
    # where more is left than a set needs in common with the shortest set that it may be linked to
    places = F.greatest(F.floor(F.col("shared") - (1 - most) * F.col("size") + 1e-6) + 1, F.lit(0)).cast("int")
    early = orders.select("item", "comp", "size", "shared", F.posexplode(F.slice("es", F.lit(1), places)).alias("i", "x"))
    early = gathered(early.select("item", "comp", "size", (F.col("shared") - F.col("i")).alias("left"), F.col("x.e").alias("e")))
    main = early.groupBy("e", "comp").agg(F.count("*").alias("n")).groupBy("e").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("e", F.col("m.comp").alias("main"))
    minor = early.join(main, "e").where("comp <> main")
    other = early.select("e", *(F.col(c).alias(f"{c}2") for c in ("item", "comp", "size", "left")))
    apart = (F.col("comp") != F.col("comp2")) & ((F.col("comp2") == F.col("main")) | (F.col("item") > F.col("item2")))
    pairs = minor.join(other, "e").where(apart & (F.least("left", "left2") >= (F.col("size") + F.col("size2")) * share - 1e-6))
    pairs = gathered(pairs.select(*ordered_pair("item", "item2")).distinct())
    met = measured(pairs, sizes, lambda wanted: contents.select("item", "content").join(wanted, "item"), elements, most)
    return met.where(F.col("distance") <= most).select("a", "b")


def classes(members: DataFrame, sizes: DataFrame | None, content_of: ContentOf, most: float, elements: Elements = lambda content: content, few: int = 0) -> DataFrame:
    """(item, label) of all items of `members`; label is the least item of the class. members: (bucket, item), distinct; sizes: (item, size) of their sets, or None where counting them all costs more than measuring pairs of unlike sizes; most: the largest distance of a link.

    Open buckets of up to `few` items are settled by the pairs of their components, one by one, instead of steps 2 and 3.
    """
    members = gathered(members)
    if sizes is not None:
        sizes = gathered(sizes.join(members.select("item").distinct(), "item", "left_semi"))
    hubs = members.groupBy("bucket").agg(F.min("item").alias("hub"))
    tested = first = gathered(measured(members.join(hubs, "bucket").where("item <> hub").select(*ordered_pair("item", "hub")).distinct(), sizes, content_of, elements, most))
    found = linked(tested.where(F.col("distance") <= most).select("a", "b"))
    # a bucket of two has no pair but that with its hub
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 2")
    several = gathered(members.join(several, "bucket").select("bucket", "item", "n"))
    comps = gathered(members.select("item").distinct().join(found, "item", "left").select("item", F.coalesce("label", "item").alias("label")))
    # distances to the bucket's first hub
    near = reduce(DataFrame.union, (first.select(F.col(x).alias("item"), F.col(y).alias("hub"), "distance", "exact") for x, y in (("a", "b"), ("b", "a"))))
    if few:
        pairs = few_pairs(several.where(F.col("n") <= few), comps, hubs, near, most)
        fresh = gathered(measured(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sizes, content_of, elements, most))
        more = fresh.where(F.col("distance") <= most).select("a", "b")
        if not more.isEmpty():
            comps = joined(comps, more)
    several = several.where(F.col("n") > few).select("bucket", "item")
    for k in range(HUB_ROUNDS):
        release(members.sparkSession)
        # a bucket of one component stays so
        several = open_ = gathered(open_buckets(several.select("bucket", "item"), comps))
        if open_.isEmpty():
            return comps
        # a member of the bucket's largest component, drawn by a hash of this round, against one of each other component
        picked = open_.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(k), "bucket", "item").alias("d"), "item")).alias("p")).select("bucket", "n", "comp", F.col("p.item").alias("item"))
        hub = picked.groupBy("bucket").agg(F.max(F.struct("n", "comp", "item")).alias("p")).select("bucket", F.col("p.item").alias("hub"))
        pairs = picked.join(hub, "bucket").where("item <> hub").select(*ordered_pair("item", "hub")).distinct()
        fresh = gathered(measured(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sizes, content_of, elements, most))
        tested = tested.union(fresh)
        more = fresh.where(F.col("distance") <= most).select("a", "b")
        if not more.isEmpty():
            comps = joined(comps, more)
    release(members.sparkSession)
    rest = gathered(open_buckets(several.select("bucket", "item"), comps))
    if rest.isEmpty():
        return comps
    main = rest.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m")).select("bucket", F.col("m.comp").alias("main"))
    # distances to the first hub bound what is left: an item farther from it than the main component's farthest
    # member, by more than the largest distance of a link, has no link to that component
    rest = rest.join(main, "bucket").join(hubs, "bucket").join(near, ["item", "hub"], "left")
    rest = gathered(rest.select("bucket", "item", "comp", "main", F.when(F.col("item") == F.col("hub"), 0.0).otherwise(F.col("distance")).alias("distance"), F.coalesce("exact", F.lit(True)).alias("exact")))
    far = rest.where("comp = main").groupBy("bucket").agg(F.max(F.when(F.col("exact"), F.col("distance")).otherwise(1.0)).alias("far"), F.count_if(F.col("distance").isNull()).alias("unknown"))
    minor = gathered(rest.where("comp <> main").select("bucket", "item", "main", "distance"))
    close = minor.join(far, "bucket").where((F.col("unknown") > 0) | F.col("distance").isNull() | (F.col("distance") - F.col("far") <= most + 1e-9))
    close = gathered(close.select(F.col("main").alias("arena"), "item").distinct())
    core = rest.where("comp = main").join(close.select(F.col("arena").alias("main")).distinct(), "main", "left_semi").select("item")
    among = minor.select("bucket", "item")
    crowd = among.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    items = close.select("item").union(core).union(among.join(crowd, "bucket", "left_semi").select("item")).distinct()
    items = gathered(items.join(rest.select("item", "comp").distinct(), "item"))
    more = links_between(items, sizes, content_of, elements, most)
    more = gathered(more)
    return comps if more.isEmpty() else joined(comps, more)


def few_pairs(members: DataFrame, comps: DataFrame, hubs: DataFrame, near: DataFrame, most: float) -> DataFrame:
    """Pairs (a, b) of different components inside a bucket, but those that their distances to its hub keep too far apart."""
    open_ = open_buckets(members, comps).join(hubs, "bucket").join(near, ["item", "hub"], "left")
    open_ = gathered(open_.select("bucket", "item", "comp", F.when(F.col("item") == F.col("hub"), 0.0).otherwise(F.col("distance")).alias("d"), F.coalesce("exact", F.lit(True)).alias("exact")))
    met = open_.join(open_.select("bucket", *(F.col(c).alias(f"{c}2") for c in ("item", "comp", "d", "exact"))), "bucket").where("item > item2 and comp <> comp2")
    apart = ((F.col("exact") & (F.col("d2") - F.col("d") > most + 1e-9)) | (F.col("exact2") & (F.col("d") - F.col("d2") > most + 1e-9)))
    return met.where(~F.coalesce(apart, F.lit(False))).select(F.col("item").alias("a"), F.col("item2").alias("b")).distinct()


def open_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (bucket, item, comp) of the buckets that hold more than one component."""
    members = members.join(comps, "item").select("bucket", "item", F.col("label").alias("comp"))
    span = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    return members.join(span, "bucket")


def crowded(bands: DataFrame) -> DataFrame:
    """(bucket, item) of the buckets with two items or more; bands: (bucket, item), distinct.

    Buckets of two are known by their least and greatest item; only items of larger ones are joined to their buckets.
    """
    full = gathered(bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("item").alias("lo"), F.max("item").alias("hi")).where("n > 1"))
    two, more = full.where("n = 2").select("bucket", F.explode(F.array("lo", "hi")).alias("item")), full.where("n > 2").select("bucket")
    return two.unionByName(bands.join(small_side(more, more.count()), "bucket").select("bucket", "item"))
