"""The trie of conversation prefixes, by sorted shards and a skeleton of splitter paths.

A turn is known by the first 128 bits of a SHA-256 of its role and text. A conversation's path is its turns' digests, one
behind the other, so paths sort bytewise and a prefix comes before what extends it. Paths are dealt to shards between
splitters, which are (path, conversation) pairs of the table itself, drawn from a sample by hash. The splitters' paths,
sorted and with the number of turns that neighbours share, are the skeleton: a trie that is broadcast.

A node that reaches over a shard's border is a prefix of the splitter at that border. So every other node lies in one
shard and is finished there by one walk over its sorted paths with a stack; nodes of the skeleton yield a partial row in
every shard that they reach. All figures of a node are sums or minima over shards (a node's children, leaves and the one
conversation that isn't saved count where it closes, which the next splitter tells), so skeleton nodes are finished by
one grouped reduction. Copies of one path are told apart by the conversation, so no group of copies is bound to one shard.

Null roles and texts are empty; turns come in order of `turn`, nulls first, equal ones by role and then by digest.
Repeated rows are turns of their own. Rows without a conversation are left out. Empty tables give no node. Extra columns
don't matter. Texts are reduced to a digest and a length before any shuffle; a path takes 20 bytes a turn, and a task holds
one shard of paths, so conversations are bounded by what a task can hold of their digests, not of their texts. Digests of
the members that end at a node are made from a stream: a hot node needs no more memory than others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.graph import stored

DIGEST = 16
SHARD_PATHS = 100_000
#: Sampled paths a splitter, on average.
SAMPLE_EACH = 16
CHUNK_IDS = 10_000
_OUT = "kind string, owner long, depth long, up_owner long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, shard long, place long, ends string"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest in hexadecimal, code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("chars")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % `every`; h = crc32(c) % `most`.

    Fewer turns of the other than h are all taken, none if it doesn't exist; turns of c after its first h stay.
    """
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h})
    head = F.slice(F.coalesce("head", F.array().cast(turns.schema["turns"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, path, chars): paths as bytes, and the code points of each turn."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"].cast("int")).alias("chars"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the first on."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Skeleton:
    """The trie of the splitters' paths: a node is (owner, depth), owner being the first splitter with that prefix."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.owners: list[np.ndarray] = []
        for k, (path, _) in enumerate(splitters):
            own = np.full(len(path) // DIGEST + 1, k, np.int64)
            if k:
                shared = shared_turns(splitters[k - 1][0], path) + 1
                own[:shared] = self.owners[-1][:shared]
            self.owners.append(own)

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))

    def path(self, k: int) -> bytes | None:
        return self.splitters[k][0] if 0 <= k < len(self.splitters) else None

    def owner(self, shard: int, path: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """For the splitters on both sides of a shard: how deep the path is theirs, and who owns those nodes."""
        for k in (shard - 1, shard):
            if 0 <= k < len(self.splitters):
                yield shared_turns(path, self.splitters[k][0]), self.owners[k]


def choose_splitters(paths: DataFrame, shards: int, rows: int) -> list[tuple[bytes, int]]:
    """`shards` - 1 (path, conversation) pairs at even places of a sample by hash, about `SAMPLE_EACH` a shard."""
    if shards < 2:
        return []
    one_in = max(1, rows // (shards * SAMPLE_EACH))
    drawn = sorted((bytes(r["path"]), r["conv_id"]) for r in paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(one_in)) == 0).select("path", "conv_id").toLocalIterator())
    return sorted({drawn[len(drawn) * k // shards] for k in range(1, shards)}) if drawn else []


class _Node:
    __slots__ = ("depth", "chars", "owner", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, chars: int, owner: int):
        self.depth, self.chars, self.owner = depth, chars, owner  # owner -1: not in the skeleton
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[list] = []  # rows of finished children, which want this node's least member


def walk_shard(skeleton: Skeleton, shard: int, rows: Iterator[tuple[bytes, int, list[int]]]) -> Iterator[list]:
    """Rows of finished nodes and partial rows of skeleton nodes, from a shard's paths in order."""
    stack: list[_Node] = []

    def partial(node: _Node) -> Iterator[list]:
        yield ["part", node.owner, node.depth, stack[-1].owner if stack else None, node.least, None, node.n, node.children, node.leaves, node.saved, shard, 0, None]
        for k in range(0, len(node.ends), CHUNK_IDS):
            yield ["ends", node.owner, node.depth, None, None, None, None, None, None, None, shard, k // CHUNK_IDS, ",".join(map(str, node.ends[k : k + CHUNK_IDS]))]

    def leave(closes: bool) -> Iterator[list]:
        """Takes the deepest node off the stack; it is finished, or goes on in the next shard."""
        node = stack.pop()
        node.saved += node.n * node.chars
        if closes:
            node.saved -= node.chars
            node.leaves += node.children == 0
        for row in node.waiting:
            row[5] = node.least if node.owner < 0 else None
            yield row
        if stack:
            up = stack[-1]
            up.n, up.leaves, up.saved = up.n + node.n, up.leaves + node.leaves, up.saved + node.saved
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.children += closes
        if node.owner >= 0:
            yield from partial(node)
        else:
            ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
            row = ["node", stack[-1].owner, node.depth, None, node.least, None, node.n, node.children, node.leaves, node.saved, None, None, ends]
            stack[-1].waiting.append(row)

    def deeper(path: bytes, chars: list[int]) -> None:
        """Opens the nodes of a path below the stack."""
        known = list(skeleton.owner(shard, path))
        for depth in range(len(stack), len(chars) + 1):
            owner = next((int(o[depth]) for d, o in known if depth <= d), 0 if depth == 0 else -1)
            stack.append(_Node(depth, chars[depth - 1] if depth else 0, owner))

    before: bytes | None = None
    for path, conv, chars in rows:
        if before is not None:
            shared = shared_turns(before, path)
            while len(stack) > shared + 1:
                yield from leave(True)
        deeper(path, chars)
        node = stack[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ends.append(conv)
        before = path
    if before is not None:
        after = skeleton.path(shard)
        shared = -1 if after is None else shared_turns(before, after)
        while stack:
            yield from leave(len(stack) > shared + 1)


def _finished(rows: Iterator[list], names: list[str], types) -> Iterator[pa.RecordBatch]:
    block: list[list] = []
    for row in rows:
        block.append(row)
        if len(block) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types, strict=True)], names)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types, strict=True)], names)


def _digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, digest) of the members that end at skeleton nodes, from chunks in order; nothing is gathered."""

    def run(batches):
        key, state, done = None, None, ([], [], [])
        for batch in batches:
            for owner, depth, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (owner, depth) != key:
                    if key is not None:
                        for column, value in zip(done, (*key, state.hexdigest()), strict=True):
                            column.append(value)
                    key, state = (owner, depth), hashlib.sha256(chunk.encode())
                else:
                    state.update(b"," + chunk.encode())
        if key is not None:
            for column, value in zip(done, (*key, state.hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], ["owner", "depth", "ends_sha256"])

    dealt = ends.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "shard", "place")
    return dealt.select("owner", "depth", "ends").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def prefix_trie(paths: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """One row a node of the trie of `paths` (conv_id, path, chars), conv_id unique.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of the
    members that end at the node, ascending). There are at least as many shards as shuffle partitions, and none is much
    larger than `shard_paths`.
    """
    spark = paths.sparkSession
    paths = stored(paths)
    rows = paths.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // shard_paths))
    skeleton = Skeleton(choose_splitters(paths, shards, rows))
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(batches):
        for batch in batches:
            keys = [shared.value.shard(p, c) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "shard"])

    names = [c.split()[0] for c in _OUT.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in _OUT.split(", ")]

    def finish(key, table):
        order = sorted(zip(*(table.column(c).to_pylist() for c in ("path", "conv_id", "chars")), strict=True), key=lambda r: r[:2])
        batches = list(_finished(walk_shard(shared.value, key[0].as_py(), iter(order)), names, types))
        return pa.Table.from_batches(batches, pa.schema(list(zip(names, types, strict=True))))

    dealt = paths.select("conv_id", "path", "chars").mapInArrow(deal, "conv_id long, path binary, chars array<int>, shard long")
    found = stored(dealt.groupBy("shard").applyInArrow(finish, _OUT))

    parts = found.where("kind = 'part'").groupBy("owner", "depth").agg(F.min("up_owner").alias("up_owner"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    whole = stored(parts.join(_digests(found.where("kind = 'ends'")), ["owner", "depth"], "left"))
    ups = whole.select(F.col("owner").alias("up_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("up_conv"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = hashlib.sha256(b"").hexdigest()
    bones = whole.join(ups, ["up_owner", "depth"], "left").withColumns({"parent_conv_id": F.col("up_conv"), "ends_sha256": F.coalesce("ends_sha256", F.lit(none))}).select(*out)
    # owner of a finished node's row is its parent's, or -1
    local = found.where("kind = 'node'").drop("up_owner").withColumnsRenamed({"owner": "up_owner", "ends": "ends_sha256"})
    deep = local.where("up_owner < 0").select(*out)
    hung = local.where("up_owner >= 0").join(ups, ["up_owner", "depth"], "left").withColumn("parent_conv_id", F.col("up_conv")).select(*out)
    return bones.unionByName(deep).unionByName(hung)
