"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its 5-word shingles, weighted by how often each occurs. Every shingle has one region
of unit height for each unit of its weight; a hashed Poisson process throws darts into it, along an axis of ranks, the
same darts in every document that has the region. Only darts below a rank bound are thrown, chosen so that each of the
coordinates is met, and the earliest dart of a coordinate is kept; where one stayed empty the bound is doubled. Two
documents agree in a coordinate with probability equal to their weighted Jaccard similarity. Coordinates are banded;
documents that share a band are candidates, their exact weighted similarity is computed, and pairs of 0.8 or more are
links. A class is a connected component.

Words are runs of letters, marks and digits, in lower case. Documents of fewer than 5 words, but not none, are one
shingle. Texts with equal words form a group first, so copies cost one sketch each and no pair. Texts without a word
are copies only of equal texts. A null text or a null id is a class of its own (class_id is the id). Rows of one id with
different texts are different documents; repeated rows give repeated rows. Very long texts are read whole, in arrays
that grow with their length. Other columns are not read. An empty table gives an empty result. The functions run many
Spark jobs while the result is being built.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.links import classes, crowded, small_side
from furrow.llm.text_codes import Words, fresh, runs
from furrow.operators.graph import cut, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
COORDINATES = BANDS * ROWS
#: Darts thrown for each coordinate, on average, before any bound is doubled.
DARTS = 7.6
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def scramble(h: np.ndarray) -> np.ndarray:
    h = h + _A
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """A number in (0, 1] from each hash."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


class Shingles:
    """Distinct shingles of each text of a run, with weights: doc, hash, weight, by doc and hash."""

    def __init__(self, texts: list[str]):
        words = Words(texts, "LMN")
        self.words, n = words, len(words)
        place = np.arange(len(words.codes)) - np.repeat(np.concatenate(([0], words.starts)), np.diff(np.concatenate(([0], words.starts, [len(words.codes)]))))
        power = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x100000001B3, np.uint64))
        term = np.where(words.space, np.uint64(0), (words.codes + np.uint64(7)) * power[place])
        h = scramble(np.add.reduceat(term, words.starts)) if n else np.zeros(0, np.uint64)
        first = np.flatnonzero(np.diff(words.doc, prepend=-1))
        self.docs, size = words.doc[first], np.diff(np.append(first, n))
        count = np.maximum(size - SHINGLE + 1, 1)
        doc = np.repeat(self.docs, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        end = np.repeat(first + size, count)
        s = np.zeros(len(at), np.uint64)
        padded = np.append(h, np.zeros(SHINGLE, np.uint64))
        for k in range(SHINGLE):
            s = scramble(s ^ np.where(at + k < end, padded[at + k], np.uint64(0)))
        order = np.lexsort((s, doc))
        doc, s = doc[order], s[order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])))[: len(s)]
        at = np.flatnonzero(new)
        self.doc, self.hash, self.weight = doc[at], s[at], np.diff(np.append(at, len(s)))
        self.total = dict(zip(self.docs.tolist(), count.tolist(), strict=True))


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, coordinates: int = COORDINATES) -> np.ndarray:
    """Signatures (docs, coordinates) of weighted sets with positive weights; docs number the sets from 0."""
    slabs = np.ceil(weight).astype(np.int64)
    layer = np.arange(slabs.sum()) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    owner, region = np.repeat(doc, slabs), scramble(np.repeat(element, slabs) + layer.astype(np.uint64) * _B)
    height = np.minimum(np.repeat(weight, slabs) - layer, 1.0)
    mass = np.bincount(doc, weight, docs)
    bound = coordinates * DARTS / np.maximum(mass, 1e-12)
    signature = np.zeros((docs, coordinates), np.uint64)
    todo = mass > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        own, h, rank, tall = owner[live], region[live], np.zeros(len(live)), height[live]
        found_own, found_rank, found_id = [], [], []
        while len(own):
            h = scramble(h)
            rank = rank - np.log(unit(h))
            below = rank <= bound[own]
            own, h, rank, tall = own[below], h[below], rank[below], tall[below]
            dart = scramble(h ^ _C)
            inside = (unit(scramble(dart ^ _A)) <= tall) if (tall < 1).any() else slice(None)
            found_own.append(own[inside])
            found_rank.append(rank[inside])
            found_id.append(dart[inside])
        own, rank, dart = (np.concatenate(x) for x in (found_own, found_rank, found_id))
        cell = own * coordinates + ((dart >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64)
        late = np.argsort(-rank, kind="stable")  # the earliest is written last
        flat = np.zeros(docs * coordinates, np.uint64)
        flat[cell[late]] = dart[late] | np.uint64(1)
        got = flat.reshape(docs, coordinates)
        full = todo & (got != 0).all(axis=1)
        signature[full] = got[full]
        todo &= ~full
        bound[todo] *= 2
    return signature


def sketches(texts: list[str]) -> tuple[list[bytes], list[list[int]], list[int]]:
    """(key of equal word sequences, band hashes, total weight) of each text; no bands without a word."""
    shingles = Shingles(texts)
    words, number = shingles.words, np.full(len(texts), -1)
    number[shingles.docs] = np.arange(len(shingles.docs))
    keys = [b""] * len(texts)
    first = np.flatnonzero(np.diff(words.doc, prepend=-1))
    edges = np.append(words.starts[first], len(words.codes)) if len(first) else [0]
    codes = words.codes.astype(np.uint32)
    for d, a, b in zip(shingles.docs.tolist(), edges[:-1], edges[1:], strict=True):
        keys[d] = hashlib.blake2b(codes[a:b].tobytes(), digest_size=16).digest()
    signature = dart_signatures(number[shingles.doc], shingles.hash, shingles.weight.astype(float), len(shingles.docs))
    bands = np.zeros((len(shingles.docs), BANDS), np.uint64)
    for r in range(ROWS):
        bands = scramble(bands ^ signature[:, r::ROWS])
    bands = scramble(bands ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()
    for i, t in enumerate(texts):
        if number[i] < 0:
            keys[i] = hashlib.blake2b(b"raw" + t.encode(), digest_size=16).digest()
    return keys, [bands[k] if k >= 0 else [] for k in number.tolist()], [shingles.total.get(i, 0) for i in range(len(texts))]


def elements(texts: list[str]) -> list[np.ndarray]:
    """A hash of every (shingle, unit of weight) of each text."""
    s = Shingles(texts)
    layer = np.arange(s.weight.sum()) - np.repeat(np.cumsum(s.weight) - s.weight, s.weight)
    doc, h = np.repeat(s.doc, s.weight), scramble(np.repeat(s.hash, s.weight) + layer.astype(np.uint64) * _B)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [h[a:b].view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sketch(df: DataFrame) -> DataFrame:
    """(id, t1, t2, key, bands, size) of rows (id, t1, t2, text)."""

    def run(batches):
        for batch in batches:
            for lo, texts in runs(batch.column(3).to_pylist()):
                keys, bands, sizes = sketches(texts)
                same = [batch.column(k).slice(lo, len(texts)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["id", "t1", "t2", "key", "bands", "size"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, t1 long, t2 long, key binary, bands array<long>, size long")


def _elements(df: DataFrame) -> DataFrame:
    """(item, content) of rows (item, text)."""

    def run(batches):
        for batch in batches:
            for lo, texts in runs(batch.column(1).to_pylist()):
                made = pa.array(elements(texts), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), made], ["item", "content"])

    return df.mapInArrow(run, "item long, content array<long>")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, text): a row is known by its id and a 128-bit hash of its text."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))


def _classed(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, t1, t2, label) without null ids and texts, and (label, first), first being the least (id, t1, t2) of a class."""
    known = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    sketched = stored(_sketch(known))
    # one representative of each word sequence; numbered, since an id may stand for several texts
    groups = sketched.groupBy("key").agg(F.min(F.struct("id", "t1", "t2", "bands", "size")).alias("m")).select("key", "m.*")
    groups = stored(groups.withColumn("item", F.monotonically_increasing_id()))
    members = crowded(groups.select("item", F.explode(F.array_distinct("bands")).alias("bucket")))

    def content_of(items: DataFrame) -> DataFrame:
        wanted = groups.select("item", "id", "t1", "t2").join(small_side(items, items.count()), "item")
        found = known.join(small_side(wanted, wanted.count()), ["id", "t1", "t2"])
        return _elements(found.groupBy("item").agg(F.min("text").alias("text")))

    comps = classes(members, groups.select("item", "size"), content_of, 1 - similarity + 1e-12)
    found = cut(groups.select("item", "key", "id", "t1", "t2").join(comps, "item", "left").select("key", F.coalesce("label", "item").alias("label"), F.struct("id", "t1", "t2").alias("first")))
    rows = sketched.select("id", "t1", "t2", "key").join(found.select("key", "label"), "key").drop("key")
    return rows, found.groupBy("label").agg(F.min("first").alias("first"))


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`id_col` and class_id, the least id of the class, for every row."""
    docs = _rows(df, id_col, text_col)
    rows, firsts = _classed(docs, similarity)
    out = rows.join(firsts, "label").select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"))
    alone = docs.where(F.col("id").isNull() | F.col("text").isNull()).select(F.col("id").alias(id_col), F.col("id").alias("class_id"))
    return out.union(alone)


def one_of_each_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `df` that stay if one of each class does: that of the least (id, text hash).

    Rows with a null id or text all stay. Of rows that repeat an id and its text one stays, the least by the other
    columns (of those that can be compared).
    """
    columns = df.columns
    id_, t1, t2 = (fresh(df, f"class_{c}") for c in ("id", "t1", "t2"))
    text = F.col(text_col).cast("string")
    keyed = df.withColumns({id_: F.col(id_col), t1: F.xxhash64(text), t2: F.xxhash64(F.lit(7), text)})
    firsts = cut(_classed(_rows(df, id_col, text_col), similarity)[1].select(F.col("first.id").alias(id_), F.col("first.t1").alias(t1), F.col("first.t2").alias(t2)))
    known = keyed.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    kept = known.join(small_side(firsts, firsts.count()), [id_, t1, t2], "left_semi")
    twice = cut(known.groupBy(id_, t1, t2).agg(F.count("*").alias("n")).where("n > 1").select(id_, t1, t2))
    n = twice.count()
    alone = df.where(F.col(id_col).isNull() | F.col(text_col).isNull())
    if n == 0:
        return kept.select(*columns).union(alone)
    once = kept.join(small_side(twice, n), [id_, t1, t2], "left_anti").select(*columns)
    repeated = kept.join(small_side(twice, n), [id_, t1, t2], "left_semi")
    order = F.struct(*(F.col(f"`{c}`") if not _has_map(df.schema[c].dataType) else F.to_json(F.col(f"`{c}`")).alias(c) for c in columns))
    whole = repeated.groupBy(id_, t1, t2).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in columns)), order).alias("row")).select("row.*")
    return once.union(whole).union(alone)


def _has_map(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, (T.MapType, T.VariantType)) or any(map(_has_map, inner))
