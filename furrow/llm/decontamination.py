"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is a run of whole documents inside a task. Its words are numbered by the benchmark's vocabulary; a word that
no benchmark item has cannot be part of an occurrence, so it only ends a run, and runs shorter than the shortest
phrase are left out before indexing. Over the rest, a suffix array gives the Burrows-Wheeler transform, a wavelet
matrix counts symbols in its prefixes, phrases are searched backwards, all at once, and occurrences are located by
walking to the next sampled suffix position. Overlapping occurrences merge into the spans to remove.

A phrase is 10 consecutive words of an item, or the whole of a shorter item that has a word. Words are runs of ASCII
letters and digits and of non-ASCII characters, with A-Z in lower case. Null texts have no words. Items without an id
count as occurrences but are not listed. Repeated rows of either table change nothing but repeat. Columns named like
the results are replaced. The benchmark is read in blocks of at most `BLOCK_BYTES`, each broadcast on its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.text_codes import with_scores

PHRASE_WORDS = 10
BLOCK_BYTES = 4_000_000
SAMPLE_EVERY = 8
OUT_COLS = ("n_words", "n_hit", "bench_items", "bench_spans")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
END = b"\x01"  # stands between documents; it is no word
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_LOWER).split()


@dataclass
class Phrases:
    """The phrases of one block of benchmark items."""

    vocabulary: dict[bytes, int]  # from 1
    by_length: dict[int, np.ndarray]  # length -> (phrases, length) word numbers
    first: dict[int, int]  # length -> number of its first phrase
    items: list[list[str]]  # item ids of each phrase

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=0)


def phrases_of(items: list[tuple[str | None, str | None]]) -> Phrases:
    """Distinct phrases of benchmark rows (id as text, text)."""
    vocabulary: dict[bytes, int] = {END: -1}
    owners: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text or "")]
        for i in range(max(1, len(ids) - PHRASE_WORDS + 1) if ids else 0):
            owner = owners.setdefault(tuple(ids[i : i + PHRASE_WORDS]), set())
            if item is not None:
                owner.add(item)
    by_length, first, listed = {}, {}, []
    for n in sorted({len(p) for p in owners}):
        some = [p for p in owners if len(p) == n]
        by_length[n], first[n] = np.array(some, np.int64), len(listed)
        listed += [sorted(owners[p]) for p in some]
    return Phrases(vocabulary, by_length, first, listed)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each 0 is a symbol of its own, by place, so comparisons end there."""
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols + zero.sum())
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (max(int(rank.max()), n) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order], prepend=key[order[0]] - 1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Counts of a symbol in prefixes, one bit of the symbol a level."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start, end = np.zeros(len(symbol), np.int64), end.copy()
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start


class FmIndex:
    """Searches and locates phrases in a sequence of symbols; a 0 ends each run, also the last."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # before the first symbol stands the last, which is 0
        self.wavelet = WaveletMatrix(self.last)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols))))
        starts_run = np.concatenate(([True], symbols[:-1] == 0))
        sampled = (starts_run | (np.arange(len(symbols)) % SAMPLE_EVERY == 0))[order]
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase numbers, first rows, end rows) of the phrases that occur."""
        live = np.flatnonzero(phrases.max(axis=1) < len(self.below) - 1)
        lo = np.zeros(len(live), np.int64)
        hi = np.full(len(live), len(self.last), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo, hi = self.below[c] + self.wavelet.rank(c, lo), self.below[c] + self.wavelet.rank(c, hi)
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, from the sampled ones."""
        place, rows, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            found = self.sampled[rows]
            place[open_[found]] = self.samples[self.sample_at[rows[found]]] + steps
            open_, rows = open_[~found], rows[~found]
            c = self.last[rows]
            rows = self.below[c] + self.wavelet.rank(c, rows)
            steps += 1
        return place


def occurrences(phrases: Phrases, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lengths, phrase numbers) of all occurrences in a shard's word numbers."""
    none = np.zeros(0, np.int64)
    inside = ids > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= phrases.shortest
    start, end = start[long], end[long]
    if not phrases.by_length or not len(start):
        return none, none, none
    cover = np.zeros(len(ids) + 2, np.int64)
    cover[start] += 1
    cover[end + 1] -= 1  # a run and what ends it
    kept = np.flatnonzero(np.cumsum(cover)[: len(ids) + 1])
    symbols = np.maximum(np.append(ids, 0)[kept], 0)
    index, out = FmIndex(symbols), ([], [], [])
    for n, some in phrases.by_length.items():
        which, lo, hi = index.search(some)
        if not len(which):
            continue
        count = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        out[0].append(kept[index.locate(rows)])
        out[1].append(np.full(len(rows), n))
        out[2].append(np.repeat(which + phrases.first[n], count))
    return tuple(np.concatenate(x) if x else none for x in out)


def find(blocks: list, texts: list[str]) -> tuple[list[int], list[int], list[list[str]], list[list[dict]]]:
    """(words, hit words, item ids, spans of code points) of each text of a shard. blocks: functions giving Phrases."""
    words = (b" " + END + b" ").join(t.encode("utf-8").translate(_LOWER) for t in texts).split()
    ends = None
    hit, items = np.zeros(len(words) + 1, bool), [set() for _ in texts]
    for block in blocks:
        phrases = block()
        ids = np.fromiter(map(phrases.vocabulary.get, words, repeat(0)), np.int64, len(words))
        if ends is None:
            ends = np.append(np.flatnonzero(ids == -1), len(words))
        place, length, which = occurrences(phrases, ids)
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + length, -1)
        hit |= np.cumsum(cover) > 0
        doc = np.searchsorted(ends, place)
        for key in np.unique(doc * len(phrases.items) + which).tolist():
            items[key // len(phrases.items)].update(phrases.items[key % len(phrases.items)])
    if ends is None:
        ends = np.append(np.flatnonzero([w == END for w in words]), len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = (ends - starts).tolist()
    total = np.concatenate(([0], np.cumsum(hit)))
    hits = (total[ends] - total[starts]).tolist()
    spans = [spans_of(t, hit[a:b]) if h else [] for t, a, b, h in zip(texts, starts.tolist(), ends.tolist(), hits, strict=True)]
    return counts, hits, [sorted(i) for i in items], spans


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Merged spans of runs of hit words, as code points."""
    out, before = [], False
    for m, h in zip(WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)})), hit.tolist(), strict=True):
        if h and before:
            out[-1]["end"] = m.end()
        elif h:
            out.append({"start": m.start(), "end": m.end()})
        before = h
    return out


def read_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast phrases of the benchmark, in blocks of bounded size."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(phrases_of([(r["item"], r["text"]) for r in rows.where(F.col("block") == k).collect()])) for k in range(n)]


def find_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", block_bytes: int = BLOCK_BYTES, out_cols: Sequence[str] = OUT_COLS) -> DataFrame:
    """All columns of `df`, and n_words, n_hit, bench_items (sorted ids) and bench_spans (to remove, in code points).

    `out_cols` names the four; they replace columns of the same name.
    """
    shared = read_blocks(benchmark, item_col, bench_text_col, block_bytes)

    def score(_, texts):
        words, hits, items, spans = find([lambda b=b: b.value for b in shared], texts)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)

    kinds = ("long", "long", "array<string>", "array<struct<start:int,end:int>>")
    return with_scores(df, text_col, ", ".join(f"`{n}` {k}" for n, k in zip(out_cols, kinds, strict=True)), score, None)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans of `find_contamination`."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            F.when(i == 0, F.lit(1)).otherwise(F.get(spans, i - 1)["end"] + 1),
            F.coalesce(F.get(spans, i)["start"], F.length(text)) - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat_ws("", pieces)).otherwise(text)
