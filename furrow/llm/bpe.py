"""BPE encoding and decoding by a contiguous rank array.

Each short word keeps its part ids and the ranks of adjacent parts side by side. The smallest rank is found by a
scan, the boundary below it is deleted, and the ranks of the two neighbours are looked up again. Words of one length
are handled together as rows of a matrix, so a scan or a deletion is one vector step. Only words that a task has not
met before are merged. Words over `LONG_WORD` bytes use a heap instead, which keeps a text without spaces from
costing the square of its length.

Nulls are read as empty texts and give no ids; an empty text decodes to an empty text. Rows are independent: repeated
ids and texts each give their own row. An empty table gives an empty result. Other columns are not read, so their
names cannot clash. Every code point is split
and lower-cased as by the library (`tokenizer_files` lists where Python's tables are of other Unicode versions). Words of
any length are merged whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.tokenizer_files import LONG_WORD, NO_RANK, BpeModel, byte_alphabet, load_model

#: Words that a task remembers. When full, the memory starts again; results don't depend on it.
MEMORY_WORDS = 500_000
#: Characters of text handled before a batch is handed on.
CHUNK_CHARS = 2_000_000


def merge_matrix(parts: np.ndarray, model: BpeModel) -> tuple[np.ndarray, np.ndarray]:
    """Merges words of one length, one word a row. Returns parts and the number of parts of each row."""
    n, width = parts.shape
    size = np.full(n, width)
    if width == 1:
        return parts, size
    at = model.pair(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, width - 1)
    rank = np.where(at >= 0, model.pair_rank[at], NO_RANK)
    row = np.arange(n)
    out_parts, out_size = parts.copy(), size.copy()
    live = row
    while len(live):
        best = rank.argmin(axis=1)
        lowest = rank[np.arange(len(live)), best]
        done = lowest == NO_RANK
        if done.any():
            out_parts[live[done], : parts.shape[1]] = parts[done]
            out_size[live[done]] = size[done]
            parts, rank, size, best, lowest, live = (x[~done] for x in (parts, rank, size, best, lowest, live))
            if not len(live):
                break
        r = np.arange(len(live))
        left, right = parts[r, best], parts[r, best + 1]
        new = model.pair_id[model.pair(left, right)]
        # delete the boundary: what stands behind it moves one place down
        cols = np.arange(parts.shape[1] - 1)
        parts = np.where(cols[None, :] <= best[:, None], parts[:, :-1], parts[:, 1:])
        parts[r, best] = new
        size = size - 1
        if parts.shape[1] == 1:
            out_parts[live, :1], out_size[live] = parts, size
            break
        cols = np.arange(rank.shape[1] - 1)
        rank = np.where(cols[None, :] < best[:, None], rank[:, :-1], rank[:, 1:])
        # refresh the ranks on both sides of the new part
        for shift in (-1, 0):
            col = best + shift
            ok = (col >= 0) & (col < rank.shape[1])
            rr, cc = r[ok], col[ok]
            at = model.pair(parts[rr, cc], parts[rr, cc + 1])
            rank[rr, cc] = np.where(at >= 0, model.pair_rank[at], NO_RANK)
        # parts behind a row's end are -1, so their ranks stay NO_RANK
    return out_parts, out_size


def merge_long(parts: list[int], model: BpeModel) -> list[int]:
    """One long word, by a heap of adjacent pairs and links between parts."""
    ids = np.array(parts, np.int64)
    at = model.pair(ids[:-1], ids[1:])
    heap = [(int(model.pair_rank[a]), i, parts[i], parts[i + 1], int(model.pair_id[a])) for i, a in enumerate(at.tolist()) if a >= 0]
    heapq.heapify(heap)
    after, before = list(range(1, len(parts))) + [-1], [-1, *range(len(parts) - 1)]
    alive = [True] * len(parts)
    keys, rank, made, width = model.pair_keys, model.pair_rank, model.pair_id, model.width

    def push(i: int, j: int) -> None:
        key = parts[i] * width + parts[j]
        k = int(np.searchsorted(keys, key))
        if k < len(keys) and keys[k] == key:
            heapq.heappush(heap, (int(rank[k]), i, parts[i], parts[j], int(made[k])))

    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = new, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    return [p for p, keep in zip(parts, alive, strict=True) if keep]


def encode_words(words: list[str], model: BpeModel) -> list[tuple[int, ...]]:
    """Ids of each pre-token."""
    raw = [w.encode("utf-8") for w in words]
    out: list[tuple[int, ...]] = [()] * len(words)
    sizes = np.array([len(b) for b in raw])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        if size == 0:
            continue
        if size > LONG_WORD:
            for i in rows.tolist():
                b = np.frombuffer(raw[i], np.uint8)
                out[i] = tuple(merge_long([*model.first[b[:-1]].tolist(), int(model.last[b[-1]])], model))
            continue
        step = max(1, 400_000 // int(size))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step].tolist()
            b = np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(len(some), size)
            parts = model.first[b]
            parts[:, -1] = model.last[b[:, -1]]
            parts, count = merge_matrix(parts, model)
            for i, ids, n in zip(some, parts.tolist(), count.tolist(), strict=True):
                out[i] = tuple(ids[:n])
    return out


class Encoder:
    """Encodes texts with a memory of words."""

    def __init__(self, model: BpeModel):
        self.model, self.known = model, {}

    def learn(self, words: Iterable[str]) -> None:
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        new = [w for w in set(words) if w not in self.known]
        self.known.update(zip(new, encode_words(new, self.model), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.model.split_specials(t) for t in texts]
        split = [[self.model.words(p) if i % 2 == 0 else p for i, p in enumerate(ps)] for ps in pieces]
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        self.learn(chain.from_iterable(w for ws in split for w in ws if isinstance(w, list)))
        known, special = self.known, self.model.specials
        return [list(chain.from_iterable(chain.from_iterable(map(known.__getitem__, w)) if isinstance(w, list) else (special[w],) for w in ws)) for ws in split]


class Decoder:
    """Turns ids into text as the file's decoder does; special strings stay."""

    def __init__(self, model: BpeModel):
        self.tokens, self.joined = model.tokens, not model.byte_level_decoder
        self.of = {c: i for i, c in enumerate(byte_alphabet())}

    def decode(self, ids: Iterable[int]) -> str:
        if self.joined:
            return " ".join(map(self.tokens.__getitem__, ids))
        text = "".join(map(self.tokens.__getitem__, ids))
        return bytes(map(self.of.__getitem__, text)).decode("utf-8", "replace")


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length; null is empty."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS or i + 1 == len(texts):
            yield lo, [t or "" for t in texts[lo : i + 1]]
            lo, size = i + 1, 0


def _ids_column(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Ids of every whole text: `id_col`, ids array<int>, and with `decoded` the text that the ids decode to."""
    model = df.sparkSession.sparkContext.broadcast(load_model(path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder, decoder = Encoder(model.value), Decoder(model.value)
        for batch in batches:
            for lo, texts in chunks(batch.column(1).to_pylist()):
                ids = encoder.encode(texts)
                columns = [batch.column(0).slice(lo, len(texts)), _ids_column(ids)]
                if decoded:
                    columns.append(pa.array(map(decoder.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists; null lists decode to an empty text."""
    model = df.sparkSession.sparkContext.broadcast(load_model(path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        decoder = Decoder(model.value)
        for batch in batches:
            texts = pa.array((decoder.decode(ids or ()) for ids in batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "decoded"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
