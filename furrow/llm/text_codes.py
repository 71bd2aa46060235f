"""Code points of a run of texts as one array, with word bounds, for vector work inside tasks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS = 1_000_000
SPACE = 32


@lru_cache(maxsize=2)
def word_table(kinds: str) -> np.ndarray:
    """True for each code point whose general category begins with one of `kinds`."""
    return np.array([unicodedata.category(chr(c))[0] in kinds for c in range(0x110000)])


class Words:
    """Lower-cased words (runs of letters and marks, or of other `kinds`) of several texts.

    `codes` has one space before each word and one after the last; `word` numbers each place by the word it begins or
    lies in; `doc` is the text of each word.
    """

    def __init__(self, texts: list[str], kinds: str = "LM"):
        lowered = [t.lower() for t in texts]
        raw = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in lowered])
        letter = word_table(kinds)[raw]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.where(letter, raw, SPACE)[keep].astype(np.uint64)
        at = np.flatnonzero(keep)
        if len(codes) == 0 or codes[-1] != SPACE:
            codes, at = np.append(codes, np.uint64(SPACE)), np.append(at, ends[-1] - 1)
        if codes[0] != SPACE:
            codes, at = np.insert(codes, 0, SPACE), np.insert(at, 0, 0)
        space = codes == SPACE
        self.codes, self.space = codes, space
        self.word = np.cumsum(space) - 1  # the last space begins a word that doesn't exist
        self.starts = np.flatnonzero(space)[:-1] + 1
        self.ends = np.flatnonzero(space)[1:]
        self.doc = np.searchsorted(ends, at[self.starts], side="right")
        self.texts = len(texts)

    def __len__(self) -> int:
        return len(self.starts)


def mix(h: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of a multiplied hash, as indexes."""
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def runs(texts: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length; null is empty."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i + 1 == len(texts):
            yield lo, [t or "" for t in texts[lo : i + 1]]
            lo, size = i + 1, 0


def fresh(df: DataFrame, name: str, *taken: str) -> str:
    """`name`, with underscores behind it while `df` or `taken` has a column of that name."""
    used = {c.lower() for c in (*df.columns, *taken)}
    while name.lower() in used:
        name += "_"
    return name


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def with_scores(df: DataFrame, text_col: str, added: str, score, shared) -> DataFrame:
    """All columns of `df` and those of the DDL `added`, which replace columns of the same name.

    `score(model, texts)` gives the added columns of a run of texts as Arrow arrays; `shared` is a broadcast model
    or None.
    """
    extra = T.StructType.fromDDL(added)
    df = df.drop(*extra.names)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for lo, some in runs(texts):
                made = score(shared and shared.value, some)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(some)).columns, *made], schema.names)

    return df.mapInArrow(run, schema)
