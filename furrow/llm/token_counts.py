"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved before any text is read, once a session and file, by
encoding each string of the vocabulary that is a single pre-token. Pre-tokens that match such a string count as one without merging; only the others are merged, and
each of them once per task while the memory lasts.

Nulls count as empty texts (0 bytes, 0 tokens). Rows are independent, so repeated rows repeat. Other columns are not
read, so their names cannot clash. Very long words are merged whole. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.bpe import MEMORY_WORDS, chunks, encode_words
from furrow.llm.tokenizer_files import BpeModel, byte_alphabet, load_model


def whole_tokens(model: BpeModel) -> list[str]:
    """Vocabulary strings that stand as one pre-token and encode to themselves alone."""
    of = {c: i for i, c in enumerate(byte_alphabet())}
    names = []
    for text in model.tokens:
        if text in model.specials or not text.endswith(model.suffix) or any(c not in of for c in text[: len(text) - len(model.suffix)]):
            continue
        try:
            word = bytes(of[c] for c in text[: len(text) - len(model.suffix)]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if model.words(word) == [word]:
            names.append(word)
    return [w for w, ids in zip(names, encode_words(names, model), strict=True) if len(ids) == 1]


@lru_cache(maxsize=4)
def proven(path: str) -> list[str]:
    return whole_tokens(load_model(path))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_bytes long (UTF-8), n_tokens long of every whole text."""
    model = load_model(path)
    shared = df.sparkSession.sparkContext.broadcast((model, proven(path)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        model, whole = shared.value
        single = dict.fromkeys(whole, 1)
        known: dict[str, int] = dict(single)
        for batch in batches:
            for lo, texts in chunks(batch.column(1).to_pylist()):
                pieces = [model.split_specials(t) for t in texts]
                split = [[w for p in ps[::2] for w in model.words(p)] for ps in pieces]
                if len(known) > MEMORY_WORDS + len(single):
                    known = dict(single)
                new = [w for w in set(chain.from_iterable(split)) if w not in known]
                known.update(zip(new, map(len, encode_words(new, model)), strict=True))
                tokens = [sum(map(known.__getitem__, ws)) + len(ps) // 2 for ws, ps in zip(split, pieces, strict=True)]
                sizes = [len(t.encode("utf-8")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
