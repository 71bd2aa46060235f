"""Language ID by a mixture of languages in each document.

Each word has a likelihood under each language, from smoothed counts of hashed character n-grams. Expectation-
maximisation over a document's words gives the proportions of all languages. The set of languages is chosen among the
prefixes of the list of all learned languages by falling proportion: the one of highest likelihood, after some more steps
over that set alone and a penalty of the logarithm of the words for each language. The prediction is the language of the largest proportion in
that set, and the score its proportion.

The n-gram tables are learned from a bounded sample: about `per_language` documents of each language, chosen by a hash
of the id, held-out rows left out. Every document is predicted from its whole text, very long ones too. Null texts and
texts without a letter (marks alone are none) are `und` with score 0; so is everything if no labelled row exists. Ties go
to the language first by name. Rows are independent, so repeated rows repeat; columns named like the results are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.text_codes import Words, held_out, mix, runs, with_scores, word_table

BITS = 16
ORDERS = (2, 3, 4)
#: Documents of each language to learn from.
PER_LANGUAGE = 1200
SMOOTHING = 0.5
EM_STEPS = 8
SET_STEPS = 2


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray  # (1 + orders * 2^BITS, languages) log-likelihoods; row 0 is for windows that are no n-gram


def gram_rows(words: Words) -> list[np.ndarray]:
    """For each order, the table row of the n-gram that begins at each place, or 0."""
    codes, space = words.codes, words.space
    out, h = [], codes.copy()
    inner = np.zeros(len(codes), bool)  # a space inside the window
    for n in range(2, max(ORDERS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = h[:size] * np.uint64(1_000_003) + codes[n - 1 :]
        if n > 2:
            inner = inner[:size] | space[n - 2 : n - 2 + size]
        else:
            inner = np.zeros(size, bool)
        out.append(np.where(inner, 0, 1 + (n - 2) * 2**BITS + mix(h, BITS)))
    return [out[n - 2] for n in ORDERS]


def learn(texts: list[str], names: list[str]) -> LanguageModel:
    """n-gram log-likelihoods from labelled texts."""
    languages = sorted(set(names))
    size = 1 + len(ORDERS) * 2**BITS
    counts = np.zeros((size, len(languages)))
    for j, name in enumerate(languages):
        for _, some in runs([t for t, x in zip(texts, names, strict=True) if x == name]):
            for rows in gram_rows(Words(some)):
                counts[:, j] += np.bincount(rows, minlength=size)
    counts[0] = 0
    table = np.zeros((size, len(languages)), np.float32)
    for k in range(len(ORDERS)):
        part = counts[1 + k * 2**BITS : 1 + (k + 1) * 2**BITS]
        table[1 + k * 2**BITS : 1 + (k + 1) * 2**BITS] = np.log((part + SMOOTHING) / (part.sum(0) + SMOOTHING * 2**BITS))
    return LanguageModel(languages, table)


def _em(like: np.ndarray, first: np.ndarray, share: np.ndarray, sizes: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document and their log-likelihood; words of a document stand together."""
    for step in range(steps + 1):
        joint = like * np.repeat(share, sizes, axis=0)
        total = joint.sum(1)
        if step == steps:
            return share, np.add.reduceat(np.log(total), first)
        share = np.add.reduceat(joint / total[:, None], first, axis=0) / sizes[:, None]
    raise AssertionError


def predict(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and proportion of each text."""
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    words, n = Words(texts), len(model.names)
    if n == 0 or len(words) == 0:
        return names, score
    total = None
    for rows in gram_rows(words):
        part = model.table[rows]
        total = part if total is None else total[: len(part)] + part if len(part) >= len(total) else np.vstack([total[: len(part)] + part, total[len(part) :]])
    place = words.word[: len(total)]
    edges = np.flatnonzero(np.diff(place, prepend=-1))
    like = np.add.reduceat(total, edges, axis=0)[: len(words)].astype(np.float32)
    like = np.exp(like - like.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    first = np.flatnonzero(np.diff(words.doc, prepend=-1))
    docs = words.doc[first]
    sizes = np.diff(np.append(first, len(words)))
    share, _ = _em(like, first, np.full((len(docs), n), 1 / n, np.float32), sizes, EM_STEPS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen = np.full(len(docs), -np.inf), share
    for k in range(1, n + 1):
        mask = np.zeros((len(docs), n), np.float32)
        np.put_along_axis(mask, order[:, :k], 1, axis=1)
        start = share * mask + np.float32(1e-6) * mask
        part, fit = _em(like, first, (start / start.sum(1, keepdims=True)).astype(np.float32), sizes, SET_STEPS if k > 1 else 0)
        value = fit - k * np.log(np.maximum(sizes, 2))
        better = value > best
        best = np.where(better, value, best)
        chosen = np.where(better[:, None], part, chosen)
    top = chosen.argmax(axis=1)
    lettered = np.logical_or.reduceat(word_table("L")[words.codes.astype(np.int64)], words.starts[first])
    for d, j, s, known in zip(docs.tolist(), top.tolist(), chosen[np.arange(len(docs)), top].tolist(), lettered.tolist(), strict=True):
        if known:
            names[d], score[d] = model.names[j], min(1.0, s)
    return names, score


def fit_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from about `per_language` rows of each language that aren't held out, drawn by a hash of id and text.

    Rows that repeat an id and its text are drawn once, so no id makes the sample large, and the sample and the model are
    the same in whatever order the rows come.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((1 + len(ORDERS) * 2**BITS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1_000_000
    drawn = rows.where(draw < share[F.col("lang")]).dropDuplicates(["id", "text", "lang"])
    sample = sorted((r["lang"], r["text"]) for r in drawn.select("lang", "text").collect())
    return learn([t for _, t in sample], [name for name, _ in sample]) if sample else LanguageModel([], np.zeros((1 + len(ORDERS) * 2**BITS, 0), np.float32))


def predict_languages(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of `df`, lang_pred string and lang_score double."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(model, texts):
        names, share = predict(model, texts)
        return pa.array(names, pa.string()), pa.array(share, pa.float64())

    return with_scores(df, text_col, "lang_pred string, lang_score double", score, shared)
