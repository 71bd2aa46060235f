"""Toxicity by a classifier that is regularised with counterfactuals.

A document has the set of hashed features of its words: the whole word and its first 3 to 6 letters. A sparse logistic
model over them is fitted by proximal gradient steps. Labelled texts that name a group are copied whole, with every
group term swapped for another of the same language and kind; texts that name none get a mention of one group or of
another. The squared change of the score (before the logistic function) between the two copies is added to the loss,
so that a mention alone moves the score little and neutral mentions aren't taken for toxic.

Learned from a bounded sample of labelled rows (`MOST_TOXIC` and `MOST_OTHER`, drawn by a hash of id and text; held-out
rows left out) and weighted back to the classes' true shares. Spark tasks extract the sample's features from whole
texts; features are counted and screened by a grouped sum: those of `LEAST_DOCUMENTS` documents whose log-odds are
`LEAST_CERTAIN` standard errors from 0 are used, all of them. Only (document, used feature) numbers reach the driver,
never a text. Every document is scored from its whole text. Null, empty and wordless texts have the score of a text
without features. Without any labelled row every score is 0. A document labelled twice counts as toxic if one label
says so. Ties in the draw go in or out together. Rows are independent, so repeated rows repeat; columns named like the
results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.text_codes import Words, held_out, mix, runs, with_scores
from furrow.operators.graph import stored

BITS = 20
PREFIXES = (3, 4, 5, 6)
#: Labelled documents to learn from, of each class.
MOST_TOXIC, MOST_OTHER = 3000, 5000
#: Features must occur in so many sampled documents.
LEAST_DOCUMENTS = 3
#: Standard errors that a feature's log-odds must be away from 0.
LEAST_CERTAIN = 2.5
L1, L2, COUNTERFACTUAL = 2e-6, 1e-6, 0.05
STEPS = 1500
THRESHOLD = 0.3

#: Terms that name groups of people, of one language and form in each line.
IDENTITY_TERMS = [
    line.split()
    for line in (
        "women men girls boys mothers fathers",
        "woman man",
        "black white asian african european american mexican latino arab indian chinese jewish muslim christian catholic hindu buddhist atheist",
        "jews muslims christians immigrants refugees foreigners",
        "gay lesbian straight bisexual transgender disabled deaf blind old young elderly",
        "femmes hommes noirs blancs juifs musulmans immigrés",
        "frauen männer schwarze weiße juden ausländer flüchtlinge",
        "mujeres hombres negros blancos judíos musulmanes inmigrantes",
    )
]
#: Each term's line and place.
TERM_PLACE = {term: (i, k) for i, line in enumerate(IDENTITY_TERMS) for k, term in enumerate(line)}
_TERM = re.compile("(?<![^\\W\\d_])(" + "|".join(sorted(TERM_PLACE, key=len, reverse=True)) + ")(?![^\\W\\d_])", re.I)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, 2^BITS
    bias: float


def word_features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, features) of the prefixes and of the whole words."""
    codes, starts, length = words.codes, words.starts, words.ends - words.starts
    h, out = np.zeros(len(starts), np.uint64), []
    live = np.arange(len(starts))
    k = 0
    whole = np.zeros(len(starts), np.uint64)
    while len(live):
        h[live] = h[live] * np.uint64(0x100000001B3) + codes[starts[live] + k] + np.uint64(1)
        k += 1
        if k in PREFIXES:
            out.append((live, mix(h[live] ^ np.uint64(k << 40), BITS)))
        ended = length[live] == k
        whole[live[ended]] = h[live[ended]]
        live = live[~ended]
    out.append((np.arange(len(starts)), mix(whole ^ np.uint64(63 << 40), BITS)))
    return out


def document_features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, by document; with `wanted` only features that it marks."""
    words = Words(texts)
    pairs = []
    for at, feature in word_features(words):
        if wanted is not None:
            ok = wanted[feature]
            at, feature = at[ok], feature[ok]
        pairs.append(words.doc[at].astype(np.int64) << BITS | feature)
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return found >> BITS, found & (2**BITS - 1)


def swapped(text: str, turn: int) -> tuple[str, str]:
    """A labelled text with all its group terms swapped, or with mentions of two groups added."""

    def other(m: re.Match) -> str:
        line, k = TERM_PLACE[m[0].lower()]
        n = len(IDENTITY_TERMS[line])
        return IDENTITY_TERMS[line][(k + 1 + turn % (n - 1)) % n]

    changed, n = _TERM.subn(other, text)
    if n:
        return text, changed
    line = IDENTITY_TERMS[turn % len(IDENTITY_TERMS)]
    k = turn // len(IDENTITY_TERMS)
    return f"{text} {line[k % len(line)]}", f"{text} {line[(k + 1) % len(line)]}"


class _Rows:
    """A sparse 0/1 matrix, by rows."""

    def __init__(self, doc: np.ndarray, col: np.ndarray, n: int, sign: np.ndarray | None = None):
        self.doc, self.col, self.n = doc, col, n
        self.value = np.ones(len(doc)) if sign is None else sign

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, self.value * w[self.col], self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.doc], size)


def learn(x: _Rows, diff: _Rows, toxic: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights of `size` features and bias, by Adagrad with a proximal step.

    x: documents by features; diff: for each document, the features that only one of its two copies has, with sign.
    """
    c = weight / weight.sum()
    w, bias = np.zeros(size), 0.0
    g2, gb2 = np.zeros(size) + 1e-8, 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30)))
        r = c * (p - toxic)
        g = x.back(r, size) + L2 * w + COUNTERFACTUAL * diff.back(diff.dot(w), size) / x.n
        g2 += g * g
        gb2 += r.sum() ** 2
        step = 0.5 / np.sqrt(g2)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        bias -= 0.5 / np.sqrt(gb2) * r.sum()
    return w, float(bias)


def score_texts(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    doc, feat = document_features(texts, model.weights != 0)
    total = np.bincount(doc, model.weights[feat], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sampled(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, turn) of the rows to learn from, and the number of labels of each class."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    marks = marks.where(~held_out("id"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}

    def draw(*of) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(1_000_000)) / 1_000_000

    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, MOST_TOXIC / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, MOST_OTHER / sizes.get(0, 1))))
    some = marks.where(F.col("toxic").isin(0, 1) & (draw("id") < share))
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # about MOST_TOXIC + MOST_OTHER ids are broadcast; an id of very many rows is thinned by another draw
    rows = texts.join(F.broadcast(some), "id")
    met = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    thin = F.when(F.col("toxic") == 1, F.lit(min(1.0, 2 * MOST_TOXIC / met.get(1, 1)))).otherwise(F.lit(min(1.0, 2 * MOST_OTHER / met.get(0, 1))))
    rows = rows.where(draw(F.lit(3), "id", "text") < thin)
    return rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit(5), "id", "text"), F.lit(1000)).cast("int").alias("turn")), sizes


def _pairs(rows: DataFrame) -> DataFrame:
    """(doc, toxic, feature, side) of rows (doc, text, toxic, turn): side 0 for the text, 1 and -1 for its two copies."""

    def run(batches):
        for batch in batches:
            ids, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            turns = batch.column(3).to_pylist()
            for lo, texts in runs(batch.column(1).to_pylist()):
                copies = [swapped(t, turn) for t, turn in zip(texts, turns[lo : lo + len(texts)], strict=True)]
                one, other = (document_features([c[k] for c in copies]) for k in (0, 1))
                first, second = (d << BITS | f for d, f in (one, other))
                own = document_features(texts)
                only = np.setdiff1d(first, second, True), np.setdiff1d(second, first, True)
                doc = np.concatenate((own[0], only[0] >> BITS, only[1] >> BITS)) + lo
                feature = np.concatenate((own[1], *(o & (2**BITS - 1) for o in only)))
                side = np.repeat(np.array([0, 1, -1], np.int32), (len(own[0]), len(only[0]), len(only[1])))
                columns = [pa.array(ids[doc]), pa.array(toxic[doc].astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(side)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "toxic", "feature", "side"])

    return rows.select("doc", "text", "toxic", "turn").mapInArrow(run, "doc long, toxic int, feature int, side int")


def fit_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from labelled rows that aren't held out; runs Spark jobs at once."""
    rows, sizes = _sampled(documents, labels, id_col, text_col, label_col)
    nothing = ToxicityModel(np.zeros(2**BITS, np.float32), -30.0)
    if not sizes:
        return nothing
    rows = stored(rows.withColumn("doc", F.monotonically_increasing_id()))
    facts = rows.select("doc", "toxic").toArrow()
    if not facts.num_rows:
        return nothing
    ids, toxic = facts["doc"].to_numpy(), facts["toxic"].to_numpy().astype(float)
    pairs = stored(_pairs(rows))
    count = {k: int((toxic == k).sum()) for k in (0, 1)}
    known = pairs.where("side = 0").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).where(F.col("n") >= LEAST_DOCUMENTS)
    pos, neg = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    odds = F.abs(F.log(pos / (count[1] + 1.0)) - F.log(neg / (count[0] + 1.0)))
    used = known.where(odds / F.sqrt(1 / pos + 1 / neg) >= LEAST_CERTAIN).select("feature")
    # at most 2^BITS features
    found = pairs.join(F.broadcast(used), "feature").select("doc", "feature", "side").toArrow()
    doc, feature, side = (found[c].to_numpy() for c in ("doc", "feature", "side"))
    order = np.argsort(ids)
    ids, toxic = ids[order], toxic[order]
    names, column = np.unique(feature, return_inverse=True)
    row, own = np.searchsorted(ids, doc), side == 0
    weight = np.where(toxic == 1, sizes.get(1, 0) / max(1, count[1]), sizes.get(0, 0) / max(1, count[0]))
    x = _Rows(row[own], column[own], len(ids))
    diff = _Rows(row[~own], column[~own], len(ids), side[~own].astype(float))
    w, bias = learn(x, diff, toxic, weight, len(names))
    weights = np.zeros(2**BITS, np.float32)
    weights[names] = w
    return ToxicityModel(weights, bias)


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity", toxic_col: str = "toxic_pred") -> DataFrame:
    """All columns of `df`, and `score_col` double and `toxic_col` int, which replace columns of the same name."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(model, texts):
        p = score_texts(model, texts)
        return pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())

    return with_scores(df, text_col, f"`{score_col}` double, `{toxic_col}` int", score, shared)
