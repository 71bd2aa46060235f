"""Importance resampling towards a target distribution, with hashed n-grams of one or two words.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z in lower case. A shard is a run of whole
texts inside a task. Its distinct words, each between two delimiters, are the patterns of an Aho-Corasick automaton; a
pattern's payload is the CRC-32 and the length of its word. One scan emits the payloads in order of the text. The CRC of
two words with a space between follows from the payloads of neighbours, since a CRC is linear: appending n bytes moves
it by a fixed operator of n, and the CRC of those bytes is added. A feature's bucket is its CRC modulo `n_buckets`, so no
feature is ever built as a string.

Buckets of every text are stored once, two bytes a feature. A bucket's gain is the logarithm of its smoothed frequency
in the target over that in the corpus, a text's weight is the floored mean of its gains, and its score adds Gumbel noise
of its id, so that the highest scores are a sample without replacement. Ranks come from a range partition and the sizes
of its parts; no task sees all rows.

Null and wordless texts have no features and weight 0. A null id is hashed as an empty one and comes before all others
in ties. Repeated rows are ranked one by one. Empty tables give empty results; an empty target gives gains by smoothing
alone. Columns named like the results are replaced. A text of any length is scanned whole, in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.decontamination import words_of
from furrow.llm.text_codes import fresh, runs
from furrow.operators.graph import cut, stored

N_BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SHARD_CHARS = 4_000_000
OUT_COLS = ("n_features", "weight", "score", "rank")
_END = b"\x01"  # stands between texts; it is no word
_POLYNOMIAL = 0xEDB88320  # of CRC-32, fixed


@lru_cache(maxsize=1)
def _one_zero_byte() -> np.ndarray:
    """What one more zero byte makes of each bit of a CRC."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = np.where(bits & 1, (bits >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), bits >> np.uint32(1))
    return bits


def _applied(operator: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), operator[bit], np.uint32(0))
    return out


@lru_cache(maxsize=4096)
def zero_bytes(n: int) -> np.ndarray:
    """Four tables by byte of a CRC: what `n` zero bytes make of it."""
    operator, power, left = np.uint32(1) << np.arange(32, dtype=np.uint32), _one_zero_byte(), n
    while left:
        if left & 1:
            operator = _applied(power, operator)
        power, left = _applied(power, power), left >> 1
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([_applied(operator, byte << np.uint32(8 * k)) for k in range(4)])


def composed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, from their CRCs and the bytes of the second."""
    lengths, which = np.unique(length, return_inverse=True)
    tables = np.stack([zero_bytes(int(n)) for n in lengths]) if len(lengths) else np.zeros((1, 4, 256), np.uint32)
    out = second.copy()
    for k in range(4):
        out ^= tables[which, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Dictionary:
    """Distinct words between delimiters, with CRC and length as payload."""

    def __init__(self, words: set[bytes]):
        listed = sorted(words)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(listed):
            self.automaton.add_word(f" {word.decode()} ", i)
        self.automaton.make_automaton()
        self.crc = np.fromiter(map(zlib.crc32, listed), np.uint32, len(listed))
        self.crc_space = composed(self.crc, np.full(len(listed), zlib.crc32(b" "), np.uint32), np.ones(len(listed), np.int64))
        self.length = np.fromiter(map(len, listed), np.int64, len(listed))
        self.end = listed.index(_END) if _END in words else -1

    def scan(self, text: str) -> np.ndarray:
        """Numbers of the words of a text, in its order."""
        if not len(self.crc):
            return np.zeros(0, np.int64)  # an automaton without patterns can't scan
        return np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int64)


def buckets_of(texts: list[str], n_buckets: int = N_BUCKETS) -> list[tuple[int, np.ndarray]]:
    """(words, buckets of all features) of each text of a shard: first of single words, then of pairs."""
    lowered = [b" ".join(words_of(t)) for t in texts]
    whole = (b" " + _END + b" ").join(lowered)
    found = Dictionary(set(whole.split(b" ")) - {b""})
    seen = found.scan(f" {whole.decode()} ")
    single = (found.crc[seen] % np.uint32(n_buckets)).astype(np.int64)
    pair = (composed(found.crc_space[seen[:-1]], found.crc[seen[1:]], found.length[seen[1:]]) % np.uint32(n_buckets)).astype(np.int64)
    ends = np.append(np.flatnonzero(seen == found.end), len(seen)) if len(texts) > 1 else np.array([len(seen)])
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [(b - a, np.concatenate((single[a:b], pair[a : max(a, b - 1)]))) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _kind(n_buckets: int) -> type:
    return np.uint16 if n_buckets <= 1 << 16 else np.uint32


def with_buckets(df: DataFrame, text_col: str, keep: Sequence[str], names: Sequence[str], n_buckets: int = N_BUCKETS) -> DataFrame:
    """Columns `keep` of `df`, and under `names` the number of words, the packed buckets, and the row's place in its task."""
    schema = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "binary", "long"), strict=True)))])
    rows = df.select(F.col(text_col).alias(fresh(df, "scanned")), *keep)

    def run(batches):
        place = 0
        for batch in batches:
            for lo, some in runs(batch.column(0).to_pylist(), SHARD_CHARS):
                made = buckets_of(some, n_buckets)
                packed = pa.array([b.astype(_kind(n_buckets)).tobytes() for _, b in made], pa.binary())
                kept = batch.slice(lo, len(some)).columns[1:]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([n for n, _ in made], pa.int64()), packed, pa.array(range(place, place + len(some)), pa.int64())], schema.names)
                place += len(some)

    return rows.mapInArrow(run, schema)


def bucket_counts(featured: DataFrame, buckets_col: str, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n) over all rows: every task sums its own, then tasks are added up."""

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            packed = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(packed, _kind(n_buckets)), minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return featured.select(buckets_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets from two tables (bucket, n); `n_buckets` rows, whatever the corpus."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    both = cut(both)
    every = both.union(both.sparkSession.range(n_buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    per = every.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("big_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("big_t"))
    share = (F.col("t") + 1) * (F.col("big_s") + float(n_buckets)) / ((F.col("s") + 1) * (F.col("big_t") + float(n_buckets)))
    return per.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def _weighted(featured: DataFrame, keep: Sequence[str], buckets: str, gains: np.ndarray, names: Sequence[str], n_buckets: int) -> DataFrame:
    """Columns `keep`, the number of features and the floored mean of their gains."""
    schema = T.StructType([*(featured.schema[c] for c in keep), *T.StructType.fromDDL(f"`{names[0]}` long, `{names[1]}` long")])
    shared = featured.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        for batch in batches:
            values = [np.frombuffer(b, _kind(n_buckets)) for b in batch.column(0).to_pylist()]
            sums = [int(shared.value[v].sum()) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(map(len, values), pa.int64()), pa.array([s // len(v) if len(v) else 0 for s, v in zip(sums, values, strict=True)], pa.int64())], schema.names)

    return featured.select(buckets, *keep).mapInArrow(run, schema)


def noise(id_col: str, seed: int):
    """Gumbel noise of an id in thousandths, floored: from the first 32 bits of the SHA-256 of `seed:id`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """`df` with the number of each row in an order over all rows, from 1.

    Rows are dealt to ranges of the order and numbered there; a range begins after the rows of those before it. `order`
    should tell rows apart, so that no tie makes a range large.
    """
    part, at = fresh(df, "part"), fresh(df, "at")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias(at))
    # one row for each range: their number is a setting, not a size of the data
    before = sizes.select(part, (F.sum(at).over(Window.orderBy(part)) - F.col(at)).alias(at))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.join(F.broadcast(before), part).withColumn(name, inside + F.col(at)).drop(part, at)


def importance_resample(
    docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] | None = None,
    n_buckets: int = N_BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, out_cols: Sequence[str] = OUT_COLS,
) -> DataFrame:
    """Columns `keep` of `docs` (all, if None), and the number of features, weight, score and rank of every row.

    `percent` of the rows with at least `min_words` words are drawn, by score, ties to the smaller id; their ranks count
    from 1, those of the others are null. `out_cols` names the four columns.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out_cols]
    if id_col in out_cols or id_col not in keep:
        raise ValueError("the id must be among the columns that stay")
    n_features, weight, score, rank = out_cols
    words, buckets, place = (fresh(docs, n, *out_cols) for n in ("words", "buckets", "place"))
    featured = stored(with_buckets(docs, text_col, keep, (words, buckets, place), n_buckets))
    aimed = with_buckets(target, target_text_col, [], ("words", "buckets", "place"), n_buckets)
    gains = np.zeros(n_buckets, np.int64)
    for row in bucket_gains(bucket_counts(featured, buckets, n_buckets), bucket_counts(aimed, "buckets", n_buckets), n_buckets).toLocalIterator():
        gains[row["bucket"]] = row["gain"]
    scored = _weighted(featured, [*keep, words, place], buckets, gains, (n_features, weight), n_buckets).withColumn(score, F.col(weight) + noise(id_col, seed))
    scored = stored(scored)
    drawn = scored.where(F.col(words) >= min_words).count() * percent // 100
    ranked = numbered(scored.where(F.col(words) >= min_words), [F.col(score).desc(), F.col(id_col).asc_nulls_first(), F.col(n_features), F.col(place)], rank)
    ranked = ranked.withColumn(rank, F.when(F.col(rank) <= drawn, F.col(rank)).cast("long"))
    return ranked.unionByName(scored.where(F.col(words) < min_words).withColumn(rank, F.lit(None).cast("long"))).select(*keep, *out_cols)
