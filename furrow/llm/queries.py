"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.bpe import bpe_encode
from furrow.llm.decontamination import find_contamination
from furrow.llm.html_blocks import extract_main_text, fit_labeller
from furrow.llm.importance import importance_resample
from furrow.llm.language_id import fit_languages, predict_languages
from furrow.llm.line_dedup import marked_lines
from furrow.llm.near_duplicates import near_duplicate_classes
from furrow.llm.prefix_trie import paths_of, prefix_trie, rebuilt, turn_arrays
from furrow.llm.quote_links import link_quotes
from furrow.llm.secrets import BASE, RULES, find_secrets
from furrow.llm.text_codes import held_out
from furrow.llm.token_counts import token_counts
from furrow.llm.top_k import exact_top_k, quantized
from furrow.llm.toxicity import fit_toxicity, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of each vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantized(F.col("embedding")).alias("v")).where("id is not null and v is not null")
    return exact_top_k(rows.where("id % 50 = 0"), rows, 5)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    out = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document; the document whose id is the class id stays."""
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and benchmark items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("bench_items").cast("long").alias("n_items"), F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_pred").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict_languages(docs.select("doc_id", "text"), fit_languages(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotes, with the message that each replies to and its thread."""
    return link_quotes(table(spark, sf_dir, "conversations"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_main_text(pages, fit_labeller(pages))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, from 0, of the lines that every document loses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = marked_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")))
    lost = F.coalesce(F.size("dropped"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - lost).alias("n_kept"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's distribution, and the ranks of a quarter that is drawn."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the three base kinds, and the spans of all kinds."""
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    base = of(*BASE)
    return out.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(paths_of(rebuilt(turn_arrays(table(spark, sf_dir, "conversations")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_quote_links": op8_quote_links,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_secret_scans": op12_secret_scans,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM phrases))),
hits AS (SELECT DISTINCT doc_id, places.n AS n, i, item_id FROM places JOIN phrases ON places.n = phrases.n AND places.phrase = phrases.phrase),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_OP1 = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q a, q b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# CRC-32 by its table: a list of 256 numbers `t`, and the number of a string from its bytes
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


_OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM items),
buckets AS (SELECT f, {_crc('f')} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf) d, {_CRC_TABLE} k),
s AS (SELECT bucket, count(*) AS s FROM df JOIN buckets ON buckets.f = df.f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN buckets ON buckets.f = bf.f GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM df) AS big_s, (SELECT count(*) FROM bf) AS big_t),
gains AS (SELECT k.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (big_s + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * (big_t + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) k LEFT JOIN s ON s.bucket = k.bucket LEFT JOIN t ON t.bucket = k.bucket, totals),
sums AS (SELECT r, sum(gain) AS g, count(*) AS n FROM df JOIN buckets ON buckets.f = df.f JOIN gains ON gains.bucket = buckets.bucket GROUP BY r),
scored AS (SELECT docs.r, doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(g AS DOUBLE) / n), 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM docs LEFT JOIN sums ON sums.r = docs.r),
drawn AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM drawn WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= floor(25 * n / 100) THEN rank END AS rank FROM drawn LEFT JOIN ranked ON ranked.r = drawn.r
"""

_CHRS = "chr(57344)", "chr(57345)"  # of the private use area: they mark matches, and no given text holds them


def _matches(k: int, rule, pattern: str | None = None) -> str:
    pattern = (pattern or rule.pattern).replace("'", "''")
    return f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, CAST(start AS BIGINT) AS a, CAST(start + length(m) AS BIGINT) AS b FROM (
      SELECT r, i, split_part(piece, {_CHRS[1]}, 1) AS m, coalesce(sum(length(replace(piece, {_CHRS[1]}, ''))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT r, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM (SELECT r, string_split(regexp_replace(x, '{pattern}', {_CHRS[0]} || '\\0' || {_CHRS[1]}, 'g'), {_CHRS[0]}) AS pieces FROM docs) p) u) v
      WHERE i > 0 AND length(regexp_extract(m, '{pattern}', {rule.group})) >= {rule.least}"""


_EITHER_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_PLAIN = {"assign": rf"""({_EITHER_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "hex": "[0-9a-f]+"}
_IS_BASE = "kind IN ('assign', 'access', 'hex')"
_OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
found AS ({' UNION ALL '.join(_matches(k, rule, _PLAIN.get(rule.kind)) for k, rule in enumerate(RULES))}),
said AS (SELECT *, kind || ':' || a || ':' || b AS span FROM found),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY a, k) FILTER ({_IS_BASE}) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM said GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per ON per.r = docs.r
"""

_OP13 = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
known AS (SELECT conv_id, turn, role, substr(sha256(length(role) || ':' || role || text), 1, 32) AS digest, length(text) AS chars FROM turns),
own AS (SELECT conv_id, list({{'d': digest, 'n': chars}} ORDER BY turn NULLS FIRST, role, digest) AS l FROM known GROUP BY conv_id),
heads AS (SELECT conv_id AS base, l AS head FROM own),
crcs AS (SELECT own.*, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM own, {_CRC_TABLE} k),
paths AS (SELECT conv_id, list_concat(coalesce(head[1:h], []), l[h + 1:]) AS l FROM crcs LEFT JOIN heads ON base = conv_id - conv_id % 100),
members AS (SELECT conv_id, len(l) AS len, d, array_to_string(list_transform(l[1:d], lambda x: x.d), ' ') AS p, array_to_string(list_transform(l[1:d - 1], lambda x: x.d), ' ') AS up, coalesce(l[d].n, 0) AS chars
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM paths)),
nodes AS (SELECT d, p, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends FROM members GROUP BY d, p),
children AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, up),
known_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.p = nodes.p),
above AS (SELECT n, chars, n_children, p, d, unnest(range(0, d + 1)) AS a FROM known_nodes),
subtrees AS (SELECT a, CASE WHEN a = 0 THEN '' ELSE substr(p, 1, 33 * a - 1) END AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * chars) AS saved FROM above GROUP BY ALL)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, k.n AS n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM known_nodes k JOIN subtrees s ON s.a = k.d AND s.p = k.p LEFT JOIN nodes u ON u.d = k.d - 1 AND u.p = k.up
"""

ORACLE_SQL: dict[str, str] = {"op1_top_k": _OP1, "op5_decontamination": _OP5, "op11_importance_resampling": _OP11, "op12_secret_scans": _OP12, "op13_prefix_trie": _OP13}
