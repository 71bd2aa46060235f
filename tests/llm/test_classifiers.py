import zlib

import numpy as np

from furrow.llm.language_id import fit_languages, predict_languages
from furrow.llm.queries import op6_toxicity, op7_language_id
from furrow.llm.toxicity import TERM_PLACE, fit_toxicity, score_toxicity, score_texts, swapped

MID = "/root/testdata/sf0.01"


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_languages_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang").collect()}
    got = op7_language_id(spark, MID).collect()
    assert len(got) == len(truth) and all(r.held_out == _held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97


def test_toxicity_on_held_out_rows(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op6_toxicity(spark, MID).collect()}
    out = [(got[i], t) for i, t in truth.items() if got[i].held_out]
    assert all(r.predicted == (r.score >= 0.3) for r, _ in out)
    assert sum(r.predicted == t for r, t in out) / len(out) > 0.94


def test_neutral_mentions_move_little(spark):
    rows = [(i, ("you stupid clown go away" if i % 4 == 0 else "a calm walk by the river") + (" women" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")
    model = fit_toxicity(docs, labels)
    p = score_texts(model, ["you stupid clown", "a calm walk", "a calm walk by women", "a calm walk by men"])
    assert p[0] > 0.5 > 0.3 > p[1] and abs(p[2] - p[1]) < 0.15 and p[2] < 0.3
    long = "word " * 100 + "the Women, sang; men too"
    changed = swapped(long, 3)[1]
    assert changed.startswith("word " * 100) and "women" not in changed.lower() and len(changed.split()) == len(long.split())
    assert TERM_PLACE[changed.split()[101].strip(",")][0] == TERM_PLACE["women"][0]


def test_texts_of_marks_and_ties(spark):
    docs = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([("one two three four", "en"), ("un deux trois", "fr")] * 40)], "doc_id long, text string, lang string")
    model = fit_languages(docs)
    odd = spark.createDataFrame([(1, "\u0301\u0301 \u0301"), (2, "one deux"), (3, "x" * 300_000), (4, "one two " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in predict_languages(odd, model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] in ("en", "fr") and got[3][0] in ("en", "fr") and got[4][0] == "en"
    same = fit_toxicity(docs, spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, toxic int"))
    assert len(set(score_texts(same, ["", "?", "\u0301"]).tolist())) == 1


def test_edge_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "12 !?", None, "a"), (4, "hello there " * 30, "en", "a"), (4, "hello there " * 30, "en", "a"), (None, "bonjour", "fr", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxicity string")
    model = fit_languages(docs)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in predict_languages(docs, model).collect())
    assert [x for _, x in got if x == "und"] == ["und"] * 3 and all(g[1] in model.names for g in got if g[0] in (0, 4))
    assert {r.lang_pred for r in predict_languages(docs, fit_languages(docs.limit(0))).collect()} == {"und"}
    assert predict_languages(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, fit_toxicity(docs, labels))
    assert out.count() == 6 and dict(out.dtypes)["toxicity"] == "double"
    assert {r.toxic_pred for r in score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).collect()} == {0}


def test_languages_are_the_same_in_any_order(spark):
    """One id with very many rows doesn't push a language out, whichever partition comes first."""
    hot = next(i for i in range(100_000, 200_000) if zlib.crc32(str(i).encode()) % 4 != 2)
    english = [(hot, f"the house of the man number {k}", "en") for k in range(600)]
    french = [(k, f"la maison de monsieur numero {k}", "fr") for k in range(200)]
    models = [fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), per_language=20) for rows in (english + french, french + english)]
    assert all(sorted(m.names) == ["en", "fr"] for m in models)
    assert np.array_equal(*(next(v for v in vars(m).values() if isinstance(v, np.ndarray)) for m in models))
