import pytest
from tokenizers import Tokenizer

import public_tokenizers
from furrow.llm.toxicity import fit_toxicity, score_texts
from tests.llm.test_decontamination import brute
from tests.llm.test_duplicates import brute_classes, brute_dropped

pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_on_its_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    stages = dict(pipeline.STAGES)
    before = rows(docs)

    out = stages["toxicity"](spark, docs, small)
    model = fit_toxicity(docs, spark.read.parquet(f"{small}/labels.parquet"))
    ids = list(before)
    scores = dict(zip(ids, score_texts(model, [before[i].text for i in ids])))
    assert out.columns == docs.columns and set(rows(out)) == {i for i in ids if scores[i] < 0.3}

    out = rows(stages["line_dedup"](spark, docs, small))
    gone = brute_dropped([(i, r.text) for i, r in before.items()])
    wrong = sum(out[i].text != "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone.get(i, [])) for i, r in before.items())
    assert set(out) == set(before) and wrong <= 4 and all(len(r.text) == r.n_chars for r in out.values())

    out = rows(stages["near_duplicates"](spark, docs.union(docs), small))
    classes = brute_classes([(i, r.text) for i, r in before.items()])
    assert len(set(out) ^ set(classes.values())) <= 1

    out = rows(stages["decontamination"](spark, docs, small))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = {i for i, r in before.items() if brute(items, r.text)[1]}
    assert set(out) == set(before) and {i for i in out if out[i].text != before[i].text} == hit

    out = rows(stages["bpe"](spark, docs, small))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(list(out[i].ids) == lib.encode(r.text, add_special_tokens=False).ids for i, r in before.items())


def test_run(spark, small):
    out = pipeline.run(spark, small)
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    assert 0 < out.count() < n and out.columns[:2] == ["doc_id", "n_tokens"]


def test_null_rows(spark, small):
    docs = spark.createDataFrame([(None, "a b", "en", "s", 3), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() >= 3 and pipeline.STAGES[-1][1](spark, docs, small).count() >= 3


def test_clashing_columns_repeated_ids_and_empty_tables(spark, small):
    """Columns named like results keep their values; rows of one id are told apart by their texts."""
    rows = [(1, "first line\nshared text of both", "en", "s", 0, 7.0, 7, "k", "k"), (1, "shared text of both\nanother line", "en", "s", 0, 8.0, 8, "k", "k"), (2, "a b c d e f g h", "en", "s", 0, 9.0, 9, "k", "k")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, n_hit int, line_dropped string, class_id string"
    docs = spark.createDataFrame(rows, columns)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        got = {r.toxicity: r for r in out.collect()}
        assert set(got) == {7.0, 8.0, 9.0} and all((r.n_hit, r.line_dropped, r.class_id) == (int(t), "k", "k") for t, r in got.items())
        if name == "line_dedup":
            assert "".join(r.text for r in got.values()).count("shared text") == 1 and "another line" in got[7.0].text + got[8.0].text
        assert stage(spark, docs.limit(0), small).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0


def test_chain_on_rows_that_become_empty(spark, small):
    """The stages in a row against plain Python: lines that stand elsewhere go, emptied documents stay, copies go."""
    line = "one equal line that several documents have and nothing else"
    texts = [line, line, line, f"{line}\nmore words of the fourth document stand here alone", "", "  \n ", None, "alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", "12 34"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    seen, want = set(), []
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or x not in seen)
        seen.update((t or "").split("\n"))
        want.append((i, kept))
    step = stages["line_dedup"](spark, docs, small)
    assert rows(step) == want
    step = stages["near_duplicates"](spark, step, small)
    first, kept = set(), []
    for i, t in want:
        if t is None or not t.strip() or t not in first:
            kept.append((i, t))
        first.add(t)
    assert rows(step) == kept and {1, 2, 4, 5, 6, 8} <= {i for i, _ in kept}
    step = stages["decontamination"](spark, step, small)
    assert rows(step) == kept
    assert sorted(r.doc_id for r in stages["bpe"](spark, step, small).collect()) == [i for i, _ in kept]
