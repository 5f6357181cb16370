"""Every stage against a brute-force version of its decision, on its own input."""

import re

import corpus_pipeline
import pytest
from latticework.llm import decontamination, near_duplicates, secrets, toxicity
from latticework.llm.common import written
from latticework.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input, output) of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        made = written(f(spark, docs, sf_dir), name)
        out[name] = docs, made
        docs = made
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        assert name == "sentencepiece" or before.schema == after.schema


def test_toxicity_drops_and_keeps_whole_rows(stages):
    before, after = map(texts, stages["toxicity"])
    assert after.items() <= before.items() and len(after) > 0.8 * len(before)


def test_toxicity_keeps_what_scores_below_the_threshold(spark, sf_dir, stages):
    docs, after = stages["toxicity"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.in_training)
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxic_passages(docs, model).collect()}
    assert set(texts(after)) == {i for i, x in scores.items() if x < toxicity.THRESHOLD}


def test_minhash_keeps_rows_of_one_id_together(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en"), (2, words + " more", "en"), (3, "quite another text of six words", "en"), (3, "and a second text under that id", "en"), (3, "and a second text under that id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.minhash(spark, docs, "").collect())
    assert kept == sorted({(i, t) for i, t, _ in rows if i != 2})


def test_minhash_keeps_the_first_of_each_group(stages):
    before, after = map(texts, stages["minhash"])
    groups = near_duplicates.brute_force(list(before.items()))
    assert after == {i: t for i, t in before.items() if groups[i][1] == i}


def test_decontamination_drops_what_holds_a_window(spark, sf_dir, stages):
    before, after = map(texts, stages["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [split(t)] for i in range(len(w) - 9)}
    assert all(len(split(t)) >= decontamination.WINDOW for _, t in items)
    clean = lambda t: all(tuple(w[i : i + 10]) not in windows for w in [split(t)] for i in range(len(w) - 9))
    assert after == {i: t for i, t in before.items() if clean(t)}


def test_secrets_are_replaced_and_all_rows_stay(spark, stages):
    before, after = map(texts, stages["secrets"])
    assert before.keys() == after.keys()
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(stages["secrets"][0]).collect()}
    for i, t in before.items():
        want, at = "", 0
        for s in spans[i]:
            want, at = (want + t[at : s["start"]] + "[SECRET]" if s["start"] >= at else want), max(at, s["end"])
        assert after[i] == want + t[at:]
    assert stages["secrets"][1].where("text LIKE '%[SECRET]%' AND n_chars <> length(text)").isEmpty()


def test_ids_are_the_librarys(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    before, after = texts(stages["sentencepiece"][0]), stages["sentencepiece"][1].collect()
    assert {r["doc_id"]: list(r["ids"]) for r in after} == {i: sp.encode(t) for i, t in before.items()}
    assert all(r["n_pieces"] == len(r["ids"]) for r in after)


def test_odd_documents_pass(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x", "en", "s", 1), (3, "a b " * 9000, "en", None, 36000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, n in ((docs, 4), (docs.limit(0), 0)):
        d = frame
        for _, f in corpus_pipeline.STAGES:
            d = written(f(spark, d, sf_dir), "odd")
        assert d.count() == n
