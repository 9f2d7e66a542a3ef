"""Each stage of the corpus pipeline, on all that the one before it kept, against a plain restatement."""

import re

import pytest
from helpers import empty_documents, jaccard_components

import corpus_pipeline
from pathloom.llm import packing, pii, quality_crf, quality_rules
from pathloom.llm.common import labelled_sample, table


@pytest.fixture(scope="module")
def run(spark, sf, tmp_path_factory):
    out, docs = {}, table(spark, sf, "documents")
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "ngram_jaccard_join", "pii", "best_fit_packing"]


def test_all_but_the_last_return_the_columns_of_documents(run):
    for name in ("quality_rules", "quality_classifier", "ngram_jaccard_join", "pii"):
        assert run[name][0].asDict().keys() == run["documents"][0].asDict().keys()


def test_rules_stage(run):
    texts = [r["text"] for r in run["documents"]]
    want = {}
    for lo, _, f, cleaned in quality_rules.clean_texts(texts):
        want |= {run["documents"][lo + i]["doc_id"]: t for i, t in enumerate(cleaned) if f["kept"][i]}
    assert {i: r["text"] for i, r in by_id(run["quality_rules"]).items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in run["quality_rules"])


def test_classifier_stage(run, spark, sf):
    net = quality_crf.fit(labelled_sample(table(spark, sf, "documents"), table(spark, sf, "labels"), "quality", quality_crf.SAMPLE))
    scores = net.scores([r["text"] for r in run["quality_rules"]])
    assert set(by_id(run["quality_classifier"])) == {r["doc_id"] for r, s in zip(run["quality_rules"], scores) if s >= 0.5}


def test_join_stage(run):
    docs = [(r["doc_id"], r["text"]) for r in run["quality_classifier"]]
    want = {c for _, c in jaccard_components(docs, 5, 80).values()}
    assert set(by_id(run["ngram_jaccard_join"])) == want and len(run["ngram_jaccard_join"]) == len(want)


def test_personal_data_stage(run):
    before = by_id(run["ngram_jaccard_join"])
    assert set(by_id(run["pii"])) == set(before)
    for r in run["pii"]:
        assert pii.base_spans(re.sub(r"\[[A-Z]+\]", " ", r["text"])) == []
        if not pii.TRIGGER.search(before[r["doc_id"]]["text"]):
            assert r["text"] == before[r["doc_id"]]["text"]


def test_packing_stage_and_run(run, spark, sf):
    from test_pieces_packing import check_packing

    docs = {r["doc_id"]: r["text"] for r in run["pii"]}
    check_packing(run["best_fit_packing"], docs)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole) == key(run["best_fit_packing"])


def test_good_documents_reach_the_join(run, spark, sf):
    """Of the documents labelled good that are long enough, the filters keep all."""
    good = {r["doc_id"] for r in table(spark, sf, "labels").where("quality = 1").collect()}
    long_enough = {r["doc_id"] for r in run["documents"] if r["doc_id"] in good and len((r["text"] or "").split()) >= 50}
    kept = set(by_id(run["quality_classifier"]))
    assert len(long_enough - kept) <= 0.02 * len(long_enough)


def test_empty_documents_pass_all_stages(spark, sf):
    docs = empty_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
    assert packing.CAPACITY == 2048
