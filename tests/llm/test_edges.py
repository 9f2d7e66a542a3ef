"""Every operator on odd rows, on an empty table, and on clashing column names."""

import pytest
from helpers import empty_documents, odd_documents

from pathloom.llm import chat, media, ngram_join, packing, pii, quality_crf, quality_rules, segmentation, toxicity, url_filter


@pytest.fixture(scope="module")
def tagger():
    return pii.fit([], windows=128, epochs=1)


def operators(tagger):
    return {
        "pii": lambda d: pii.find(d, tagger),
        "rules": quality_rules.judge,
        "toxicity": lambda d: toxicity.score(d, toxicity.Net()),
        "join": ngram_join.jaccard_components,
        "quality": lambda d: quality_crf.score(d, quality_crf.Chain()),
        "media": lambda d: media.audio(d, keep=False),
        "segment": lambda d: segmentation.segment(d, segmentation.default_vocabulary()),
    }


@pytest.mark.parametrize("name", ["pii", "rules", "toxicity", "join", "quality", "media", "segment"])
def test_one_row_for_each_row(spark, tagger, name):
    docs = odd_documents(spark)
    got = operators(tagger)[name](docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
    twins = [r.asDict() for r in got if r["doc_id"] == 7]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert operators(tagger)[name](empty_documents(spark)).count() == 0


def test_packing_takes_odd_rows(spark):
    docs = odd_documents(spark)
    got = packing.pack(docs, packing.default_vocabulary()).collect()
    first = [r for r in got if r["piece"] == 0]
    assert len(first) == docs.count()
    assert all(r["length"] == 1 for r in first if r["doc_id"] in (0, 1, 2, 4))
    assert packing.pack(empty_documents(spark), packing.default_vocabulary()).count() == 0


def test_filters_and_redaction_keep_all_columns(spark, tagger):
    docs = odd_documents(spark)
    for out in (quality_rules.clean(docs), quality_crf.keep_good(docs, quality_crf.Chain()), ngram_join.deduplicate(docs), pii.redact_all(docs, tagger)):
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    assert pii.redact_all(docs, tagger).where("doc_id = 0").first()["text"] is None
    assert ngram_join.deduplicate(docs).where("doc_id = 7 or doc_id = 8").count() == 1
    for f in (quality_rules.clean, ngram_join.deduplicate):
        assert f(empty_documents(spark)).count() == 0


def test_urls_that_are_none(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://h" + "a" * 100_000, "x://net/", "x://net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://b.org/fr/", "h")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, url_filter.default_rules()).collect()}
    assert len(got) == len(urls) + 1
    for i in range(5):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow")
    assert (got[5]["host"], got[5]["path"], got[5]["rule"], got[5]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[7]["verdict"] == got[8]["verdict"] == "block" and got[None]["rule"] == "org/fr/"
    assert url_filter.filter_urls(pages.where("false"), url_filter.default_rules()).count() == 0


def test_conversations_that_are_odd(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "a"), (None, 0, "assistant", "b"), (2, 3, "assistant", ""), (2, 5, "system\nrole", "x\n" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_parts(chat.F.col("text")).alias("parts"), chat.F.lit(1).alias("segments"), chat.F.lit(2).alias("turns"))
    got = {r["conv_id"]: r for r in chat.format_chats(turns).select("*", chat.read_back(chat.F.col("formatted")).alias("back")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("user", "a"), ("", ""), ("", "")]
    assert [(t["role"], t["text"]) for t in got[None]["back"]] == [("assistant", "b")]
    assert [(t["role"], t["text"]) for t in got[2]["back"]] == [("assistant", ""), ("system\nrole", "x\n" * 100_000)]
    assert chat.format_chats(turns.where("false")).count() == 0
