"""Importance resampling against a plain restatement, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import empty_documents, lower, odd_documents, prose

from pathloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, most, buckets, percent=10, least=20, seed=2024):
    """{position: (n_words, n_features, weight, score, rank)}"""

    def features(text):
        w = WORD.findall(lower(text))
        return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[0]), Counter(bucket(f) for x in target for f in features(x)[0])
    n_s, n_t, rows = sum(s.values()) + buckets, sum(t.values()) + buckets, []
    for doc_id, text in docs:
        own, n = features(text)
        weight = sum(math.floor(1000 * math.log(float(t[b] + 1) * float(n_s) / (float(s[b] + 1) * float(n_t)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([n, len(own), weight, None if doc_id is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((i for i, r in enumerate(rows) if r[0] >= least and r[3] is not None), key=lambda i: (-rows[i][3], docs[i][0]))
    for k, i in enumerate(order[: percent * len(order) // 100]):
        rows[i][4] = k + 1
    return rows


@pytest.mark.parametrize("most,slice_", [(1, 4_000_000), (2, 90), (3, 4_000_000), (3, 60)])
def test_equals_a_plain_restatement(spark, monkeypatch, most, slice_):
    """Slices far shorter than a text cut it between words; no run is lost or counted twice there."""
    monkeypatch.setattr(resampling, "SLICE", slice_)
    rng = random.Random(most)
    docs = [(i, prose(rng, rng.randrange(0, 90), 60)) for i in range(120)] + [(200, "Ünï-Code 12 çé A" * 9), (201, None), (202, ""), (203, " \x00\t~"), (204, "x" * 500)]
    target = [prose(rng, 30, 20), None, "Ünï code"]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=97, percent=30)
    want = {d[0]: tuple(r) for d, r in zip(docs, plain(docs, target, most, 97, 30))}
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_ties_repeated_and_missing_ids(spark):
    """Rows that repeat a doc_id are ranked each for itself; a null doc_id is never drawn."""
    text = " ".join(["same"] * 25)
    docs = [(5, text)] * 6 + [(None, text)] * 3 + [(i, text) for i in range(6, 10)] + [(11, "short")]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string"), percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11))
    assert len(got) == len(docs) and all(r["rank"] is None and r["score"] is None for r in got if r["doc_id"] is None)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in ranked] == sorted((-r["score"], r["doc_id"]) for r in ranked)


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    got = resampling.resample(docs, docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_words"], r["n_features"], r["weight"]) == (0, 0, 0) for r in got if r["doc_id"] in (0, 1, 2, 4))
    assert resampling.resample(empty_documents(spark), docs).count() == 0
    assert resampling.resample(docs, empty_documents(spark)).count() == len(got)


def test_drawn_rows_keep_all_columns_and_lean_to_the_target(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60, 30 if i % 4 == 0 else 3000)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as _drawn_id2", "'x' as score", "'y' as rank")
    target = spark.createDataFrame([(prose(rng, 30_000, 30),)], "text string")
    out = resampling.drawn(docs, target)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == 40 and sum(i % 4 == 0 for i in ids) >= 38


def test_the_query_matches_its_sql(same_as_sql):
    same_as_sql(resampling.op11, resampling.SQL)
