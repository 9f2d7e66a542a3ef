"""SimHash near-duplicates against all pairs, its trees against scans, and odd tables."""

import random

import numpy as np
import pytest
import xxhash
from helpers import empty_documents, lower, odd_documents, prose, words

from pathloom.llm import simhash
from pathloom.llm.common import Scratch


def plain_print(text, n=3):
    w = words(lower(text))
    runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints, radius):
    """{id: smallest id reached} for {id: [prints]} by comparing all pairs."""
    least = {i: i for i in prints}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any((a ^ b).bit_count() <= radius for a in prints[i] for b in prints[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_equal_plain_ones_whole_or_in_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one  two", "ONE two\nthree", "ünï 漢字 \U0001f600 x"] + [prose(rng, rng.randrange(1, 400), 50).replace(" ", rng.choice([" ", "  ", "\n"])) for _ in range(60)]
    want = [plain_print(t) for t in texts]
    assert simhash.fingerprints(texts).tolist() == want
    monkeypatch.setattr(simhash, "PIECE", 100)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.fingerprints([t]).tolist()[0] for t in texts] == want


@pytest.mark.parametrize("seed,radius", [(1, 2), (2, 1), (3, 3)])
def test_a_forest_finds_what_a_scan_finds(seed, radius):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (400, 4)).astype(np.uint64))
    value = np.unique(np.concatenate([centre[rng.integers(0, 5, 400)] ^ np.bitwise_xor.reduce(flips[:, : k + 1], axis=1) for k in range(4)] + [centre]))
    shard = np.sort(rng.integers(0, 7, len(value)))
    shard = np.unique(shard, return_inverse=True)[1]
    forest = simhash.Forest(shard, value)
    near = np.bitwise_count(value[:, None] ^ value[None]) <= radius
    near &= (shard[:, None] == shard[None]) & ~np.eye(len(value), dtype=bool)
    found = [(u, v) for a, b in forest.near(np.arange(len(value)), radius) for u, v in zip(a.tolist(), b.tolist())]
    assert sorted(found) == sorted(zip(*(x.tolist() for x in np.nonzero(near))))
    assert len(forest.edge) == len(value) - len(np.unique(shard))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_shards_lose_no_link_and_stay_bounded(spark, monkeypatch, radius):
    """A crowd of prints around a few centres, cut down twice, searched in chunks."""
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = random.Random(radius)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(120):
            x = c
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(200)}
    rows = [(simhash._signed(x), i) for i, x in enumerate(sorted(prints))]
    scratch = Scratch()
    df = spark.createDataFrame(rows, "print long, rep long")
    got = reach({i: [x & (1 << 64) - 1] for x, i in rows}, radius)
    edges = [(r["u"], r["v"]) for r in simhash.links(df, radius, scratch).collect()]
    label = simhash.least_reached(len(rows), *(np.array([e[k] for e in edges], np.int64) for k in (0, 1)))
    assert dict(enumerate(label.tolist())) == got
    scratch.drop(spark)


def test_components_equal_those_of_all_pairs(spark):
    rng = random.Random(9)
    docs = []
    for i in range(260):
        kind = rng.randrange(5)
        if kind < 2 or not docs:
            t = prose(rng, rng.randrange(1, 300), 200)
        elif kind == 2:
            t = rng.choice(docs)[1].upper().replace(" ", "  ")
        elif kind == 3:
            w = rng.choice(docs)[1].split() or ["x"]
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = rng.choice(["", " ", "one", "One", "one two"])
        docs.append((i + 10 if i % 20 else 5, t))  # doc_id 5 has several texts and links them
    got = simhash.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    prints = {}
    for i, t in docs:
        prints.setdefault(i, []).append(plain_print(t))
    want = reach(prints, 2)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{plain_print(t):016x}", want[i]) for i, t in docs)
    assert len(set(want.values())) < len(want)


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    got = simhash.near_components(docs).collect()
    assert len(got) == docs.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] in (0, 1, 2, 4)} == {"0" * 16}
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7}
    assert simhash.near_components(empty_documents(spark)).count() == 0


def test_deduplication_keeps_one_of_each_and_loses_no_other_text_of_an_id(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 80, 5000) for _ in range(3))
    rows = [(1, a), (2, a), (3, b), (3, c), (3, b), (4, c.upper()), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, {"k": 1}, "id") for i, t in rows], "doc_id long, text string, tags map<string,int>, _id string")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in out.collect())
    assert [g for g in got if g[0]] in ([(1, a), (3, b), (4, c)], [(1, a), (3, b), (3, c)], sorted([(1, a), (3, b), (4, c)]), sorted([(1, a), (3, b), (3, c)]))
    assert [g for g in got if not g[0]] == [(0, ""), (0, a)]
