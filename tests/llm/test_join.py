"""The n-gram join against all pairs, and its parts against what they promise."""

import random

import numpy as np
import pytest
from helpers import jaccard_components, prose
from pyspark.sql import functions as F

from pathloom.llm import common, ngram_join
from pathloom.llm.components import components, keep_first


def corpus(seed, n=160):
    """Prose with chains of near copies around the bound, exact copies, short texts and shared passages."""
    rng = random.Random(seed)
    docs, common = [], prose(rng, 60)
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 or not docs:
            t = prose(rng, rng.randrange(1, 120))
        elif kind == 1:
            t = rng.choice(docs)[1]
        elif kind == 2:
            w = rng.choice(docs)[1].split() or ["x"]
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            t = " ".join(w)
        elif kind == 3:
            w = rng.choice(docs)[1].split()
            t = " ".join(w[: max(0, len(w) - rng.randrange(4))]).upper()
        elif kind == 4:
            t = common + " " + prose(rng, rng.randrange(1, 12))
        else:
            t = rng.choice(["", "one", "one two", "One\tTwo", "one two three", " "])
        docs.append((i + 10, t))
    return docs


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2), (3, 90, 3)])
def test_components_equal_those_of_all_pairs(spark, words, percent, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words, percent).collect()}
    assert got == jaccard_components(docs, words, percent)


@pytest.mark.parametrize("seed,edits,pivots", [(8, 4, 8), (9, 14, 2), (10, 8, 1)])
def test_tiles_of_a_large_block_lose_no_link(spark, monkeypatch, seed, edits, pivots):
    """A block of several tiles: copies near its pivots, copies near those only, and repeated ids with other texts."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    monkeypatch.setattr(ngram_join, "COLUMN", 16)
    rng = random.Random(seed)
    docs, texts = [], [" ".join(f"w{i}" for i in range(200))]
    for i in range(90):
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
        docs.append((i, texts[-1]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == jaccard_components(docs, 3, 90)


def test_pivots_of_one_tree_stay_linked(spark, monkeypatch):
    """Pivots P1 ~ P3 ~ P2 with P1 and P2 too far apart, in a block whose rows are all in their tree, so that no tiles are multiplied."""
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    class_of = {r["id"]: r["c"] for r in spark.range(200).selectExpr("id", "pmod(xxhash64(id), 3) c").collect()}
    pivots = sorted(min(i for i in class_of if class_of[i] == c) for c in range(3))
    edit = lambda w, at: [f"n{k}" if k in at else x for k, x in enumerate(w)]
    base = [f"w{i}" for i in range(200)]
    p1, p2 = edit(base, (5, 25, 45)), edit(base, (155, 175, 195))
    docs = list(zip(pivots, [" ".join(p1), " ".join(p2), " ".join(base)]))
    for k, i in enumerate(range(pivots[2] + 1, pivots[2] + 21)):
        docs.append((i, " ".join(edit((p1, p2)[k % 2], (60 + 4 * k,)))))
    want = jaccard_components(docs, 3, 90)
    assert {c for _, c in want.values()} == {pivots[0]}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_sparse_product_counts_what_sets_share():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40), dtype=np.uint64)) for _ in range(50)]
    columns = [np.unique(rng.integers(0, 60, rng.integers(0, 40), dtype=np.uint64)) for _ in range(9)]
    want = np.array([[len(np.intersect1d(s, c)) for c in columns] for s in sets])
    assert (ngram_join.overlaps(sets, columns) == want).all()
    assert ngram_join.overlaps([], columns).shape == (0, 9) and ngram_join.overlaps(sets, []).shape == (50, 0)
    linked = ngram_join.links_of(sets, columns, 40, 100)
    assert all(linked[i, j] == (want[i, j] > 0 and want[i, j] >= 0.4 * (len(sets[i]) + len(columns[j]) - want[i, j])) for i in range(50) for j in range(9))


def test_pivot_trees_are_closed_under_links():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    step = lambda s, k: np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
    chain = [base]
    for _ in range(3):
        chain.append(step(chain[-1], 4))
    far = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64))
    assert ngram_join.pivot_forest([chain[0], far, chain[1], chain[2]], 90, 100)[0] == [0, 1, 0, 0]
    assert ngram_join.links_of([chain[3]], [chain[2], chain[0], base[:0]], 90, 100).tolist() == [[True, False, False]]


def test_the_query_matches_its_sql(same_as_sql):
    same_as_sql(ngram_join.op6, ngram_join.SQL)


@pytest.mark.parametrize("p,q", [(90, 100), (80, 100), (50, 100), (100, 100)])
def test_linked_sets_meet_and_are_not_discarded(p, q):
    """Any two sets that reach the bound share a column, and their histograms differ no more than it allows."""
    rng = np.random.default_rng(p)
    classes = rng.integers(0, 256, 1 << (ngram_join.ENTRY_BITS - 3)).astype(np.uint8)
    for size in [1, 2, 3, 5, 9, 10, 11, 17, 19, 20, 33, 64, 100, 101, 150, 333, 700, 2000]:
        for _ in range(25):
            own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            most = 2 * size * (q - p) // (q + p)  # take and add as many as the bound allows
            take = int(rng.integers(0, most + 1))
            other = np.unique(np.concatenate([rng.choice(own, len(own) - min(take, len(own)), replace=False), rng.integers(0, 1 << 63, most - take, dtype=np.uint64)]))
            both = len(np.intersect1d(own, other))
            if len(other) and both * q >= p * (len(own) + len(other) - both):
                assert set(ngram_join.rarest(own, classes, p, q).tolist()) & set(ngram_join.rarest(other, classes, p, q).tolist()), (size, take)
                least = ngram_join.least_difference([ngram_join.histogram(own)], [ngram_join.histogram(other)])[0]
                assert least <= len(own) + len(other) - 2 * both <= (len(own) + len(other)) * (q - p) // (q + p)


def test_sets_at_the_bound_share_a_whole_range():
    rng = np.random.default_rng(90)
    for size in [1, 2, 3, 5, 9, 10, 11, 17, 19, 20, 33, 64, 100, 101, 150, 333, 700, 2000]:
        for _ in range(25):
            own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            most = 2 * size * 10 // 190
            take = int(rng.integers(0, most + 1))
            other = np.unique(np.concatenate([rng.choice(own, len(own) - take, replace=False), rng.integers(0, 1 << 63, most - take, dtype=np.uint64)]))
            both = len(np.intersect1d(own, other))
            if len(other) and both * 100 >= 90 * (len(own) + len(other) - both):
                assert set(ngram_join.signatures(own, 90, 100).tolist()) & set(ngram_join.signatures(other, 90, 100).tolist()), (size, take)


def test_histograms_discard_sets_that_share_little():
    rng = np.random.default_rng(1)
    for n in (100, 400, 3000, 20_000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        assert ngram_join.least_difference([ngram_join.histogram(a)], [ngram_join.histogram(b)])[0] > 2 * n * 20 // 180


def test_frequent_columns_come_last(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 20)
    docs = spark.createDataFrame([(i, f"a b c d e f g{i} h{i} i{i}") for i in range(60)] + [(100 + i, f"x y z w{i % 3}") for i in range(33)], "doc_id long, text string").repartition(5)
    bits = ngram_join.frequent_grams(docs, 3)
    sets = lambda t: ngram_join.shingle_sets(ngram_join.Scan([t], lower=True), 3)[0]
    listed = lambda g: bool(bits[int(g) >> (64 - ngram_join.ENTRY_BITS) >> 3] >> (int(g) >> (64 - ngram_join.ENTRY_BITS) & 7) & 1)
    counted = lambda g: int(ngram_join.mix(np.array([g]))[0]) >> 63 == 0
    common, rare = [*sets("a b c d e f"), *sets("x y z")], [*sets("e f g1 h1 i1"), *sets("y z w1")]
    assert [listed(g) for g in common] == [counted(g) for g in common] and not any(listed(g) for g in rare)
    assert int(np.unpackbits(bits).sum()) == sum(map(counted, common))
    own = sets("a b c d e f g1 h1 i1")
    last = {g for g in own.tolist() if listed(g)}
    assert not last & set(ngram_join.rarest(own, bits, 60, 100).tolist())


def test_product_gives_a_spanning_forest():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets, ids = [], list(range(40))
    for i in ids:
        s = base if i % 2 else np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        sets.append(np.unique(np.concatenate([s[: 60 - i % 3], rng.integers(0, 1 << 63, i % 3, dtype=np.uint64)])))
    links = ngram_join.product_links(ids, sets, 90, 100)
    nodes = {x for e in links for x in e}
    assert nodes == {i for i in ids if i % 2} and len(links) == len(nodes) - 1


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (202, 202)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 201: 200}
    for n, m in ((30, 20), (60, 50), (80, 120)):  # graphs of small and of large components
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for u, v in edges:
            a, b = root[u], root[v]
            root = [min(a, b) if r in (a, b) else r for r in root]
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {i: r for i, r in enumerate(root) if i != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deduplication_keeps_the_smallest_of_each_group(spark):
    docs = corpus(5, 80)
    want = {c for _, c in jaccard_components(docs, 5, 80).values()}
    got = [r["doc_id"] for r in ngram_join.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)


def test_deduplication_keeps_every_text_of_a_repeated_id(spark):
    """One doc_id with unlinked texts loses none; rows that repeat id and text are one; maps and clashing names pass through."""
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 60, 9000) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, c), (2, a), (3, d), (3, ""), (3, None), (4, b + " end"), (None, a)]
    docs = spark.createDataFrame([(i, t, {"k": 1}, 7, 8) for i, t in rows], "doc_id long, text string, tags map<string,int>, key int, row int")
    out = ngram_join.deduplicate(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len(set(got))
    kept = {t for i, t in got if i is not None}
    assert {c, d, "", None} <= kept and sum(t == a for i, t in got if i) == 1 and sum(t in (b, b + " end") for t in kept) == 1 and (None, a) in got


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark):
    """Ids take few bytes in files: 700,000 of them are under Spark's threshold for a broadcast, and ten times that in the driver."""
    docs = spark.range(700_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    kept = keep_first(docs, lambda d: d.select("doc_id", F.lit(0).cast("long").alias("component_id")))
    assert "Broadcast" not in plan_of(kept)
    assert kept.count() == 1
    few = keep_first(docs, lambda d: d.select("doc_id", F.when(F.col("doc_id") < 5, 0).otherwise(F.col("doc_id")).alias("component_id")))
    assert "BroadcastHashJoin" in plan_of(few)
    assert few.count() == 700_000 - 4


def test_no_join_of_op6_broadcasts_a_large_table(spark, sf, monkeypatch):
    """With tables taken as large from the first byte, the only broadcasts are bit tables, which are asked for."""
    plans, write = [], common.shared_table

    def noted(df, tag):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, tag)

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "shared_table", noted)
    docs = common.table(spark, sf, "documents")
    found = ngram_join.jaccard_components(docs).collect()
    joins = [line for tag, plan in plans if tag in ("ngram-member", "ngram-texts", "ngram-columns", "ngram-blocks") for line in plan.splitlines() if "Join" in line]
    assert joins and all("strategy=merge" in line for line in joins)
    monkeypatch.undo()
    assert sorted(found) == sorted(ngram_join.jaccard_components(docs).collect())
