import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import near_dedup as N

from .conftest import odd_documents, prose


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """doc_id -> smallest reachable doc_id, by all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, shingle_set(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    for (a, b), n in common.items():
        if 100 * n >= 70 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_odd_documents(odd):
    want, size = brute([(r[0], r[1]) for r in odd_documents()])
    rows = N.components(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], size[r.doc_id], want[r.doc_id] == r.doc_id)
    assert want[103] == 3 == want[104]


def test_empty_table(none):
    assert N.components(none).collect() == [] and N.distinct(none).columns == none.columns and N.distinct(none).isEmpty()


def edited(text, rng, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in text.split())


def test_full_regions_and_chains(spark):
    """Groups larger than a region, near the threshold, with a passage that all documents share."""
    rng = random.Random(4)
    passage = prose(999, 60)
    texts = [edited(prose(1, 150), rng, 0.02) for _ in range(120)]
    texts += [passage + " " + edited(prose(50 + k, 90), rng, 0.5) for k in range(100)]
    chain = prose(2, 200).split()
    texts += [" ".join(chain[k * 12 : k * 12 + 100]) for k in range(8)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in N.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)[0]


def test_kept_rows_keep_their_columns(odd):
    left = N.distinct(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert 103 not in ids and 104 not in ids and ids.count(5) == 3 and ids.count(None) == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 62, 700).astype(np.uint64)
    a, b = N.signature(x[:600]), N.signature(x[100:])
    assert abs((a == b).mean() - 500 / 700) < 5 * math.sqrt(0.25 / N.HASHES)


def test_trees_are_deep_enough():
    for depth, count in N.LEVELS:
        assert (1 - 0.7**depth) ** count < 1e-5
    depth, count = N.LEVELS[-1]
    trees = N.orders()
    assert trees.shape == (count, depth + N.FURTHER) and all(len(set(r)) == depth + N.FURTHER for r in trees.tolist())


def test_deeper_prefixes_split_full_regions(spark):
    """A tree's regions of a level are parts of its regions of the level before."""
    rng = np.random.default_rng(3)
    sigs = [(i, rng.integers(0, 3, N.HASHES).astype("<u4").tobytes()) for i in range(200)]
    first = spark.createDataFrame(sigs, "doc_id long, signature binary")
    shallow = {(r.tree, r.doc_id): r.region for r in N.prefixes(first, 0).collect()}
    assert len(shallow) == 200 * N.LEVELS[0][1]
    deeper = spark.createDataFrame([(i, s, [0, 3] if i % 2 else [1]) for i, s in sigs], "doc_id long, signature binary, full array<short>")
    rows = N.prefixes(deeper, 1).collect()
    assert {r.tree for r in rows if r.doc_id == 7} == {0, 3, *range(N.LEVELS[0][1], N.LEVELS[1][1])}
    parts = defaultdict(set)
    for r in rows:
        if r.tree < N.LEVELS[0][1]:
            parts[r.region].add((r.tree, shallow[r.tree, r.doc_id]))
    assert parts and all(len(p) == 1 for p in parts.values())


@pytest.mark.parametrize("edges", [[], [(2, 1)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(9, 1), (9, 8), (7, 8), (6, 5)], [(k + 1, k) for k in range(40)]])
def test_connect(spark, edges):
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    got = {r.node: r.root for r in N.connect(df).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def test_neighbours_have_the_longest_common_prefixes(spark):
    rng = np.random.default_rng(6)
    rows = [(r, int(1000 * r + k), rng.integers(0, 3, 6).astype(np.uint8).tobytes()) for r in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "region long, doc_id long, rest binary")
    got = {(r.a, r.b) for r in N.neighbours(df.coalesce(1)).collect()}
    assert all(a // 1000 == b // 1000 and a > b for a, b in got)
    lcp = lambda x, y: next((k for k in range(6) if x[k] != y[k]), 6)
    for region, doc, rest in rows:
        best = max(lcp(rest, s) for r, d, s in rows if r == region and d != doc)
        partners = [s for r, d, s in rows if (max(d, doc), min(d, doc)) in got]
        assert max(lcp(rest, s) for s in partners) == best and len(partners) >= 2 - (len(partners) < 2)


@pytest.mark.parametrize("hot", [3, 10**9])
def test_spread_joins(spark, monkeypatch, hot):
    from lexmill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(k % 3 if k < 40 else k, k) for k in range(60)] + [(None, 99)], "key long, x long")
    side = spark.createDataFrame([(k, -k) for k in range(50)], "key long, y long")
    hot_ones = common.hot_keys(rows.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n")
    assert (hot_ones is None) == (hot > 60)
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(side, "key", how).collect()))
        assert sorted(map(str, common.spread_join(rows, side, ["key"], hot_ones, how).select("key", "x", "y").collect())) == want


def test_hot_keys_everywhere(spark, monkeypatch):
    """The same groups where every join is salted; a document with two texts has the links of both."""
    from lexmill.llm import common

    rng = random.Random(9)
    rows = [(i, edited(prose(i % 9, 90), rng, 0.02)) for i in range(150)] + [(200 + k, prose(3, 90)) for k in range(20)] + [(300, prose(70, 60)), (300, prose(71, 60)), (301, prose(70, 60)), (302, prose(71, 60)), (303, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.component_id for r in N.components(df).collect()}
    assert want[301] == want[302] == want[300] == 300 and want[200] == want[219]
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "SALTS", 3)
    monkeypatch.setattr(N, "HOT_STAR", 1)
    assert {r.doc_id: r.component_id for r in N.components(df).collect()} == want


def pool_family(n, rng, clauses=60, words=12):
    """Texts of random clauses of one pool, each with chance 0.7."""
    pool = [" ".join(f"c{k}w{j}" for j in range(words)) for k in range(clauses)]
    return [" ".join(pool[k] for k in range(clauses) if rng.random() < 0.7) for _ in range(n)]


def test_families_of_one_pool(spark):
    """Full regions of different texts: every link is found, whether or not the order shows it."""
    rows = list(enumerate(pool_family(3000, random.Random(7))))
    sets = [shingle_set(t) for _, t in rows]
    place = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    both, size = (m @ m.T).astype(np.int64), np.array([len(s) for s in sets])
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = np.argwhere(np.triu(100 * both >= 70 * (size[:, None] + size - both), 1))
    for a, b in linked.tolist():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in N.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(linked) > 100 and got == {i: find(i) for i in root}


@pytest.mark.parametrize("buckets", [(2000, 2_000_000), (7, 2_000_000)])
def test_crowd_links(spark, monkeypatch, buckets):
    monkeypatch.setattr(N, "BUCKET_DOCS", buckets[0])
    rng = random.Random(2)
    rows = [(i, edited(prose(i % 6, 80), rng, 0.04)) for i in range(60)] + [(100, "one two"), (101, "ONE  two")]
    members = spark.createDataFrame([(i, i, 5) for i, _ in rows], "doc_id long, component long, crowd long")
    got = {(r.a, r.b) for r in N.crowd_links(members, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    assert got == {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}


def test_shared_counts():
    rng = np.random.default_rng(5)
    draw = lambda n, top: [np.unique(rng.integers(0, top, int(rng.integers(1, 60)))).astype(np.uint64) for _ in range(n)]
    for top in (50, 5000):
        xs, ys = draw(30, top), draw(70, top)
        assert N.shared(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
