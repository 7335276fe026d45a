import math
import random

import numpy as np

from tessella.llm import kdtree

DDL = "vec_id long, embedding array<float>, label int, v string, d int"


def brute(rows, k, every):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def check(spark, rows, every=5, k=5):
    got = kdtree.top_inner_products(spark.createDataFrame(rows, DDL), f"vec_id % {every} = 0", k).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k, every)


def vectors(n, d=8, seed=1):
    r = random.Random(seed)
    return [(i, [r.uniform(-1, 1) for _ in range(d)], i, "x", 0) for i in range(n)]


def test_one_shard_and_several(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "LEAF", 4)
    check(spark, vectors(120))
    monkeypatch.setattr(kdtree, "SHARD", 30)
    check(spark, vectors(120))
    monkeypatch.setattr(kdtree, "QUERIES", 3)
    monkeypatch.setattr(kdtree, "BOXES", 0)
    check(spark, vectors(120, seed=2))


def test_ties_copies_nulls_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 30)
    same = [(100 + i, [0.5] * 8, 0, None, None) for i in range(60)]
    odd = [(5, None, 1, "", 1), (10, [0.1, None] + [0.0] * 6, 1, "", 1), (15, [float("nan")] * 8, 1, "", 1), (20, [float("inf")] * 8, 1, "", 1), (None, [0.1] * 8, 1, "", 1), (25, [], 1, "", 1), (30, [0.3, 0.2], 1, "", 1), (31, [0.3, 0.2], 1, "", 1)]
    check(spark, vectors(5) + same + odd)


def test_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(3)
    points, ids = np.floor(r.normal(size=(500, 6)) * 256), np.arange(500)
    points[:200] = points[0]
    tree = kdtree.build(ids, points, leaf=8)
    queries = points[::50]
    for q, found in zip(queries, kdtree.search(tree, queries, ids[::50], [-np.inf] * len(queries), 7)):
        score = points @ q
        me = int(np.flatnonzero((queries == q).all(axis=1))[0]) * 50
        want = sorted(((-int(s), int(i)) for i, s in zip(ids, score) if i != me))[:7]
        assert [(s, -j) for s, j in found] == [(-s, i) for s, i in want] or me == 0


def test_large_components(spark):
    rows = [(i, [1e14 * (i + 1), 1.0], 0, "", 0) for i in range(3)]
    got = kdtree.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string, d int").selectExpr("vec_id", "embedding"), "vec_id = 0", 1, scale=1e-6)
    assert [(r.query_id, r.vec_id) for r in got.collect()] == [(0, 2)]


def test_scores_beyond_64_bits_are_its_ends(spark):
    rows = [(i, [x, 1.0], 0, "", 0) for i, x in enumerate((3e38, 3e38, -3e38, 2e38, 0.0, 1.0))]
    got = kdtree.top_inner_products(spark.createDataFrame(rows, DDL), "vec_id = 0", 5).collect()
    top, least = (1 << 63) - 1, -(1 << 63)
    one = 256 * math.floor(256 * float(np.float32(3e38)))
    assert one > top
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, top), (3, top), (5, top), (4, 65536), (2, least)]


def test_shards_are_dealt_by_medians(spark, monkeypatch):
    r = np.random.default_rng(5)
    splits = kdtree.coarse_splits(list(r.normal(size=(400, 3))), 7)
    leaves = sorted(-1 - c for _, _, a, b in splits for c in (a, b) if c < 0)
    assert leaves == list(range(7)) and kdtree.coarse_splits([], 7) == [] and kdtree.coarse_splits([np.ones(3)] * 9, 7) == []
    monkeypatch.setattr(kdtree, "SHARD", 30)
    clusters = [(i, [float(i % 4 * 10 + x) for x in r.normal(size=4)], 0, "", 0) for i in range(160)]
    check(spark, clusters)


def test_empty(spark):
    assert kdtree.top_inner_products(spark.createDataFrame([], DDL), "vec_id % 5 = 0", 5).count() == 0
