import math
import random

from tessella.llm import negatives

DDL = "vec_id long, embedding array<double>, label int, v string, bucket int, norm string"


def brute(rows, every, k=5, m=10):
    usable = [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, q, y in {(i, tuple(v), y): None for i, v, y in usable if i % every == 0}:
        found = [(-dot(q, v), j, z) for j, v, z in usable if len(v) == len(q)]
        positives = sorted((s, j) for s, j, z in found if z == y and j != i)[:k]
        others = sorted((s, j) for s, j, z in found if z != y)
        for s, j in positives:
            hard = [(t, n) for t, n in others if 30 * -s <= 100 * -t <= 90 * -s][:m]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(hard)]
    return sorted(out)


def check(spark, rows, every=5, **kw):
    got = negatives.hard_negatives(spark.createDataFrame(rows, DDL), f"vec_id % {every} = 0", **kw).collect()
    want = brute(rows, every)
    assert sorted(tuple(r) for r in got) == want
    return want


def vectors(n, d=6, seed=1, stretch=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.choice([0.2, 1, 3]) if stretch else 1
        out.append((i, [size * r.gauss(0.3, 1) for _ in range(d)], r.randint(0, 2), "x", 0, "n"))
    return out


def small(monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET", 20)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "ANCHORS", 5)


def test_one_bucket_and_many(spark, monkeypatch):
    assert check(spark, vectors(80))
    small(monkeypatch)
    assert check(spark, vectors(150, seed=2))
    monkeypatch.setattr(negatives, "NORMS", 3)  # a norm for several buckets
    assert check(spark, vectors(150, seed=2, stretch=False))


def test_ties_copies_nulls_and_lengths(spark, monkeypatch):
    small(monkeypatch)
    same = [(100 + i, [0.5] * 6, i % 2, None, None, None) for i in range(60)]
    odd = [
        (5, None, 1, "", 1, ""),
        (10, [0.1, None] + [0.0] * 4, 1, "", 1, ""),
        (15, [float("nan")] * 6, 1, "", 1, ""),
        (20, [float("-inf")] * 6, 1, "", 1, ""),
        (None, [0.1] * 6, 1, "", 1, ""),
        (25, [0.4] * 6, None, "", 1, ""),
        (30, [], 1, "", 1, ""),
        (35, [0.0] * 6, 1, "", 1, ""),
        (40, [0.3, 0.2], 1, "", 1, ""),
        (41, [0.3, 0.2], 1, "", 1, ""),
        (42, [0.2, 0.1], 2, "", 1, ""),
        (45, [0.7] * 6, 1, "", 1, ""),
        (45, [0.7] * 6, 1, "", 1, ""),
        (45, [0.7] * 6, 2, "", 1, ""),
        (50, [-0.7] * 6, 3, "", 1, ""),
        (51, [0.7] * 6, 3, "", 1, ""),
    ]
    assert check(spark, same + odd + vectors(4))


def test_scores_beyond_64_bits_are_its_ends(spark, monkeypatch):
    small(monkeypatch)
    rows = [(i, [x, 1.0], i % 2, "", 0, "") for i, x in enumerate((3e38, 3e38, -3e38, 2e38, 1e30, 1.0, 1e8, 1e9, 1e7, 2e8))]
    check(spark, rows, every=1)


def test_low_norms_are_not_visited(spark):
    norms = negatives.np.array([10.0, 5.0, 1.0])
    import pyarrow as pa

    window = pa.array([[{"w": 0, "low": 45, "high": 99, "kth": None}, {"w": 1, "low": 2, "high": 99, "kth": None}, {"w": 2, "low": 2, "high": 99, "kth": 90}]])
    batch = pa.RecordBatch.from_arrays([pa.array([10.0]), pa.array([2], pa.int32()), window], ["norm", "d", "windows"])
    (got,) = negatives._reach(norms, 1, 3)(iter([batch]))
    assert [w["last"] for w in got.column("windows")[0].as_py()] == [1, 2, 0]


def test_empty(spark):
    got = negatives.hard_negatives(spark.createDataFrame([], DDL), "vec_id % 5 = 0")
    assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_registered_query(spark, sf):
    from tessella.llm.queries import QUERIES

    assert QUERIES["op13_negatives"](spark, sf).count() > 0
