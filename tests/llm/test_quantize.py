import hashlib
import math
import random
import re

import numpy as np
import pytest

from tessella.llm import quantize

DDL = "vec_id long, embedding array<double>, label int, v string, a int, codes string"


def whole(v, scale=1024):
    return [math.floor(scale * x) for x in v]


def brute(rows, parts=4, entries=256, rounds=4):
    usable = [(i, whole(v), y) for i, v, y, *_ in rows if i is not None and v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (r[0], r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    w = len(usable[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    books = [[cut(v, p) for _, v, _ in usable[:entries]] for p in range(parts)]
    near = lambda v, p: min((far(cut(v, p), b), j) for j, b in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(parts)] for _, v, _ in usable]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(usable, codes) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    out, by = [], {}
    for i, v, y in usable:
        found = [near(v, p) for p in range(parts)]
        out.append((i, y, [j for _, j in found], sum(d for d, _ in found)))
        by[y] = by.get(y, 0) + out[-1][-1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return sorted((i, -1 if y is None else y, c, min(e, most), min(by[y], most), digest) for i, y, c, e in out)


def check(spark, rows, **kw):
    got = quantize.product_codes(spark.createDataFrame(rows, DDL), **kw).collect()
    assert sorted((r.vec_id, -1 if r.label is None else r.label, r.codes, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute(rows, **{k: v for k, v in kw.items() if k != "scale"})


def vectors(n, d=8, seed=1):
    r = random.Random(seed)
    return [(i, [r.gauss(i % 5, 0.3) for _ in range(d)], i % 3, "x", 0, "c") for i in range(n)]


def test_equals_lloyd_in_whole_numbers(spark):
    check(spark, vectors(150), entries=16)
    check(spark, vectors(40, seed=2), rounds=2)  # fewer rows than entries


def test_ties_copies_nulls_and_lengths(spark):
    grid = [(i, [float(i % 2), 0.0, float(i % 3), 1.0], None if i % 4 else 1, "", 0, "") for i in range(60)]
    same = [(100 + i, [0.5] * 4, 0, None, None, None) for i in range(40)]
    odd = [
        (5, None, 1, "", 1, ""),
        (6, [0.1, None, 0.0, 0.0], 1, "", 1, ""),
        (7, [float("nan")] * 4, 1, "", 1, ""),
        (8, [float("inf")] * 4, 1, "", 1, ""),
        (None, [0.1] * 4, 1, "", 1, ""),
        (9, [], 1, "", 1, ""),
        (11, [0.3, 0.2], 1, "", 1, ""),
        (12, [0.3] * 8, 1, "", 1, ""),
        (13, [1.0, 2.0, 3.0, 4.0], 1, "", 1, ""),
        (13, [1.0, 2.0, 3.0, 4.0], 2, "", 1, ""),
    ]
    check(spark, grid + same + odd, entries=8)


def test_numbers_beyond_doubles(spark):
    r = random.Random(3)
    check(spark, [(i, [r.choice([-1, 1]) * 10.0 ** r.randint(0, 30) for _ in range(4)], i % 2, "", 0, "") for i in range(30)], entries=5, rounds=2)


def test_empty(spark):
    got = quantize.product_codes(spark.createDataFrame([], DDL))
    assert got.count() == 0 and got.columns == ["vec_id", "label", "codes", "error", "label_error", "codebooks_sha256"]
    assert quantize.product_codes(spark.createDataFrame([(1, None, 1, "", 0, "")], DDL)).count() == 0


def test_bounds_save_scans_and_change_nothing():
    r = np.random.default_rng(4)
    points = np.floor(r.normal(size=(2000, 6)) * 40 + r.integers(0, 8, (2000, 1)) * 500)
    book = points[:32].copy()
    state, before, scans = None, book, []
    for _ in range(6):
        moved = np.sqrt(((book - before) ** 2).sum(axis=1)) * (1 + quantize.SLACK)
        entry, upper, lower, own, n = quantize.assign(points, book, state, moved, quantize.spread(book))
        all_ = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (entry == all_.argmin(axis=1)).all() and (own == all_.min(axis=1)).all()
        state, before, scans = (entry, upper, lower), book, [*scans, n]
        book = np.array([np.floor(points[entry == j].mean(axis=0)) if (entry == j).any() else book[j] for j in range(len(book))])
    assert scans[0] == 2000 and scans[-1] < 600


def test_approximation_is_what_the_error_measures(spark):
    df = spark.createDataFrame(vectors(50), DDL)
    usable = df.selectExpr("vec_id", "label", "transform(embedding, x -> CAST(floor(1024 * x) AS DOUBLE)) AS v")
    state, books = quantize.train(usable, entries=8)
    rows = state.selectExpr("vec_id", "v", "a AS codes", "e").cache()
    near = quantize.approximated(rows, books).join(rows, "vec_id").collect()
    assert len(near) == 50 and all(sum((x - y) ** 2 for x, y in zip(r.v, r.approximation)) == r.e for r in near)


@pytest.mark.parametrize("name", ["op12_codes"])
def test_registered_query(spark, sf, name):
    from tessella.llm.queries import QUERIES

    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(re.fullmatch("[0-9a-f]{8}", r.code) for r in rows)
