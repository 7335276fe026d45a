"""Compact matches and their marks against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import layout, search


def plain(query, text):
    q, h = "".join(query.lower().split()), text.lower()
    if not h:
        return None
    if not q:
        return 0.0, []
    edge = lambda i: h[i - 1] in search.BOUNDARIES
    best = None
    for start in range(len(h)):
        if h[start] != q[0]:
            continue
        score, at = (12 if start == 0 else 8 if edge(start) else 0) - 2 * start, [start]
        for c in q[1:]:
            i = next((i for i in range(at[-1] + 1, len(h)) if h[i] == c and (i == at[-1] + 1 or edge(i))), None)
            if i is None:
                break
            score += 6 if i == at[-1] + 1 else 8 - (i - at[-1] - 1)
            at.append(i)
        else:
            if best is None or score > best[0]:
                best = (score, at)
    return best and (best[0] - 0.05 * len(h), best[1])


@pytest.mark.parametrize("query", ["ab", "A b", "aab", "b-", "", " ", "é"])
def test_matches(spark, query):
    r = random.Random(query)
    texts = ["", "ab", "Bruntorp Facility"] + ["".join(r.choice("aAbB -./éc😀") for _ in range(r.randint(0, 12))) for _ in range(120)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.fuzzy_match(query, F.col("t")).alias("m")).collect()
    for x in rows:
        want = plain(query, x.t)
        assert (x.m is None) == (want is None), x.t
        if want:
            assert (pytest.approx(want[0]), want[1]) == (x.m.score, x.m["at"]), x.t


def test_best_of_labels_and_aliases(spark):
    rows = [("1", "red widget", False), ("1", "rw", True), ("2", "wide road", False), ("2", "row", True), ("3", "other", False)]
    got = {r.id: (r.label, round(r.score, 6), "".join(f"[{x.text}]" if x.hit else x.text for x in r.runs)) for r in search.fuzzy("rw", spark.createDataFrame(rows, "id string, label string, alias boolean")).collect()}
    assert got == {"1": ("red widget", 16.5, "[r]ed [w]idget")}


def test_marks(spark):
    row = spark.sql("SELECT 'abcd' AS l, array(0, 1, 3) AS a, array() AS n, '' AS e")
    got = row.select(*[search.mark_runs(F.col(x), F.col(y).cast("array<int>")).alias(x + y) for x, y in (("l", "a"), ("l", "n"), ("e", "n"))]).first()
    assert [[tuple(r) for r in x] for x in got] == [[("ab", True), ("c", False), ("d", True)], [("abcd", False)], []]


def test_picks_of_discs_of_all_sizes(spark):
    r = random.Random(2)
    discs = [(f"d{i:03}", r.uniform(-50, 50), r.uniform(-50, 50), 10 ** r.uniform(-1, 1.7)) for i in range(200)] + [("z", 0.0, 0.0, 0.0)]
    points = [(f"p{i}", r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(100)] + [("z", 0.0, 0.0)]
    for slop in (0.0, 2.0):
        want = {}
        for p, px, py in points:
            over = [(rad, (x - px) ** 2 + (y - py) ** 2, d) for d, x, y, rad in discs if (x - px) ** 2 + (y - py) ** 2 <= (rad + slop) ** 2]
            if over:
                want[p] = min(over)[2]
        got = layout.picked_many(spark.createDataFrame(discs, "id string, x double, y double, r double"), spark.createDataFrame(points, "point string, px double, py double"), 0.5, slop)
        assert {x.point: x.id for x in got.collect()} == want
        assert layout.levelled(spark.createDataFrame(discs, "id string, x double, y double, r double"), 0.5).groupBy("id").count().where("count > 4").count() == 0


def test_separation_tells_clusters(spark):
    r = random.Random(3)
    rows = [(f"n{i}", 10.0 * (i % 3) + r.random(), r.random(), f"c{i % 3}") for i in range(90)] + [("lone", 5.0, 5.0, "c9"), ("none", 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id string, x double, y double, community string")
    got = {x.stratum: x for x in layout.separation(df).collect()}
    assert got["intra"].pairs == 360 and got["inter"].pairs == 364
    assert got["intra"].distance < 1.5 < 8 < got["inter"].distance
    again = {x.stratum: x.distance for x in layout.separation(df.repartition(7)).collect()}
    assert again == {k: v.distance for k, v in got.items()}
    assert layout.separation(df.where("id = 'lone'")).count() == 0
