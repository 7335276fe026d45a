from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brute import words
from cases import frame, row, texts
from tessella.llm import mixing


def water_fill(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else w[s] * level for s in names}
        capped |= over


def check(rows, got, block):
    sizes, per = Counter(), defaultdict(int)
    for t in rows:
        sizes[t[3]] += len(words(t[1]))
    want = water_fill(sizes)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((t[0], len(words(t[1]))) for t in rows), key=str)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        per[r.source] += r.taken
    for s, t in want.items():
        assert abs(per[s] - t) <= block


def test_targets_and_takings(spark):
    rows = texts() + [row(200 + i, "w " * 700, f"big{i % 3}") for i in range(30)]
    first = mixing.mix(frame(spark, rows), block=16)[0].collect()
    check(rows, first, 16)
    again = mixing.mix(frame(spark, rows).repartition(7), block=16)[0].collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_hot_source_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 3)
    monkeypatch.setattr(mixing, "SHARD", 8)
    rows = [row(i, "w " * (i % 40), "hot" if i % 3 else f"s{i}") for i in range(90)]
    check(rows, mixing.mix(frame(spark, rows), block=8)[0].collect(), 8)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(99)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))
    assert [r.x for r in got] != list(range(1000))


def test_pieces_are_what_is_taken(spark):
    rows = texts()
    taken, pieces = mixing.mix(frame(spark, rows), block=16)
    per = {r.key: r.n for r in pieces.groupBy("key").agg(F.sum("words").alias("n")).collect()}
    want = {r.key: r.n for r in taken.groupBy("key").agg(F.sum("taken").alias("n")).collect() if r.n}
    assert per == want
    slots = pieces.select("place", "slot", "shard").distinct().groupBy("place", "slot").count()
    assert slots.where("count > 1").count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = texts()
    docs = frame(spark, rows)
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.schema.simpleString() == docs.schema.simpleString()
    count = Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        count[r.source] += len(words(r.text))
    want = Counter()
    for r in mixing.mix(docs, block=16)[0].collect():
        want[r.source] += r.taken
    assert +count == +want


def test_empty(spark):
    rows, pieces = mixing.mix(frame(spark, []))
    assert rows.count() == 0 and pieces.count() == 0
    rows, _ = mixing.mix(frame(spark, [row(1, None), row(2, " ", None)]))
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in rows.collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_sums_before_in_two_steps(spark):
    from itertools import accumulate

    rows = [(p, i, (i * 7 + p) % 11) for p in (0, 1) for i in range(0, 2500, p + 1)]
    got = {(r.place, r.at): r.start for r in mixing._prefix(spark.createDataFrame(rows, "place int, at long, n long"), "at", "n", "place").collect()}
    for p in (0, 1):
        own = [r for r in rows if r[0] == p]
        before = [0, *accumulate(n for *_, n in own)][:-1]
        assert [got[p, i] for _, i, _ in own] == before


def test_no_exploded_table_is_broadcast(spark):
    """Spark estimates slots and held blocks as the few rows that they are made from."""
    rows = [row(i, "w " * 400, f"s{i % 3}") for i in range(60)]
    pieces = mixing.mix(frame(spark, rows), block=4)[1]
    assert pieces.count() > 0
    plan = pieces._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = []
            for other in plan[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            assert not any("Generate" in x and ("slot#" in x or "index#" in x) for x in below)
