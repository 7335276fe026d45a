import bisect
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import frame, row, texts
from tessella.llm import sharding


def test_counts_are_even_and_slots_have_no_gaps(spark):
    rows = texts() + [row(d % 40, f"t{d % 7}") for d in range(300)] + [row(500, "same")] * 200
    got = sharding.shard_rows(frame(spark, rows), 24).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts[s] for s in range(24)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = [(t[0], len((t[1] or "").encode()) + 8, zlib.crc32((t[1] or "").encode())) for t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(want, key=str)


def test_reruns_agree_and_few_rows_move(spark):
    rows = [row(d, f"text {d}") for d in range(2000)]
    place = lambda docs, n, slack: {r.doc_id: r.shard for r in sharding.shard_rows(docs, n, slack=slack).collect()}
    a = place(frame(spark, rows), 12, 0.25)
    assert a == place(frame(spark, rows).repartition(9), 12, 0.25)
    assert max(Counter(a.values()).values()) <= 2000 / 12 * 1.25
    b = place(frame(spark, rows), 13, 0.25)
    assert sum(a[d] != b[d] for d in a) / len(a) < 0.25


def test_flow_is_clockwise_to_the_next_with_room():
    owner = np.array([0, 1, 2], np.int32)
    counts = {0 * sharding.PARTS: 5, 1 * sharding.PARTS + 3: 1}
    moves = sharding.flow(counts, owner, [2, 2, 2])
    assert Counter((c, s) for c, a, b, s, _ in moves for _ in range(b - a)) == {(0, 0): 2, (sharding.PARTS + 3, 1): 1, (0, 1): 1, (0, 2): 2}
    assert sorted((s, slot) for c, a, b, s, first in moves for slot in range(first, first + b - a)) == [(s, i) for s in range(3) for i in range(2)]


def walked(keys, shards, nodes, room):
    """{key: (shard, slot)}: every key walks the ring on its own, one virtual node a step."""
    positions, owner = sharding.ring(shards, nodes)
    n, used, place, waiting = len(owner), [0] * shards, {}, sorted(keys)
    while waiting:
        asks = {}
        for key in waiting:
            arc = bisect.bisect_left(positions, key[0]) % n
            steps = next(j for j in range(n) if used[owner[(arc + j) % n]] < room[owner[(arc + j) % n]])
            asks.setdefault(owner[(arc + steps) % n], []).append((steps, arc, key[1] % sharding.PARTS, key))
        for shard, asking in asks.items():
            for *_, key in sorted(asking)[: room[shard] - used[shard]]:
                place[key] = (shard, used[shard])
                used[shard] += 1
        waiting = [key for key in waiting if key not in place]
    return place


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_equals_a_walk_of_each_key(spark, slack):
    rows = [row(d if d % 5 else 7, f"text {d}") for d in range(700)]  # one id holds a fifth of the rows
    docs = frame(spark, rows)
    keys = docs.select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("c"), F.xxhash64("doc_id").alias("k"), F.xxhash64(F.encode("text", "UTF-8")).alias("s")).collect()
    want = walked([(x.k, x.s, x.doc_id, x.c) for x in keys], 24, 8, sharding.capacities(len(rows), 24, slack))
    got = sharding.shard_rows(docs, 24, nodes=8, slack=slack).collect()
    assert {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got} == {(d, c): place for (_, _, d, c), place in want.items()}


def test_written_shards(spark, tmp_path):
    rows = [row(d, f"text {d}") for d in range(50)]
    sharding.write_shards(frame(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((t[0], t[1]) for t in rows)
    assert back.select("shard").distinct().count() == 4


def test_empty(spark):
    assert sharding.shard_rows(frame(spark, []), 24).count() == 0
