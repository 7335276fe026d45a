"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first virtual node clockwise of its hash; when that node's shard is full it
continues clockwise to the next shard with room. Keys between two virtual nodes all take the
same way, so the flow is worked out on counts by arc (a table whose size depends on the ring
alone), and each key then finds its shard by its rank within its arc. Balance holds by the
capacities; a new shard only draws keys to itself and shifts overflow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Parts of an arc, by a hash of the text, so that an id with very many rows has many cells.
PARTS = 16


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes, as signed 64-bit integers, and their shards."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"shard {s} node {v}".encode(), digest_size=8).digest(), "big", signed=True)
    found = sorted((place(s, v), s) for s in range(shards) for v in range(nodes))
    return np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.int32)


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may hold; without slack they are the exact even counts."""
    even = [total // shards + (s < total % shards) for s in range(shards)]
    return even if not slack else [max(e, int(total / shards * (1 + slack))) for e in even]


def flow(counts: dict[int, int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each cell's rows go.

    Every round, each arc with rows left asks the next shard with room clockwise of it; a shard
    takes the nearest arcs first. A round that leaves rows over has filled a shard, so there
    are as many rounds as shards at most.
    """
    n, left, used = len(owner), list(room), [0] * len(room)
    cells: dict[int, list[list[int]]] = {}
    for cell in sorted(counts):
        cells.setdefault(cell // PARTS, []).append([cell, 0, counts[cell]])
    at = {arc: arc for arc in cells}
    out = []
    while cells:
        asks: dict[int, list[tuple[int, int]]] = {}
        for arc in cells:
            while not left[owner[at[arc] % n]]:
                at[arc] += 1
            asks.setdefault(int(owner[at[arc] % n]), []).append((at[arc] - arc, arc))
        for shard, arcs in asks.items():
            for _, arc in sorted(arcs):
                rest = cells[arc]
                while rest and left[shard]:
                    cell, first, end = rest[0]
                    take = min(end - first, left[shard])
                    out.append((cell, first, first + take, shard, used[shard]))
                    left[shard] -= take
                    used[shard] += take
                    rest[0][1] += take
                    if rest[0][1] == end:
                        rest.pop(0)
                if not rest:
                    del cells[arc]
    return out


def shard_rows(
    docs: DataFrame, shards: int, nodes: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each row of ``docs``.

    size is the text's UTF-8 bytes plus 8. Without ``slack`` the shards' row counts are at most
    one apart; with it a shard may hold up to (1 + slack) times the even count, and fewer rows
    move when the number of shards changes. Slots run from 0 in each shard, without gaps.

    Defined cases: a null text has no bytes and checksum 0; null ids hash as one key; rows with
    equal id and text may swap slots, which changes no result; an empty table gives an empty
    table; other columns are left unread.
    """
    positions, owner = ring(shards, nodes)

    @F.pandas_udf("int")
    def arc_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.searchsorted(positions, part.to_numpy()) % len(positions)).astype("int32")

    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(F.col(id_col).cast("long")).alias("key"),
        F.xxhash64(data).alias("salt"),
    )
    keyed = written(
        read.select("*", (arc_of("key") * PARTS + F.pmod("salt", F.lit(PARTS))).cast("int").alias("cell")), "keyed"
    )
    counts = {r["cell"]: r["count"] for r in keyed.groupBy("cell").count().collect()}  # shards * nodes * PARTS rows at most
    moves = flow(counts, owner, capacities(sum(counts.values()), shards, slack))
    # at most shards * nodes * PARTS cells, and a cut for each shard that fills
    table = docs.sparkSession.createDataFrame(
        moves, "cell int, first long, end long, shard int, slot0 long"
    )
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "salt", "doc_id", "size")) - 1
    return (
        keyed.select("*", rank.alias("rank"))
        .join(F.broadcast(table), "cell")
        .where("rank >= first AND rank < end")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Writes ``docs`` to ``path``, a folder for each shard; rows with one id and text stay together."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    places = shard_rows(docs, shards, **options).groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("__p"))
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    named = places.select(F.col("doc_id").alias("__i"), F.col("text_crc32").alias("__c"), "__p")
    out = docs.join(named, F.col(id_col).cast("long").eqNullSafe(F.col("__i")) & (crc == F.col("__c")))
    out = out.select(*[docs[c] for c in docs.columns], F.col("__p.shard").alias("shard"), F.col("__p.slot").alias("slot"))
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
