"""Exact top-k inner products by a KD-tree for each shard of the vectors.

Vectors are dealt to shards by the upper levels of a KD-tree, whose medians come from the rows
of smallest hash. A shard's own tree splits on at medians down to small leaves and keeps each
node's tight bounding box. The largest inner product of a query with a box bounds all that the
box holds, so nodes are opened best first, and a query ends in a shard when the next bound falls
below its kth score. Queries visit their own shard first; the kth score found there goes with
them to those other shards whose whole box may reach it. The queries of a shard come in groups
of bounded size, each with the shard's vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

LEAF = 128
#: Vectors of a shard, about, and the most shards; beyond that shards grow.
SHARD = 16384
SHARDS = 16384
#: Queries of a group, about.
QUERIES = 4096
#: Vectors whose medians deal all others: for each shard, and together.
SAMPLE, SAMPLES = 32, 65536
#: Bytes of the shards' boxes that queries are held against; without them every shard is visited.
BOXES = 64 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Tree:
    ids: np.ndarray
    points: np.ndarray
    low: np.ndarray  # a row for each node
    high: np.ndarray
    child: list[tuple[int, int]]  # (-1, -1) for a leaf
    span: list[tuple[int, int]]


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Nodes split at the median of their widest side; equal points stay in one leaf."""
    order = np.lexsort((ids,))
    low, high, child, span = [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = points[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        node = len(span)
        span.append((a, b))
        child.append((-1, -1))
        if parent >= 0:
            child[parent] = (node, child[parent][1]) if side == 0 else (child[parent][0], node)
        wide = high[-1] - low[-1]
        if b - a > leaf and wide.size and wide.max() > 0:
            values = own[:, wide.argmax()]
            middle = (b - a) // 2
            part = np.argpartition(values, middle, kind="introselect")
            if values[part[0:middle]].max() == values.max():  # as many equal values as half of them
                part = np.argsort(values, kind="stable")
                middle = int(np.searchsorted(values[part], values.max()))
            order[a:b] = order[a:b][part]
            todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
    return Tree(ids[order], points[order], np.array(low), np.array(high), child, span)


def _exact(points: np.ndarray, query: np.ndarray, large: bool) -> np.ndarray:
    if not large:
        return (points @ query).astype(np.int64)
    whole = [int(x) for x in query]
    return np.array([min(_MOST, max(_LEAST, sum(int(a) * b for a, b in zip(p, whole)))) for p in points], object)


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, bool]:
    """Bounds of each query's scores in each box, and whether scores may pass what a double holds exactly."""
    with np.errstate(all="ignore"):
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        top = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * np.abs(queries).max(initial=0) * max(1, queries.shape[1])
        large = not top < 2**53
        if large:
            bounds = np.nan_to_num(bounds + np.abs(bounds) * 1e-9 + 1, nan=np.inf, posinf=np.inf, neginf=-np.inf)
    return np.maximum(bounds, float(_LEAST)), large


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, floors: list, k: int) -> list[list[tuple[int, int]]]:
    """For each query its best (score, -id) in the tree, best first, of those that reach its floor."""
    bounds, large = upper_bounds(queries, tree.low, tree.high)
    found = []
    for q, bound, me, floor in zip(queries, bounds.tolist(), own.tolist(), floors):
        best: list[tuple[int, int]] = []
        open_ = [(-bound[0], 0)] if bound else []
        while open_ and -open_[0][0] >= floor:
            node = heapq.heappop(open_)[1]
            left, right = tree.child[node]
            if left >= 0:
                for x in (left, right):
                    if bound[x] >= floor:
                        heapq.heappush(open_, (-bound[x], x))
                continue
            a, b = tree.span[node]
            score, ids = _exact(tree.points[a:b], q, large), tree.ids[a:b]
            near = np.flatnonzero((score >= floor) & (ids != me))
            if len(near) > 4 * k:
                cut = np.sort(score[near])[-k]
                near = near[score[near] >= cut]
                near = near[np.lexsort((ids[near], -score[near]))][:k]
            for s, i in zip(score[near].tolist(), ids[near].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                floor = max(floor, best[0][0])
        found.append(sorted(best, reverse=True))
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy()
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def coarse_splits(points: list[np.ndarray], shards: int) -> list[tuple[int, float, int, int]]:
    """The upper tree as (side, value, left, right); a child below 0 is the shard -1 - child."""
    nodes: list[tuple[int, float, int, int]] = []
    made = 0

    def grow(some: list[np.ndarray], want: int) -> int:
        nonlocal made
        width = min((len(x) for x in some), default=0)
        block = np.array([x[:width] for x in some]) if width else np.zeros((len(some), 0))
        with np.errstate(all="ignore"):
            wide = np.ptp(block, axis=0) if len(block) and width else np.zeros(0)
        side = int(np.argmax(wide)) if len(wide) else -1
        if want > 1 and side >= 0 and wide[side] > 0:
            values = np.sort(block[:, side])
            value = float(values[len(values) * (want // 2) // want])
            value = value if value > values[0] else float(values[np.searchsorted(values, value, "right")])
            low = block[:, side] < value
            here = len(nodes)
            nodes.append((side, value, 0, 0))
            left = grow([x for x, y in zip(some, low) if y], want // 2)
            right = grow([x for x, y in zip(some, low) if not y], want - want // 2)
            nodes[here] = (side, value, left, right)
            return here
        made += 1
        return -made

    grow(points, shards)
    return nodes


def _deal(splits: list[tuple[int, float, int, int]]):
    """Adds to each row of (..., v) the shard that the splits lead to."""
    side, value, left, right = (np.array(x) for x in zip(*splits)) if splits else [np.zeros(0, int)] * 4

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths())]).astype(np.int64)
            begin, size = ends[:-1], np.diff(ends)
            node = np.zeros(batch.num_rows, np.int64) if len(side) else np.full(batch.num_rows, -1)
            while (on := np.flatnonzero(node >= 0)).size:
                at = node[on]
                has = side[at] < size[on]  # a vector that is too short goes left
                x = flat[np.where(has, begin[on] + side[at], 0)] if len(flat) else np.zeros(len(on))
                node[on] = np.where(has & (x >= value[at]), right[at], left[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(-1 - node, pa.int32())], [*batch.schema.names, "shard"])

    return deal


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy()
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _reach(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Rows (query_id, qkey, shard): the other shards whose boxes may hold a score of the floor."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, own = batch.column("d").to_numpy(), batch.column("shard").to_numpy()
            floors = np.array([-np.inf if x is None else x for x in batch.column("kth").to_pylist()], object)
            who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for width in np.unique(d[d > 0]).tolist():  # vectors without components are in one shard
                shards, low, high = boxes[width]
                same = np.flatnonzero(d == width)
                for first in range(0, len(same), 256):
                    at = same[first : first + 256]
                    bounds, _ = upper_bounds(_matrix(batch.column("v").take(pa.array(at))), low, high)
                    i, j = np.nonzero((bounds >= floors[at][:, None]) & (shards[None, :] != own[at][:, None]))
                    who.append(at[i])
                    where.append(shards[j])
            at = pa.array(np.concatenate(who))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("qkey").take(at), pa.array(np.concatenate(where), pa.int32())], ["query_id", "qkey", "shard"])

    return reach


def _visit(k: int):
    def visit(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            tree = build(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v")))
            ids, keys = queries.column("query_id").to_numpy(), queries.column("qkey").to_numpy()
            floors = [-np.inf if x is None else x for x in queries.column("floor").to_pylist()]
            points = _matrix(queries.column("qv"))
            for first in range(0, len(ids), 256):
                at = slice(first, first + 256)
                for i, key, best in zip(ids[at], keys[at], search(tree, points[at], ids[at], floors[at], k)):
                    out += [(i, key, -j, s) for s, j in best]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "qkey", "vec_id", "score"), columns)})

    return visit


def top_inner_products(
    vectors: DataFrame, is_query: str, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best integer inner products.

    Components become floor(scale * x). Rows for which ``is_query`` (SQL over ``vec_id``) holds
    are queries; all rows are candidates but those with the query's own id. Ties go to the
    smaller id.

    Defined cases: vectors that are null, hold a null or non-finite component, or one that scaling
    makes infinite, and rows without an id take no part; vectors of another length than a query's
    are no candidates for it; rows that share an id and a vector are one query but several
    candidates; sums that might pass 2**53 are taken in whole numbers, and scores beyond 64 bits
    count as the largest or smallest 64-bit number; an empty table gives an empty table.
    """
    raw = F.transform(F.col(vector_col), lambda x: _floor(x, scale))
    whole = F.col(vector_col).isNotNull() & ~F.exists(
        F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))
    )
    usable = written(
        vectors.where(whole & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("v"))
        .select("*", F.size("v").alias("d"), F.xxhash64("vec_id", "v").alias("qkey")),
        "usable",
    )
    shards = max(1, min(SHARDS, -(-usable.count() // SHARD)))
    sample = []
    if shards > 1:
        some = usable.select("v", F.xxhash64("qkey").alias("o")).orderBy("o").limit(min(SAMPLES, SAMPLE * shards)).collect()
        sample = [np.array(r["v"]) for r in some]
    dealt = usable.mapInArrow(_deal(coarse_splits(sample, shards)), "vec_id long, v array<double>, d int, qkey long, shard int")
    usable = written(dealt, "vectors")
    queries = usable.where(is_query).dropDuplicates(["vec_id", "qkey"]).select(F.col("vec_id").alias("query_id"), "qkey", "v", "d", "shard")
    schema = "query_id long, qkey long, vec_id long, score long"

    def wave(asked: DataFrame) -> DataFrame:
        """Queries with a floor and a shard meet the shard's vectors, a group of queries at a time."""
        sizes = written(asked.groupBy("d", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks")), "sizes")
        block = F.pmod(F.xxhash64("query_id", "qkey"), F.col("blocks")).cast("int")
        named = asked.join(sizes, ["d", "shard"]).select("query_id", "qkey", F.col("v").alias("qv"), F.col("d").alias("qd"), F.col("shard").alias("qshard"), "floor", block.alias("qblock"))
        each = usable.join(sizes, ["d", "shard"]).select("d", "shard", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return each.groupBy("d", "shard", "block").cogroup(named.groupBy("qd", "qshard", "qblock")).applyInArrow(_visit(k), schema)

    home = written(wave(queries.select("*", F.lit(None).cast("long").alias("floor"))), "home")
    kth = home.groupBy("query_id", "qkey").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    asking = queries.join(kth, ["query_id", "qkey"], "left")
    extent = usable.select("d", "shard", F.posexplode("v").alias("i", "x")).groupBy("d", "shard", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    extent = written(extent, "boxes")
    places = extent.select("d", "shard").distinct()
    if extent.count() * 24 <= BOXES:
        reached = asking.select("query_id", "qkey", "v", "d", "shard", "kth").mapInArrow(_reach(_boxes(extent)), "query_id long, qkey long, shard int")
    else:
        reached = asking.join(places.select("d", F.col("shard").alias("other")), "d").where("shard <> other").select("query_id", "qkey", F.col("other").alias("shard"))
    away = written(reached, "away").join(asking.select("query_id", "qkey", "v", "d", F.col("kth").alias("floor")), ["query_id", "qkey"])
    found = home.unionByName(wave(away))
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(f"rank <= {k}")


def _boxes(extent: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{d: (shards, low, high)} of the shards' boxes, whose size the caller has checked."""
    rows = extent.orderBy("d", "shard", "i").toPandas()
    out = {}
    for d, own in rows.groupby("d"):
        out[int(d)] = (own["shard"].to_numpy()[::d], own["low"].to_numpy().reshape(-1, d), own["high"].to_numpy().reshape(-1, d))
    return out


def _floor(x, scale: float):
    """floor(scale * x) as a double, which no long has to hold on the way."""
    y = x.cast("double") * scale
    down = F.rint(y)
    return down - F.when(down > y, 1.0).otherwise(0.0)
