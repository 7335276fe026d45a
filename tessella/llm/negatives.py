"""Hard negatives by norm-bucketed search.

Rows are range-sorted by norm into buckets, the largest norms first. The inner product of an
anchor with a row is at most the product of their norms, so a bucket can only hold something for
a window of scores [low, high] if the anchor's norm times the bucket's largest reaches ``low``
and the kth score found so far. Buckets are visited in waves that grow fourfold; between waves
each window's kth score rises, and inside a bucket it rises from block to block. Positives come
from the same search, with windows without ends over rows of the anchor's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kdtree import _exact, _floor, _matrix
from .tables import written

#: Rows of a bucket, about, anchors of a group, about, and rows of a block within a bucket.
BUCKET, ANCHORS, BLOCK = 4096, 4096, 2048
#: Norms that are sent to the tasks, at most; with more buckets each holds for a run of them.
NORMS = 65536
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "anchor_id long, akey long, w int, vec_id long, score long"


def _tops(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k first rows, higher scores before lower, ties by id."""
    if len(scores) > 4 * k:
        cut = np.sort(scores)[-k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], ~scores[near]))][:k]
    return np.lexsort((ids, ~scores))[:k]  # ~ turns the order round without an overflow


class _Best:
    """The k first (score, id) of a window so far."""

    def __init__(self, low: int, high: int, floor: int | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.floor = low if floor is None else max(low, floor)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero((scores >= self.floor) & (scores <= self.high))
        if not len(near):
            return
        scores, ids = np.concatenate([self.scores, scores[near]]), np.concatenate([self.ids, ids[near]])
        top = _tops(scores, ids, self.k)
        self.scores, self.ids = scores[top], ids[top]
        if len(top) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def search(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, norms: np.ndarray, anchors: list[tuple], same: bool, k: int, large: bool, block: int | None = None) -> list[tuple]:
    """(anchor, window, id, score) of a bucket, at most k a window.

    ``anchors`` has (id, label, vector, norm, windows), windows (low, high, kth or None). Rows
    of the anchor's label are searched if ``same``, without those of its id; else the others.
    """
    order = np.argsort(-norms, kind="stable")
    ids, labels, points, norms = ids[order], labels[order], points[order], norms[order]
    state = [[_Best(*w, k) for w in a[4]] for a in anchors]
    block = block or BLOCK
    for first in range(0, len(ids), block):
        at = slice(first, first + block)
        own = labels[at]
        live = [i for i, a in enumerate(anchors) if _bound(a[3], norms[first]) >= min(b.floor for b in state[i])]
        groups = [(np.flatnonzero(own == y), [i for i in live if anchors[i][1] == y]) for y in sorted({anchors[i][1] for i in live})] if same else [(np.arange(len(own)), live)]
        for rows, some in groups:
            if not len(rows) or not some:
                continue
            block_points, block_ids, block_labels = points[at][rows], ids[at][rows], own[rows]
            if not large:
                scores = (np.array([anchors[i][2] for i in some]) @ block_points.T).astype(np.int64)
            for n, i in enumerate(some):
                s = _exact(block_points, anchors[i][2], True).astype(np.int64) if large else scores[n]
                low = min(b.floor for b in state[i])
                near = np.flatnonzero((s >= low) & ((block_ids != anchors[i][0]) if same else (block_labels != anchors[i][1])))
                for b in state[i]:
                    b.take(s[near], block_ids[near])
    return [(i, w, int(j), int(s)) for i, found in enumerate(state) for w, b in enumerate(found) for s, j in zip(b.scores, b.ids)]


def _bound(a: float, b: float) -> float:
    """No inner product of vectors with these norms, themselves bounds, is larger; beyond 64 bits it is the end."""
    product = a * b
    return product + 1 if product < _MOST else float(_MOST)


def _visit(same: bool, k: int):
    def visit(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            points = _matrix(rows.column("v"))
            vectors = _matrix(asked.column("v"))
            top = np.abs(points).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, points.shape[1])
            windows = asked.column("windows").to_pylist()
            names = [asked.column(c).to_numpy() for c in ("anchor_id", "akey", "label", "norm")]
            anchors = [(i, y, v, n, [(w["low"], w["high"], w["kth"]) for w in ws]) for i, y, v, n, ws in zip(names[0], names[2], vectors, names[3], windows)]
            found = search(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), points, rows.column("norm").to_numpy(), anchors, same, k, not top < 2**53)
            out = [(names[0][i], names[1][i], windows[i][w]["w"], j, s) for i, w, j, s in found]
        columns = list(zip(*out)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor_id", "akey", "w", "vec_id", "score"), columns, types)})

    return visit


def _norm():
    """An upper bound of a vector's length; sums past a double are infinite."""
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) * (1 + 1e-9)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "akey", "w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _reach(norms: np.ndarray, run: int, count: int):
    """Rows with the last bucket that each window may find something in, -1 for none.

    ``norms`` has the largest norm of each run of ``run`` buckets, falling; so a window reaches
    the first runs, up to where the product of norms falls below its limit or its kth score.
    """
    rising = np.maximum.accumulate(norms[::-1])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, norm, width = batch.column("windows"), batch.column("norm").to_numpy(), batch.column("d").to_numpy()
            flat = windows.flatten()
            own = np.repeat(np.arange(batch.num_rows), windows.value_lengths().to_numpy())
            low = flat.field("low").to_numpy(zero_copy_only=False)
            floor = np.maximum(low, pc.coalesce(flat.field("kth"), flat.field("low")).to_numpy(zero_copy_only=False)).astype(np.float64)
            with np.errstate(all="ignore"):
                need = (floor - 2) / (norm[own] * (1 + 2e-9 + width[own] * 1e-15))
            need = np.where((floor <= 0) | ~np.isfinite(need), -np.inf, need)
            need = np.where(floor >= _MOST * (1 - 1e-9), np.minimum(need, 1.0), need)
            runs = len(rising) - np.searchsorted(rising, need, "left")
            last = pa.array(np.minimum(runs * run, count) - 1, pa.int32())
            fields = [flat.field(n) for n in ("w", "low", "high", "kth")]
            new = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows.value_lengths().to_numpy())]), pa.int32()), pa.StructArray.from_arrays([*fields, last], ["w", "low", "high", "kth", "last"]))
            kept = [n for n in batch.schema.names if n != "windows"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], new], [*kept, "windows"])

    return reach


def _searched(rows: DataFrame, norms: np.ndarray, run: int, count: int, anchors: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
    """The k best rows of each window of each anchor; ``anchors`` has (anchor_id, akey, label, v, d, norm, windows).

    A window goes to those buckets of a wave that may still hold something for it, and a
    bucket's rows come once for each group of anchors.
    """
    best = None
    first, size = 0, 4
    schema = "anchor_id long, akey long, label long, v array<double>, d int, norm double, windows array<struct<w: int, low: long, high: long, kth: long, last: int>>"
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    while first < count:
        asked = anchors
        if best is not None:
            kth = best.groupBy("anchor_id", "akey", "w").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            kths = kth.groupBy("anchor_id", "akey").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kths"))  # a few windows each
            new = lambda w: F.struct(w["w"].alias("w"), w["low"].alias("low"), w["high"].alias("high"), F.try_element_at("kths", w["w"]).alias("kth"))
            asked = anchors.join(kths, ["anchor_id", "akey"], "left").withColumn("windows", F.transform("windows", new))
        asked = asked.select("anchor_id", "akey", "label", "v", "d", "norm", "windows").mapInArrow(_reach(norms, run, count), schema)
        end = min(first + size, count) - 1
        until = F.least(F.array_max(F.transform("windows", lambda w: w["last"])), F.lit(end))
        pairs = asked.where(until >= first).withColumn("bucket", F.explode(F.sequence(F.lit(first), until)))
        pairs = pairs.withColumn("windows", F.filter("windows", lambda w: w["last"] >= F.col("bucket")))
        pairs = pairs.withColumn("group", F.pmod(F.xxhash64("anchor_id", "akey"), F.lit(groups)).cast("int"))
        some = rows.where(F.col("bucket").between(first, end)).select("*", spread)
        found = some.groupBy("d", "bucket", "group").cogroup(pairs.groupBy("d", "bucket", "group")).applyInArrow(_visit(same, k), _FOUND)
        best = written(_best(found if best is None else best.drop("rank").unionByName(found), k), "best")
        first, size = first + size, size * 4
    return best


def hard_negatives(
    vectors: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); scores are integer inner products. An anchor's positives
    are its best rows of the same label; for each of them come the best rows of another label
    with ``least`` * positive <= 100 * negative <= ``most`` * positive. Ties go to the smaller id.

    Defined cases: rows without an id or a label, and vectors that are null, hold a null or
    non-finite component, or one that scaling makes infinite, take no part; vectors of another
    length than the anchor's are no candidates for it; rows that share an id are candidates each,
    but not of their own id's anchors as positives, and anchors equal in id, label and vector are
    one; a positive score below 0 has no negatives, as its window is empty; equal norms are
    dealt by hash; scores beyond 64 bits count as the largest or smallest such number; an empty
    table gives an empty table.
    """
    whole = F.col(vector_col).isNotNull() & ~F.exists(
        F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))
    )
    usable = vectors.where(whole & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vector_col), lambda x: _floor(x, scale)).alias("v")
    )
    usable = usable.select("*", F.size("v").alias("d"), _norm().alias("norm"), F.xxhash64("vec_id", "label", "v").alias("akey"))
    usable = written(usable, "vectors")
    parts = -(-usable.count() // BUCKET)
    if not parts:
        return usable.selectExpr("vec_id AS anchor_id", "vec_id AS positive_id", "d AS rank", "vec_id AS negative_id", "vec_id AS positive_score", "vec_id AS negative_score")
    dealt = usable.repartitionByRange(parts, F.desc("norm"), "akey").withColumn("bucket", F.spark_partition_id())
    rows = written(dealt, "buckets")
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "akey", "label", "v", "d", "norm").dropDuplicates(["anchor_id", "akey"])
    groups = max(1, -(-anchors.count() // ANCHORS))
    count = rows.agg(F.max("bucket")).first()[0] + 1
    run = -(-count // NORMS)
    largest = rows.groupBy(F.floor(F.col("bucket") / run).alias("run")).agg(F.max("norm").alias("norm")).collect()
    norms = np.zeros(-(-count // run))
    norms[[r["run"] for r in largest]] = [r["norm"] for r in largest]
    search_ = lambda asked, same, k: _searched(rows, norms, run, count, asked, groups, same, k)
    window = lambda w, low, high: F.struct(w.cast("int").alias("w"), low.cast("long").alias("low"), high.cast("long").alias("high"), F.lit(None).cast("long").alias("kth"))
    asked = anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST))))
    near = search_(asked, True, positives)
    near = near.select("anchor_id", "akey", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 30 p <= 100 n <= 90 p, in whole numbers of up to 38 digits
    scaled = lambda share: F.col("positive_score").cast("decimal(38,0)") * share
    low = F.ceil(scaled(least) / 100).cast("long")
    high = F.floor(scaled(most) / 100).cast("long")
    windows = near.where("positive_score >= 0").groupBy("anchor_id", "akey").agg(F.collect_list(window(F.col("w"), low, high)).alias("windows"))
    found = search_(anchors.join(windows, ["anchor_id", "akey"]), False, negatives)
    return found.join(near, ["anchor_id", "akey", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
