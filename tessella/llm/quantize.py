"""Product codes of vectors: k-means in whole numbers for each part, with bounds that save scans.

Every part of a vector keeps its entry, an upper bound of its distance to it and one lower bound
of its distance to any other entry. When entries move, the bounds move with them. A part is held
against all entries only if its upper bound, once exact again, isn't strictly below the lower
bound or below half the way to the nearest other entry; so ties always reach the full scan, which
takes the lower index. State is written with the vectors each round; tasks send back sums for each
entry, and codebooks of bounded size go out with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kdtree import _floor, _matrix
from .tables import written

#: Relative slack of bounds, above what a double's root and a sum of them can be off.
SLACK = 1e-12
#: Rows of a batch that are held against all entries at once.
ROWS = 4096


def fits_doubles(largest: float, width: int) -> bool:
    """Whether squared distances of components up to ``largest`` are whole in doubles."""
    return 4.0 * largest * largest * max(1, width) < 2.0**53


def _whole(x: np.ndarray, exact: bool) -> np.ndarray:
    """Doubles that hold whole numbers, as they are or as Python's integers of any size."""
    return x if exact else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _own(points: np.ndarray, book: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of points to their entries."""
    return ((points - book[at]) ** 2).sum(axis=1)


def scan(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point its nearest entry (the lower index of equals), and the two least squared distances."""
    if book.dtype == object:
        all_ = ((points[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    else:
        all_ = (points**2).sum(axis=1)[:, None] - 2 * (points @ book.T) + (book**2).sum(axis=1)[None, :]
    best = np.argmin(all_, axis=1)
    rows = np.arange(len(points))
    least = all_[rows, best]
    if len(book) == 1:
        return best, least, np.full(len(points), np.inf)
    all_[rows, best] = all_.max(initial=0) + 1
    return best, least, all_.min(axis=1)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def assign(points: np.ndarray, book: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, moved: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, squared distance, scans) of each point.

    ``moved`` is how far each entry moved since ``state``, ``gaps`` half of each one's distance
    to the nearest other entry, both of them on the safe side.
    """
    n = len(points)
    if state is None:
        entry, upper, lower, todo = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
        own = _own(points, book, entry)
    else:
        entry, upper, lower = (x.copy() for x in state)
        far = int(np.argmax(moved))
        second = np.delete(moved, far).max(initial=0.0)
        lower = (lower - np.where(entry == far, second, moved[far])) * (1 - SLACK)
        upper = (upper + moved[entry]) * (1 + SLACK)
        own = _own(points, book, entry)
        safe = np.maximum(lower, gaps[entry])
        loose = np.flatnonzero(~(upper < safe))
        upper[loose] = _root(own[loose]) * (1 + SLACK)  # tightened before anything is scanned
        todo = loose[~(upper[loose] < safe[loose])]
    rows = ROWS if book.dtype != object else 64
    for first in range(0, len(todo), rows):
        at = todo[first : first + rows]
        entry[at], least, second = scan(points[at], book)
        own[at] = least
        upper[at], lower[at] = _root(least) * (1 + SLACK), _root(second) * (1 - SLACK)
    return entry, upper, lower, own, len(todo)


def spread(book: np.ndarray) -> np.ndarray:
    """Half of each entry's distance to the nearest other entry, on the safe side; equal entries have 0."""
    if len(book) == 1:
        return np.array([np.inf])
    return np.array([_root(np.delete(((book - book[i]) ** 2).sum(axis=1), i)).min() for i in range(len(book))]) / 2 * (1 - SLACK)


def _round(books: list[np.ndarray], before: list[np.ndarray] | None):
    """Rows with (a, u, l, e) brought up to ``books``, of rows that hold those of ``before``."""
    gaps = [spread(b) for b in books]
    moved = [np.zeros(len(b)) if before is None else _root(((b - c) ** 2).sum(axis=1)) * (1 + SLACK) for b, c in zip(books, before or books)]
    exact = books[0].dtype != object
    names = ["a", "u", "l", "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            parts = _matrix(batch.column("v")).reshape(n, len(books), -1)
            found = []
            for p, book in enumerate(books):
                state = None if before is None else tuple(_matrix(batch.column(c))[:, p] for c in names[:3])
                found.append(assign(_whole(parts[:, p, :], exact), book, state, moved[p], gaps[p]))
            error = np.array([sum(int(f[3][i]) for f in found) for i in range(n)] if not exact else np.sum([f[3] for f in found], axis=0), object if not exact else np.int64)
            listed = lambda k, t: pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack([f[k] for f in found]).ravel(), t), len(books)).cast(pa.list_(t))
            new = [listed(0, pa.int32()), listed(1, pa.float64()), listed(2, pa.float64()), pa.array(np.minimum(error, (1 << 63) - 1).astype(np.int64))]
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], [*kept, *names])

    return run


def _sums(width: int, exact: bool):
    """Rows (part, entry, n, totals): the sums of the parts of each entry, for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            v, a = _matrix(batch.column("v")), _matrix(batch.column("a"))
            for p in range(a.shape[1]):
                own = v[:, p * width : (p + 1) * width]
                order = np.argsort(a[:, p], kind="stable")
                entries, first = np.unique(a[order, p], return_index=True)
                sums = np.add.reduceat(_whole(own[order], exact), first, axis=0) if len(first) else []
                for entry, n, add in zip(entries.tolist(), np.diff([*first, len(order)]).tolist(), sums):
                    old = total.setdefault((p, entry), [0, [0] * width])
                    old[0] += n
                    old[1] = [x + int(y) for x, y in zip(old[1], add)]
        rows = [(p, k, n, [str(x) for x in t]) for (p, k), (n, t) in total.items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.string()))], ["part", "entry", "n", "totals"])

    return run


def _moved_books(books: list[np.ndarray], state: DataFrame) -> list[np.ndarray]:
    """Each entry at the floor of its parts' mean; entries without parts stay."""
    width, exact = books[0].shape[1], books[0].dtype != object
    sums = state.select("v", "a").mapInArrow(_sums(width, exact), "part int, entry int, n long, totals array<string>")
    if exact:
        each = sums.select("part", "entry", "n", F.posexplode("totals").alias("i", "x"))
        each = each.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    else:
        each = sums.groupBy("part", "entry").applyInArrow(_add, "part int, entry int, i int, n long, x string")
    books = [b.copy() for b in books]
    for r in each.collect():  # parts x entries x width of them
        books[r["part"]][r["entry"], r["i"]] = int(r["x"]) // r["n"]
    return books


def _add(table: pa.Table) -> pa.Table:
    """The sums of one entry over all tasks, for numbers of any size: a row for each task comes in."""
    n = sum(table.column("n").to_pylist())
    totals = [sum(map(int, xs)) for xs in zip(*table.column("totals").to_pylist())]
    k = len(totals)
    same = lambda c: pa.array([table.column(c)[0].as_py()] * k, pa.int32())
    return pa.table({"part": same("part"), "entry": same("entry"), "i": pa.array(range(k), pa.int32()), "n": pa.array([n] * k, pa.int64()), "x": pa.array([str(x) for x in totals])})


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256, as hex, of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame | None, list[np.ndarray]]:
    """Rows with (v, a, u, l, e) of final codes, and the codebooks; ``vectors`` has rows (vec_id, v).

    The codebooks start as the parts of the vectors of smallest id (of an id's rows, those that
    order first), ``entries`` at most.
    """
    first = vectors.orderBy("vec_id", "v").limit(entries).select("v").collect()
    if not first:
        return None, []
    start = np.array([r["v"] for r in first], np.float64)
    width = start.shape[1] // parts
    largest = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    exact = fits_doubles(largest, width)
    books = [_whole(start[:, p * width : (p + 1) * width], exact) for p in range(parts)]
    added = ", ".join(["a array<int>", "u array<double>", "l array<double>", "e long"])
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    state, before = vectors, None
    for _ in range(rounds):
        state = written(state.mapInArrow(_round(books, before), f"{plain}, {added}"), "codes")
        before, books = books, _moved_books(books, state)
    return state.mapInArrow(_round(books, before), f"{plain}, {added}"), books


def product_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, label, codes array<int>, error, label_error, codebooks_sha256).

    Components become floor(scale * x). error is the sum of the squared distances of a vector's
    parts to their entries, label_error the sum of that over rows of equal label, where nulls
    are equal.

    Defined cases: vectors that are null, hold a null or non-finite component or one that
    scaling makes infinite take no part, nor do vectors whose length isn't a positive multiple
    of ``parts`` or isn't that of the kept row of smallest id, nor rows without an id; rows that
    share an id stay rows of their own; with fewer rows than ``entries`` the codebooks have one
    entry a row; equal entries are told apart by index, so the higher ones stay unused; sums and
    distances are exact whole numbers of any size, and errors beyond 64 bits count as the
    largest such number; an empty table gives an empty table.
    """
    whole = F.col(vector_col).isNotNull() & ~F.exists(
        F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))
    )
    usable = vectors.where(whole & F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: _floor(x, scale)).alias("v")
    )
    usable = written(usable, "vectors")
    head = usable.orderBy("vec_id", "v").select(F.size("v").alias("d")).first()
    state, books = train(usable.where(F.size("v") == head["d"]), parts, entries, rounds) if head else (None, [])
    if state is None:
        coded = usable.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
    else:
        coded = written(state.select("vec_id", "label", F.col("a").alias("codes"), F.col("e").alias("error")), "coded")
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))  # few sums are broadcast; many are joined with skew split
    return out.select("vec_id", "label", "codes", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def approximated(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Rows (vec_id, approximation): for each row of (vec_id, codes) the entries that it names, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _matrix(batch.column("codes"))
            near = np.concatenate([b[a[:, p]].astype(np.float64) for p, b in enumerate(books)], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "approximation"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id long, approximation array<double>")
