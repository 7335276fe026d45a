"""Near-duplicate documents from bottom-k sketches of one hash function.

1.  A document's set is its distinct word shingles, each hashed once to 64 bits; the ``k``
    smallest hashes are its sketch. Documents with the same set form a class, so that copies
    cost one row. Up to step 4 only sketches move.
2.  Inverted lists of retained values give the overlaps. A list belongs to a run of ``run``
    values that are neighbours in a sketch: two sets with similarity J share a value with
    probability J at each rank of their union's sketch, so nearly every pair at the threshold
    shares such a run, while sets that only share a passage hardly ever do. Small sets are
    also listed under each single value.
3.  Each list has a leader, the member that is in most lists: a text that many others were made
    from. The members of all lists of a leader are one group, so that two that share a list are
    in a group together. They are first compared with the leader, which puts near copies of one
    text into one component at a cost that grows with the group. Then only members of different
    components are left to meet, block by block.
4.  Wherever two meet, their similarity is first estimated from the union's sketch; pairs far
    below the threshold go. The texts of those that are left are fetched and their full sets
    compared, which alone makes a link.
5.  Links leave a group as a star for each of its components; connected components join them.

No link that could join two components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import labels, settled
from .tables import text_slices, written
from .words import as_large, mix64, split_words, window_hashes, word_hashes

#: Members of a group that one block holds, and their shingles, about.
BLOCK = 512
BLOCK_SHINGLES = 4 << 20
#: Number of the first block of members outside the component of their group's leader.
REST = 1 << 24


def miss_probability(k: int, run: int, threshold: float) -> float:
    """The chance that k ranks, each shared with probability ``threshold``, hold no such run."""
    state = np.zeros(run)
    state[0] = 1.0
    for _ in range(k):
        state = np.concatenate([[state.sum() * (1 - threshold)], state[:-1] * threshold])
    return float(state.sum())


def choose_run(k: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """The longest run that misses fewer than ``miss`` of the pairs at the threshold, and the
    size of union up to which a run isn't certain even in fully retained sets."""
    run = 1
    while threshold > run * (1 - threshold) and miss_probability(k, run + 1, threshold) <= miss:
        run += 1
    return run, int((run - 1) / (threshold - (run - 1) * (1 - threshold))) + 1


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased.

    A text with fewer words than a shingle has one, of all its words; one without words, none.
    """
    batch = split_words(pc.ascii_lower(as_large(texts)))
    hashes = word_hashes(batch)
    grams = window_hashes(hashes, shingle)
    out = []
    for a, b in zip(batch.starts[:-1], batch.starts[1:]):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        elif b > a:
            out.append(mix64(window_hashes(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def run_keys(sketch: np.ndarray, size: int, run: int, small: int) -> np.ndarray:
    """The keys of the inverted lists that a set of this size and sketch belongs to."""
    keys = mix64(window_hashes(sketch, run) + np.uint64(run)) if len(sketch) >= run else sketch[:0]
    return np.concatenate([keys, sketch]) if run > 1 and 0 < size <= small else keys


def _describe(shingle: int, k: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sets = shingle_sets(part.column("text"), shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("rk"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([x[:k].tobytes() for x in sets], pa.binary()),
                ],
                ["doc_id", "rk", "n_shingles", "set_id", "sketch"],
            )

    return describe


def _sketches(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _entries(run: int, small: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(run_keys(x, n, run, small)) for x, n in zip(_sketches(batch.column("sketch")), batch.column("n").to_pylist())]
            cls, n = (np.repeat(batch.column(c).to_numpy(), [len(x) for x in keys]) for c in ("cls", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))], ["cls", "n", "key"])

    return entries


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each of ``left`` shares with each of ``right`` (indices into sets).

    Values that many members hold are columns of a matrix product; those that few hold are
    counted pair by pair, which stays small as few hold them.
    """
    n = len(sets)
    member = np.repeat(np.arange(n), [len(x) for x in sets])
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.int32)
    common = np.flatnonzero(times > max(8, n // 16))
    for first in range(0, len(common), 4096):
        column = np.full(len(values), -1)
        column[common[first : first + 4096]] = np.arange(len(common[first : first + 4096]))
        hit = column[code] >= 0
        dense = np.zeros((n, len(common[first : first + 4096])), np.float32)
        dense[member[hit], column[code[hit]]] = 1
        out += (dense @ dense.T).astype(np.int32)
    rare = (times[code] > 1) & (times[code] <= max(8, n // 16))
    order = np.argsort(code[rare], kind="stable")
    who, what = member[rare][order], code[rare][order]
    for step in range(1, int(times[what].max()) if len(what) else 0):
        same = np.flatnonzero(what[:-step] == what[step:])
        if not len(same):
            break
        flat = np.bincount(who[same] * n + who[same + step], minlength=n * n).reshape(n, n)
        out += flat + flat.T
    return out[np.ix_(left, right)]


def possible(sketches: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Which pairs of ``left`` and ``right`` may reach the threshold, by their union's sketch.

    The union's sketch reaches up to the smaller of the two greatest retained values.
    """
    small, large = np.minimum.outer(sizes[left], sizes[right]), np.maximum.outer(sizes[left], sizes[right])
    if len(left) * len(right) <= 4 * len(sketches):  # a leader and its members, or a few: pair by pair
        seen, overlap = np.zeros((2, len(left), len(right)), np.int64)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                seen[i, j], overlap[i, j] = _seen_and_shared(sketches[x], sketches[y])
        return _estimate(overlap, seen, small, large, numerator, denominator)
    overlap = shared_counts(sketches, left, right)
    top = np.array([x[-1] if len(x) else 0 for x in sketches], np.uint64)
    upto = np.stack([np.searchsorted(sketches[i], top, "right") for i in range(len(sketches))])
    seen = upto[np.ix_(left, right)] + upto.T[np.ix_(left, right)]
    return _estimate(overlap, seen, small, large, numerator, denominator)


def _seen_and_shared(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How many values of two sketches their union's sketch reaches up to, and how many of them both hold."""
    if not len(x) or not len(y):
        return 0, 0
    top = min(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")]
    return len(x) + len(y), len(np.intersect1d(x, y, assume_unique=True))


def _estimate(overlap, seen, small, large, numerator: int, denominator: int):
    union = np.maximum(seen - overlap, 1)
    threshold = numerator / denominator
    margin = 6 * np.sqrt(threshold * (1 - threshold) / union)
    return (overlap / union >= threshold - margin) & (denominator * small.astype(np.int64) >= numerator * large)


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, k: int, numerator: int, denominator: int):
    """Pairs (i of left, j of right) whose similarity is numerator / denominator or more."""
    sizes = np.array([len(x) for x in sets])
    i, j = np.nonzero(possible([x[:k] for x in sets], sizes, left, right, numerator, denominator))
    if not len(i):
        return i, j
    both = shared_counts(sets, left, right)[i, j].astype(np.int64)
    total = sizes[left][i] + sizes[right][j] - both
    sure = denominator * both >= numerator * total
    return left[i[sure]], right[j[sure]]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's group under the links i-j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Table]]:
    """(leader, a, b, rows) of each block; its rows come together, as they are sorted."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("leader", "a", "b")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            own = tuple(keys[:, s].tolist())
            if held and own != name:
                yield (*name, pa.Table.from_batches(held))
                held = []
            name = own
            held.append(batch.slice(s, e - s))
    if held:
        yield (*name, pa.Table.from_batches(held))


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, np.ndarray]:
    """(classes, sides, their rows, left, right), each class once, in order."""
    cls, at = np.unique(rows.column("cls").to_numpy(), return_index=True)
    sides = rows.column("side").to_numpy()[at]
    return cls, sides, at.tolist(), np.flatnonzero(sides != 2), np.flatnonzero(sides != 1)


def _near(numerator: int, denominator: int):
    """By sketches alone: the members of each block that have to be compared with others in it."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leader, a, b, rows in _groups(batches):
            cls, sides, at, left, right = _sides(rows)
            if not len(left) or not len(right):
                continue
            rows = rows.combine_chunks().take(pa.array(at))
            sketches, sizes, own = _sketches(rows.column("sketch")), rows.column("n").to_numpy(), rows.column("own").to_numpy()
            pairs = possible(sketches, sizes, left, right, numerator, denominator) & (own[left][:, None] != own[right][None, :])
            some = np.unique(np.concatenate([left[pairs.any(axis=1)], right[pairs.any(axis=0)]]))
            columns = [np.full(len(some), leader, np.int64), cls[some], np.full(len(some), a, np.int32), np.full(len(some), b, np.int32), sides[some].astype(np.int32), own[some]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["leader", "cls", "a", "b", "side", "own"])

    return near


def _compare(shingle: int, k: int, numerator: int, denominator: int):
    """On full sets: a star for each component of a block, between what its members are in."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, rows in _groups(batches):
            cls, _, at, left, right = _sides(rows)
            sets = shingle_sets(rows.column("text").combine_chunks().take(pa.array(at)), shingle)
            i, j = linked_pairs(sets, left, right, k, numerator, denominator) if len(left) and len(right) else (left[:0], right[:0])
            root = _roots(len(cls), i, j)
            moved = np.flatnonzero(root != np.arange(len(cls)))
            own = rows.column("own").to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(own[moved], pa.int64()), pa.array(own[root[moved]], pa.int64())], ["u", "v"])

    return compare


def _blocks(count, shingles):
    return F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("leader", "a", "b").sortWithinPartitions("leader", "a", "b")


def _across(tagged: DataFrame) -> DataFrame:
    """Rows (leader, cls, own, a, b, side) in which all meet that are in different components.

    Members in the component of their leader are in blocks 0, 1, ... and the others in blocks
    ``REST``, ``REST`` + 1, ...; every block of the others meets every block. Groups without
    others are settled.
    """
    rest = F.col("rest")
    sized = lambda where: F.coalesce(_blocks(F.count(F.when(where, 1)), F.sum(F.when(where, F.col("n")))), F.lit(0))
    open_ = tagged.groupBy("leader").agg(sized(~rest).alias("m"), sized(rest).alias("r")).where("r > 0")
    hashed = F.xxhash64("cls", F.lit(11))
    block = F.when(rest, REST + F.pmod(hashed, F.col("r"))).otherwise(F.pmod(hashed, F.col("m"))).cast("int")
    placed = tagged.join(open_, "leader").select("leader", "cls", "own", "m", "r", "rest", block.alias("block"))
    others = F.sequence(F.lit(REST), REST + F.col("r") - 1)
    all_ = F.when(F.col("m") > 0, F.concat(F.sequence(F.lit(0), F.greatest("m", F.lit(1)) - 1), others)).otherwise(others)
    return placed.select("leader", "cls", "own", "block", F.explode(F.when(rest, all_).otherwise(others)).alias("other")).select(
        "leader",
        "cls",
        "own",
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        F.expr("CASE WHEN block = other THEN 0 WHEN block < other THEN 1 ELSE 2 END").alias("side"),
    )


def _class_links(classes: DataFrame, rows: DataFrame, shingle: int, numerator: int, denominator: int, k: int) -> DataFrame:
    """Links (u, v) between classes (cls, n, sketch, doc_id, rk), whose texts are in ``rows``.

    A table is written only where several steps read what Python or a join of texts made: at
    many partitions each costs more than the rows in it.
    """
    run, small = choose_run(k, numerator / denominator)
    entries = classes.select("cls", "n", "sketch").mapInArrow(_entries(run, small), "cls long, n long, key long")
    lists = entries.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    members = written(entries.join(lists, "key").select(F.col("key").alias("list"), "cls", "n"), "members")
    # too many to broadcast where it matters, so that every size takes the same plan
    wanted = members.groupBy("cls").agg(F.count("*").alias("lists")).hint("merge")
    facts = written(classes.join(wanted, "cls").select("cls", "n", "sketch", "lists", "doc_id", "rk"), "facts")
    place = facts.select("cls", F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")).hint("merge")
    here = (F.col("rk") == F.col("__rk")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    texts = written(rows.join(place, here).select("cls", "text"), "texts")

    def compared(placed: DataFrame) -> DataFrame:
        meet = placed.join(facts.select("cls", "n", "sketch"), "cls").select("leader", "a", "b", "side", "cls", "own", "n", "sketch")
        open_ = _dealt(meet).mapInArrow(_near(numerator, denominator), "leader long, cls long, a int, b int, side int, own long")
        whole = _dealt(open_.join(texts, "cls").select("leader", "a", "b", "side", "cls", "own", "text"))
        return whole.mapInArrow(_compare(shingle, k, numerator, denominator), "u long, v long")

    # members and leaders
    best = F.max(F.struct("lists", (-F.col("cls")).alias("cls")))
    leaders = members.select("list", "cls").join(facts.select("cls", "lists"), "cls").groupBy("list").agg((-best["cls"]).alias("leader"))
    group = written(members.join(leaders, "list").where("cls <> leader").select("leader", "cls", "n").distinct(), "groups")
    sizes = group.groupBy("leader").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    asked = group.join(sizes, "leader").select("leader", "cls", F.pmod(F.xxhash64("cls", F.lit(13)), F.col("blocks")).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(2).alias("side"))
    lead = sizes.select("leader", F.col("leader").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("side"))
    stars = settled(written(compared(asked.unionByName(lead).withColumn("own", F.col("cls"))), "stars"))

    # members of different components
    found = labels(stars)
    tagged = (
        group.join(found.select(F.col("node").alias("cls"), F.col("component").alias("c")), "cls", "left")
        .join(found.select(F.col("node").alias("leader"), F.col("component").alias("l")), "leader", "left")
        .select("leader", "cls", "n", F.coalesce("c", "cls").alias("own"), (F.coalesce("c", "cls") != F.coalesce("l", "leader")).alias("rest"))
    )
    return stars.unionByName(compared(_across(tagged)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")


def _labelled(rows: DataFrame, shingle: int, similarity: tuple[int, int], k: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of (doc_id, rk, text): described rows, and classes with their component.

    With ``by_id`` rows without an id take no part, and the classes of one id are linked.
    """
    numerator, denominator = similarity
    described = written(rows.mapInArrow(_describe(shingle, k), "doc_id long, rk long, n_shingles long, set_id binary, sketch binary"), "sketches")
    named = described.where("set_id IS NOT NULL AND doc_id IS NOT NULL" if by_id else "set_id IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("first")
    grouped = named.groupBy("set_id").agg(first, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(grouped.select("set_id", "first", "first.doc_id", "first.rk", "n", "sketch", F.monotonically_increasing_id().alias("cls")), "classes")
    links = _class_links(classes, rows, shingle, numerator, denominator, k)
    if by_id:  # texts that share an id are one document
        several = named.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("two")).where("one <> two").select("doc_id")
        if several.agg(F.count("*")).first()[0]:
            twice = named.select("doc_id", "set_id").join(several, "doc_id").join(classes.select("set_id", "cls"), "set_id")
            least = twice.groupBy("doc_id").agg(F.min("cls").alias("v"))
            links = links.unionByName(twice.join(least, "doc_id").select(F.col("cls").alias("u"), "v"))
    found = labels(settled(written(links, "links"))).withColumnRenamed("node", "cls")
    placed = classes.select("set_id", "first", "cls").join(found, "cls", "left").select("set_id", "first", F.coalesce("component", "cls").alias("component"))
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    return described, placed.join(heads, "component").select("set_id", "head")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), k: int = 48, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    component_id is the smallest id that links reach, the document's own included; kept says
    that it is the document's own. ``similarity`` is an exact fraction, compared in integers.

    Defined cases: a null or empty text and one of white space only has no shingle and no
    link. Rows that share an id count as one document, so they share a component. A row
    without an id is linked with nothing: component_id is null and kept true. Words and
    shingles are compared by 64-bit hashes. Other columns are left unread. An empty table
    gives an empty table.
    """
    described, label = _labelled(_keyed(docs, id_col, text_col), shingle, similarity, k, True)
    return (
        described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
        .join(label.select("set_id", F.col("head.doc_id").alias("component_id")), "set_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.expr("doc_id <=> component_id"))
    )


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), k: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group: one of each group stays.

    It is the one with the smallest id, rows without an id last, and of several texts under that
    id one of them. Groups are those of texts: rows that share an id but not a group all stay.
    Rows without words are in no group and stay. Other columns are carried unchanged; of rows
    that are equal in id and text one stays, whatever their other columns are.
    """
    keyed = _keyed(docs, id_col, text_col)
    described, label = _labelled(keyed, shingle, similarity, k, False)
    ruled = described.where("set_id IS NOT NULL").select("set_id", "doc_id", "rk").join(label, "set_id")
    away = written(
        ruled.select("doc_id", "rk", (~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("rk") == F.col("head.rk")))).alias("gone"))
        .groupBy("doc_id", "rk")
        .agg(F.max("gone").alias("gone"), F.count("*").alias("times"))
        .where("gone OR times > 1")
        .select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk"), "gone"),
        "away",
    )
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("__row"), F.col(id_col).cast("long").alias("__doc"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("__key"))
    same = (F.col("__key") == F.col("__rk")) & F.col("__doc").eqNullSafe(F.col("__id"))
    told = rows.join(away.hint("merge"), same, "left")
    one = told.where("NOT gone").groupBy("__doc", "__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    return told.where("gone IS NULL").select("__row.*").unionByName(one.select("__row.*"))
