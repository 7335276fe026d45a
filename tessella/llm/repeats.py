"""Where texts may repeat: the part that finding repeated windows shares.

A text is a row of units (bytes, or hashed words); a window is ``length`` units of one text.
Of the grams (``gram`` units) in a window the one with the least hash is its anchor, so equal
windows have equal anchors at equal offsets. Neighbouring windows with one anchor make a span:
the units that they cover.

A window whose anchor occurs once cannot repeat. ``candidates`` counts anchors and names the
spans of the others; nothing is decided here. The contents of these spans go to the shard of
their anchor, where the caller's index compares them. Spans of an anchor that very many others
have are cut by a second anchor, the least gram beside the first, so that they meet in shards
of their own: equal windows have the second one in common too. Such a span may be one that very
many texts share, so its owners don't go to its shard: a task sends its content there once or
twice, and the owners meet the shard's verdict by a join on the content's digest.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import text_slices, written
from .words import as_large, mix64, split_words, word_hashes

#: Bytes of text for each part, and the fewest parts.
PART = 16 << 20
PARTS = 64
#: Bytes of text that a task packs together.
SLICE = 12 << 20
#: Windows that are looked at together; longer texts are cut at its multiples.
PIECE = 1 << 17
#: Times that an anchor occurs, from which on its spans are cut.
HOT = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Low bits of a compared gram that hold its place in a piece.
_PLACE = np.uint64((1 << 20) - 1)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_SCATTER = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))

PLACES, HOT_ANCHORS = 0, 1
#: Kinds of rows to and from shards: contents to compare; intervals of texts; owners of shared
#: spans and the texts that these name, which pass through; and what holds for a shared span.
CONTENTS, INTERVALS, OWNERS, TEXTS, VERDICTS = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Windows:
    """What counts as a repeat: ``units`` is 'bytes' or 'words'."""

    units: str
    length: int
    gram: int

    def __post_init__(self):
        if self.length > 1 << 16 or not 0 < self.gram <= self.length:
            raise ValueError(f"windows of {self.length} {self.units} with grams of {self.gram}")


@dataclass
class Units:
    data: np.ndarray  # bytes, or a 64-bit hash for each word
    starts: np.ndarray

    def values(self, low: int, high: int) -> np.ndarray:
        own = self.data[low:high]
        return _SCATTER[own] if own.dtype == np.uint8 else own


def units_of(texts: pa.Array, kind: str) -> Units:
    if kind == "words":
        batch = split_words(texts)
        return Units(word_hashes(batch), batch.starts)
    texts = as_large(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return Units(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Spans:
    """Spans of a batch, in order of text and place; places are relative to the text."""

    text: np.ndarray
    first: np.ndarray  # the first window's start
    more: np.ndarray  # how many windows follow it
    at: np.ndarray  # the anchor's place from the first window's start
    anchor: np.ndarray

    def take(self, at: np.ndarray) -> Spans:
        return Spans(*[getattr(self, f.name)[at] for f in fields(self)])


def _together(spans: list[Spans]) -> Spans:
    if not spans:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none, none, none.astype(np.uint64))
    return Spans(*[np.concatenate([getattr(s, f.name) for s in spans]) for f in fields(Spans)])


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        most = max(n, PIECE + 4096)
        _POWERS.update(up=np.cumprod(np.full(most, _BASE)), back=np.cumprod(np.full(most, _BACK)))
    return _POWERS["up"][:n], _POWERS["back"][:n]


def _piece(values: np.ndarray, starts: np.ndarray, windows: Windows, avoid: np.ndarray | None = None) -> Spans:
    """Spans of a piece's texts; grams with the hash that ``avoid`` has at their place come last."""
    n, q, length = len(values), windows.gram, windows.length
    wide = length - q + 1
    if n < length:
        return _together([])
    up, back = _powers(n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up)])
    grams = mix64((prefix[q:] - prefix[:-q]) * back[: n - q + 1])
    if avoid is not None:
        grams = np.where(grams == avoid[: len(grams)], _MOST, grams)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step * 2 <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    text_of = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    start = np.flatnonzero(text_of[: n - length + 1] == text_of[length - 1 :])
    if not len(start):
        return _together([])
    place = (least[start] & _PLACE).astype(np.int64)
    cut = np.flatnonzero((place[1:] != place[:-1]) | (np.diff(start) != 1))
    one, two = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(start) - 1]])
    first = start[one]
    text = text_of[first].astype(np.int64)
    return Spans(text, first - starts[text], start[two] - first, place[one] - first, grams[place[one]])


def spans_of(units: Units, windows: Windows) -> Spans:
    """All spans of all texts. Where a piece ends a span ends too, which depends on the text alone."""
    starts, out, t = units.starts, [], 0
    while t < len(starts) - 1:
        u = max(t + 1, int(np.searchsorted(starts, starts[t] + PIECE, "right")) - 1)
        low, high = int(starts[t]), int(starts[u])
        for a in range(low, high if high - low > PIECE else low + 1, PIECE):
            b = min(high, a + PIECE + windows.length - 1)
            inner = starts[t : u + 1] - low if b == high and a == low else np.array([0, b - a])
            some = _piece(units.values(a, b), inner, windows)
            some.text += t
            some.first += a - low
            out.append(some)
        t = u
    return _together(out)


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin, ..., begin + size - 1 of every range, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def cut_hot(units: Units, spans: Spans, windows: Windows, hot: np.ndarray) -> tuple[Spans, np.ndarray, int]:
    """The spans, those of a hot anchor cut by second anchors and last, the key by which each is
    dealt, and how many aren't of a hot anchor."""
    n = len(spans.text)
    if not len(hot) or not n:
        return spans, spans.anchor, n
    place = np.minimum(np.searchsorted(hot, spans.anchor), len(hot) - 1)
    is_hot = hot[place] == spans.anchor
    if not is_hot.any():
        return spans, spans.anchor, n
    rest, own = spans.take(np.flatnonzero(~is_hot)), spans.take(np.flatnonzero(is_hot))
    size = own.more + windows.length
    ends, out, keys = np.cumsum(size), [rest], [rest.anchor]
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        some, n = own.take(np.arange(a, b)), size[a:b]
        begin = units.starts[some.text] + some.first
        data = units.data[gathered(begin, n)]
        got = _piece(_SCATTER[data] if data.dtype == np.uint8 else data, np.concatenate([[0], np.cumsum(n)]), windows, np.repeat(some.anchor, n))
        of = got.text
        out.append(Spans(some.text[of], some.first[of] + got.first, got.more, some.at[of] - got.first, some.anchor[of]))
        keys.append(mix64(some.anchor[of] * _BASE + got.anchor))
        a = b
    return _together(out), np.concatenate(keys), len(rest.text)


def digests(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash, in two halves, of the units of each range."""
    one, two = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
        n = size[a:b]
        first = np.cumsum(n) - n
        flat = data[gathered(begin[a:b], n)].astype(np.uint64)
        place = mix64(np.arange(len(flat), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64))
        one[a:b] = mix64(np.add.reduceat(mix64(flat + place), first) + n.astype(np.uint64))
        two[a:b] = mix64(np.add.reduceat(mix64(flat * _BASE ^ place), first) + n.astype(np.uint64))
        a = b
    return one.view(np.int64), two.view(np.int64)


@dataclass
class Shared:
    """Spans of hot anchors in a slice: one for each content, and rows with the owners of all."""

    keep: np.ndarray  # the spans that go to their shard, of those that were asked about
    one: np.ndarray  # their digests
    two: np.ndarray
    count: np.ndarray  # and owners in the slice
    owners: list[tuple]  # (part, kind, one, two, slice, data)


def shared_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray, rk: np.ndarray, own: np.ndarray, text: np.ndarray, first: np.ndarray, parts: int) -> Shared:
    """Takes the owners from spans: of equal spans the one of least ``own`` stays for the shard.

    Owners leave in a row for each content, as places in a list of the slice's texts, which
    leaves too, under a number of its own; rows are dealt so that no part has all of a content.
    """
    if not len(text):
        none = np.zeros(0, np.int64)
        return Shared(none, none, none, none, [])
    one, two = digests(data, begin, size)
    _, some, place = np.unique(text, return_index=True, return_inverse=True)
    texts, owns = rk[some].astype("<i8"), own[some].astype("<i8")
    number = int(mix64(np.array([np.sum(mix64(texts.view(np.uint64) + mix64(np.arange(len(texts), dtype=np.uint64)))) + np.uint64(len(texts))])).view(np.int64)[0])
    rows: list[tuple] = [(number % parts, TEXTS, None, None, number, texts.tobytes() + owns.tobytes())]
    order = np.lexsort((first, rk, own, two, one))
    bounds = list(runs_of(one[order], two[order]))
    keep = order[[a for a, _ in bounds]]
    for a, b in bounds:
        at = order[a:b]
        packed = planes(place[at], 4) + planes(first[at], 4)
        rows.append(((int(one[at[0]]) ^ number) % parts, OWNERS, int(one[at[0]]), int(two[at[0]]), number, packed))
    return Shared(keep, one[keep], two[keep], np.array([b - a for a, b in bounds], np.int64), rows)


def planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, lowest bytes of all first, which compresses well."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def from_planes(data: bytes, at: int, n: int, size: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return out.view("<i8").ravel(), at + n * size


def runs_of(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of rows that agree in all of the keys."""
    if len(keys[0]):
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = [0, *cuts.tolist(), len(keys[0])]
        yield from zip(bounds[:-1], bounds[1:])


def row_batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType], most: int = 2000) -> Iterator[pa.RecordBatch]:
    for first in range(0, max(1, len(rows)), most):
        columns = list(zip(*rows[first : first + most])) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def ints_rows(kind: int | None, rk: np.ndarray, own: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """([kind,] rk, own, data) for each row key; data holds the 32-bit values of its rows in turn."""
    order = np.lexsort((own, rk))
    rk, own = rk[order], own[order]
    flat = np.stack([v[order] for v in values], axis=1).astype("<i4")
    lead = () if kind is None else (kind,)
    return [(*lead, int(rk[a]), int(own[a]), flat[a:b].tobytes()) for a, b in runs_of(rk, own)]


def row_ints(found: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, values) of the packed 32-bit values of each text; values has ``width`` columns."""
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    held = found.flatten().to_pylist()
    of = np.repeat(np.arange(len(found)), np.array(found.value_lengths().fill_null(0)))
    sizes = np.array([len(x) for x in held], np.int64)
    flat = np.frombuffer(b"".join(held), "<i4").astype(np.int64).reshape(-1, width)
    return np.repeat(of, sizes // (4 * width)), flat


def _ask(windows: Windows, parts: int) -> Callable:
    """Packs each slice's anchors by part; spans whose anchor the slice repeats are named at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            spans = spans_of(units_of(batch.column("text"), windows.units), windows)
            rk, own = batch.column("rk").to_numpy(), batch.column("own").to_numpy()
            _, first, group, times = np.unique(spans.anchor, return_index=True, return_inverse=True, return_counts=True)
            many = np.flatnonzero(times[group] > 1)
            out = [(int(k % parts), PLACES, k, o, d) for k, o, d in ints_rows(None, rk[spans.text[many]], own[spans.text[many]], spans.first[many])]
            some, count = spans.take(first), np.minimum(times, 1 << 30)
            part = (some.anchor % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((some.first, some.text, part))
            for a, b in runs_of(part[order]):
                at = order[a:b]
                texts, n = np.unique(some.text[at], return_counts=True)
                data = struct.pack("<ii", len(texts), b - a) + rk[texts].astype("<i8").tobytes() + own[texts].astype("<i8").tobytes() + n.astype("<i4").tobytes()
                data += some.anchor[at].astype("<u8").tobytes() + some.first[at].astype("<i4").tobytes() + planes(count[at], 4)
                out.append((int(part[at[0]]), None, None, None, data))
            yield from row_batches(out, ["part", "kind", "rk", "own", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()])

    return run


def _count(hot: int) -> Callable:
    """Names the spans whose anchors occur more than once in a part, and its hot anchors."""

    def part(blobs: list[bytes]) -> list[tuple]:
        held: list[list] = [[], [], [], [], []]
        for data in blobs:
            texts, n = struct.unpack_from("<ii", data)
            count = np.frombuffer(data, "<i4", texts, 8 + 16 * texts)
            at = 8 + 20 * texts
            held[0].append(np.repeat(np.frombuffer(data, "<i8", texts, 8), count))
            held[1].append(np.repeat(np.frombuffer(data, "<i8", texts, 8 + 8 * texts), count))
            held[2].append(np.frombuffer(data, "<u8", n, at))
            held[3].append(np.frombuffer(data, "<i4", n, at + 8 * n))
            held[4].append(from_planes(data, at + 12 * n, n, 4)[0])
        rk, own, anchor, first, count = (np.concatenate(x) for x in held)
        known, group = np.unique(anchor, return_inverse=True)
        total = np.bincount(group, count)
        open_ = np.flatnonzero((total[group] > 1) & (count == 1))
        out = ints_rows(PLACES, rk[open_], own[open_], first[open_])
        if (total > hot).any():
            out.append((HOT_ANCHORS, 0, 0, known[total > hot].astype("<u8").tobytes()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        send = lambda rows: row_batches(rows, ["kind", "rk", "own", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()], 5000)
        for batch in batches:
            known = []
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "rk", "own", "data"))):
                if row[0] is not None:
                    known.append(tuple(row))
                    continue
                if p != current and held:
                    yield from send(part(held))
                    held = []
                current = p
                held.append(row[-1])
            yield from send(known)
        yield from send(part(held) if held else [])

    return run


@dataclass
class Candidates:
    rows: DataFrame  # (doc_id, text, rk, own, found): the places of its candidate spans
    hot: np.ndarray
    parts: int


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, rk, own); rk and own tell rows apart unless id and text are equal."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.select("*", F.xxhash64("doc_id", "text").alias("rk"), F.coalesce("doc_id", F.lit(0)).alias("own"))


def gathered_rows(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows`` with ``found``: the distinct data of their keys, whose number the text bounds."""
    return rows.join(found.select("rk", "own", "data").distinct().groupBy("rk", "own").agg(F.collect_list("data").alias("found")), ["rk", "own"], how)


def candidates(rows: DataFrame, windows: Windows) -> Candidates:
    """The rows that have spans whose anchor occurs more than once, with the places of these spans.

    The hot anchors are collected: each occurs more than ``HOT`` times and more than once in
    2**23 bytes of text, so that there are a few hundred thousand at most.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(PARTS, -(-size // PART))
    asked = rows.mapInArrow(_ask(windows, parts), "part int, kind int, rk long, own long, data binary")
    dealt = asked.repartitionById(parts, "part").sortWithinPartitions("part")
    spans = written(dealt.mapInArrow(_count(max(HOT, size >> 23)), "kind int, rk long, own long, data binary"), "spans")
    hot = [np.frombuffer(r["data"], "<u8") for r in spans.where(F.col("kind") == HOT_ANCHORS).select("data").collect()]
    return Candidates(gathered_rows(rows, spans.where(F.col("kind") == PLACES), "inner"), np.unique(np.concatenate([np.zeros(0, np.uint64), *hot])), parts)


def chosen_spans(spans: Spans, found: pa.Array) -> Spans:
    """The spans of a batch whose places ``found`` names for their texts."""
    text, first = row_ints(found, 1)
    wide = np.int64(1) << np.int64(40)
    return spans.take(np.flatnonzero(np.isin(spans.text * wide + spans.first, text * wide + first[:, 0])))


PACKED = "part int, kind int, one long, two long, slice long, data binary"
SETTLED = "kind int, one long, two long, slice long, data binary"


def packed_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    return row_batches(rows, ["part", "kind", "one", "two", "slice", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def settled_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    return row_batches(rows, ["kind", "one", "two", "slice", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], 5000)


def in_shards(settle: Callable[[list[bytes]], Iterator[pa.RecordBatch]]) -> Callable:
    """Settles the contents of each part, whose rows come together; owners pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            passing = []
            for p, kind, *row, data in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "one", "two", "slice", "data"))):
                if kind != CONTENTS:
                    passing.append((kind, *row, data))
                    continue
                if p != current and held:
                    yield from settle(held)
                    held = []
                current = p
                held.append(data)
            if passing:
                yield from settled_batches(passing)
        if held:
            yield from settle(held)

    return run


def interval_rows(rk: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    """The intervals of each text: (INTERVALS, rk, own, no slice, data)."""
    return [(kind, k, o, None, data) for kind, k, o, data in ints_rows(INTERVALS, rk, own, start, end)]


def _hand(meet: Callable) -> Callable:
    """Intervals of a slice's texts in shared spans; ``meet(own, verdict)`` gives (owner, low, high)."""

    def hand(slice_: pa.Table) -> pa.Table:
        texts = next((d for d, v in zip(slice_.column("data").to_pylist(), slice_.column("verdict").to_pylist()) if v is None), b"")
        rk, own = np.frombuffer(texts, "<i8").reshape(2, -1)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for data, verdict in zip(slice_.column("data").to_pylist(), slice_.column("verdict").to_pylist()):
            if verdict is None:
                continue
            n = len(data) // 8
            place, at = from_planes(data, 0, n, 4)
            first, _ = from_planes(data, at, n, 4)
            who, low, high = meet(own[place], verdict)
            for x, y in zip(found, (place[who], first[who] + low, first[who] + high)):
                x.append(y)
        place, low, high = (np.concatenate(x) for x in found)
        rows = ints_rows(None, rk[place], own[place], low, high)
        columns = list(zip(*rows)) or [[]] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("rk", "own", "data"), columns, (pa.int64(), pa.int64(), pa.binary()))})

    return hand


def settled(packed: DataFrame, parts: int, settle: Callable, meet: Callable, shared: bool) -> DataFrame:
    """Rows (rk, own, data): the intervals of all texts, those of shared spans by their digests.

    ``packed`` has rows of ``PACKED``. Owners and verdicts are joined by digest, where a content
    that many rows of owners have is split, and go on by slice to the texts that they name, of
    which a slice has about ``SLICE`` bytes. Without hot anchors there are none.
    """
    dealt = packed.repartitionById(parts, "part").sortWithinPartitions("part")
    out = written(dealt.mapInArrow(in_shards(settle), SETTLED), "intervals")
    of = lambda kind: out.where(F.col("kind") == kind)
    own = of(INTERVALS).select(F.col("one").alias("rk"), F.col("two").alias("own"), "data")
    if not shared:
        return own
    verdicts = of(VERDICTS).select("one", "two", F.col("data").alias("verdict"))
    met = of(OWNERS).select("one", "two", "slice", "data").join(verdicts, ["one", "two"]).select("slice", "data", "verdict")
    met = met.unionByName(of(TEXTS).select("slice", "data", F.lit(None).cast("binary").alias("verdict")).distinct())
    return own.unionByName(met.groupBy("slice").applyInArrow(_hand(meet), "rk long, own long, data binary"))


def covered(starts: np.ndarray, found: pa.Array) -> np.ndarray:
    """A mask of the units in the intervals that ``found`` holds for each text."""
    text, interval = row_ints(found, 2)
    edge = np.zeros(int(starts[-1]) + 1, np.int64)
    np.add.at(edge, starts[text] + interval[:, 0], 1)
    np.add.at(edge, starts[text] + interval[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0
