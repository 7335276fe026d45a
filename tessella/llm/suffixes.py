"""Repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

Every string of ``length`` bytes holds an anchor (see ``repeats``), so suffixes at anchors are
enough: two strings are equal if they agree from the anchor on and before it. Of the spans whose
anchors occur more than once, each task sorts the suffixes into runs, a run for each part, and
sends them front-coded (shared prefix length and rest). A part's runs are combined by a loser
tree whose nodes hold how much a loser shares with what passed it, so that a prefix once compared
isn't compared again. Neighbours in the sorted order then tell, by their common prefixes and by
what precedes the anchors, which strings are equal and which document is the first to hold them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import CONTENTS, PACKED, SLICE, VERDICTS, Windows, candidates, chosen_spans, covered, cut_hot, from_planes, gathered, gathered_rows, interval_rows, keyed, packed_batches, planes, runs_of, settled, settled_batches, shared_spans, spans_of, units_of
from .tables import text_slices


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    most = min(len(a), len(b))
    while known + 8 <= most and a[known : known + 8] == b[known : known + 8]:
        known += 8
    while known < most and a[known] == b[known]:
        known += 1
    return known


class LoserTree:
    """Merges sorted runs of (string, prefix shared with the one before, payload)."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size  # of inner nodes, by run
        self.top = self._start(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if self.shared[a] != self.shared[b]:  # who shares more with what passed last comes first
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        s, t = x[0], y[0]
        h = common(s, t, self.shared[a])
        if h == len(s) or h < len(t) and s[h] < t[h]:
            self.shared[b] = h
            return a, b
        self.shared[a] = h
        return b, a

    def _start(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._start(2 * node), self._start(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        while self.heads[self.top] is not None:
            run = self.top
            string, _, payload = self.heads[run]
            yield string, self.shared[run], payload
            self.heads[run] = following = next(self.runs[run], None)
            self.shared[run] = following[1] if following else 0
            node = (run + self.size) // 2
            while node:
                run, self.losers[node] = self._play(run, self.losers[node])
                node //= 2
            self.top = run


def _matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray, wide: int, backwards: bool = False) -> np.ndarray:
    """A row of ``wide`` bytes for each range, zeros after its end; backwards from its end."""
    at = np.arange(wide)
    place = (begin + size - 1)[:, None] - at if backwards else begin[:, None] + at
    inside = at < size[:, None]
    return np.where(inside, data[np.where(inside, place, 0)], 0).astype(np.uint8) if len(data) else np.zeros((len(begin), wide), np.uint8)


def _lanes(matrix: np.ndarray) -> list[np.ndarray]:
    """The rows as big-endian 64-bit columns, so that they compare like their bytes."""
    wide = -(-max(1, matrix.shape[1]) // 8) * 8
    padded = np.zeros((len(matrix), wide), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    return list(padded.view(">u8").astype(np.uint64).T)


def _runs(windows: Windows, parts: int, hot: np.ndarray):
    """Sorts the candidate suffixes of a slice, front-codes them, and packs them by part.

    Spans that are equal in the slice are one entry of a run with several owners. Of spans of hot
    anchors only the contents are packed, with the least id that the task has seen so far.
    """
    longest, before = windows.length, windows.length - windows.gram

    def sorted_runs(data: np.ndarray, spans, deal: np.ndarray, begin: np.ndarray, rk: np.ndarray, own: np.ndarray, shared: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple]:
        left = spans.at
        size = spans.more + longest - left
        suffix = _matrix(data, begin + left, size, longest)
        back = _matrix(data, begin, left, before, True)
        part = (deal % np.uint64(parts)).astype(np.int64)
        keys = [part, *_lanes(suffix), size, *_lanes(back), left]
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        head = order[new]  # the first of each group of equal spans
        unlike = suffix[head][1:] != suffix[head][:-1]
        common_ = np.concatenate([[0], np.where(unlike.any(axis=1), unlike.argmax(axis=1), longest)])
        common_ = np.minimum(common_, np.minimum(size[head], np.concatenate([[0], size[head][:-1]])))
        common_[1:][part[head][1:] != part[head][:-1]] = 0
        at = np.arange(longest)
        rests = (at >= common_[:, None]) & (at < size[head][:, None])
        flat, ends = suffix[head][rests], np.concatenate([[0], np.cumsum(rests.sum(axis=1))])
        fronts, cuts = back[head][np.arange(before) < left[head][:, None]], np.concatenate([[0], np.cumsum(left[head])])
        entry = np.cumsum(new) - 1
        out = []
        for a, b in runs_of(part[head]):
            e, f = np.searchsorted(entry, [a, b])
            mine = order[e:f]
            own_ends, own_cuts = ends[a : b + 1], cuts[a : b + 1]
            of_many = np.flatnonzero(shared[mine])
            parts_ = [
                struct.pack("<iiiii", b - a, own_ends[-1] - own_ends[0], own_cuts[-1] - own_cuts[0], f - e, len(of_many)),
                planes(common_[a:b], 2),
                planes(np.diff(own_ends), 2),
                planes(left[head[a:b]], 2),
                planes(spans.more[head[a:b]], 2),
                planes(entry[e:f] - a, 4),
                rk[mine].astype("<i8").tobytes(),
                own[mine].astype("<i8").tobytes(),
                spans.first[mine].astype("<i4").tobytes(),
                planes(of_many, 4),
                one[mine[of_many]].astype("<i8").tobytes(),
                two[mine[of_many]].astype("<i8").tobytes(),
                flat[own_ends[0] : own_ends[-1]].tobytes(),
                fronts[own_cuts[0] : own_cuts[-1]].tobytes(),
            ]
            out.append((int(part[head[a]]), CONTENTS, None, None, None, b"".join(parts_)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for batch in text_slices(batches, "text", SLICE):
            units = units_of(batch.column("text"), "bytes")
            spans, deal, cold = cut_hot(units, chosen_spans(spans_of(units, windows), batch.column("found")), windows, hot)
            if not len(spans.text):
                continue
            begin = units.starts[spans.text] + spans.first
            rk, own = batch.column("rk").to_numpy()[spans.text], batch.column("own").to_numpy()[spans.text]
            some = shared_spans(units.data, begin[cold:], spans.more[cold:] + longest, rk[cold:], own[cold:], spans.text[cold:], spans.first[cold:], parts)
            new = []
            for i, (key, least) in enumerate(zip(zip(some.one.tolist(), some.two.tolist()), own[cold + some.keep].tolist())):
                if key not in sent or least < sent[key]:
                    sent[key] = least
                    new.append(i)
            chosen = np.concatenate([np.arange(cold), cold + some.keep[new]]).astype(np.int64)
            shared = np.arange(len(chosen)) >= cold
            one, two = (np.concatenate([np.zeros(cold, np.int64), x[new]]) for x in (some.one, some.two))
            rows = sorted_runs(units.data, spans.take(chosen), deal[chosen], begin[chosen], rk[chosen], own[chosen], shared, one, two) if len(chosen) else []
            yield from packed_batches(some.owners + rows)

    return run


def _strings(shared: list[int], sizes: list[int], rest: bytes, first: int) -> Iterator[tuple[bytes, int, int]]:
    """Undoes the front coding; payloads count on from ``first``."""
    last, at = b"", 0
    for i, (h, n) in enumerate(zip(shared, sizes)):
        last = last[:h] + rest[at : at + n]
        at += n
        yield last, h, first + i


def earlier_windows(doc: np.ndarray, common_with_last: np.ndarray, left: np.ndarray, back: np.ndarray, more: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset of the anchor in the window) of each window that an earlier document holds.

    Rows are in the order of their suffixes; ``back`` holds the bytes before the anchors, from
    the anchor backwards. Two windows with the anchor at offset o are equal if the suffixes
    share length - o bytes and the o bytes before the anchors are the same.
    """
    n, most = len(doc), windows.length - windows.gram
    rows, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    same = np.zeros(n, np.int64)  # a number for the o bytes before each anchor
    for o in range(most + 1):
        if o:
            _, same = np.unique(same * 256 + back[:, o - 1], return_inverse=True)
        has = np.flatnonzero((o <= left) & (o >= left - more))
        if len(has) < 2:
            continue
        block = np.cumsum(common_with_last < windows.length - o)[has]
        key = block * (n + 1) + same[has]
        order = np.argsort(key)
        group = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        own = doc[has][order]
        first = np.minimum.reduceat(own, np.flatnonzero(np.diff(group, prepend=-1)))
        late = own > first[group]
        rows.append(has[order][late])
        offsets.append(np.full(int(late.sum()), o))
    return np.concatenate(rows), np.concatenate(offsets)


def _merge(windows: Windows):
    before = windows.length - windows.gram

    def part(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        runs, held, seen, entries = [], [[] for _ in range(10)], 0, 0
        for data in blobs:
            n, size, front, m, h = struct.unpack_from("<iiiii", data)
            at, values = 20, []
            for wide in (2, 2, 2, 2):
                x, at = from_planes(data, at, n, wide)
                values.append(x)
            entry, at = from_planes(data, at, m, 4)
            rk, own, first = np.frombuffer(data, "<i8", m, at), np.frombuffer(data, "<i8", m, at + 8 * m), np.frombuffer(data, "<i4", m, at + 16 * m)
            shared, at = from_planes(data, at + 20 * m, h, 4)
            one, two = np.frombuffer(data, "<i8", h, at), np.frombuffer(data, "<i8", h, at + 8 * h)
            at += 16 * h
            runs.append(_strings(values[0].tolist(), values[1].tolist(), data[at : at + size], seen))
            back = np.zeros((n, before), np.uint8)
            back[np.arange(before) < values[2][:, None]] = np.frombuffer(data, np.uint8, front, at + size)
            for x, y in zip(held, (values[2], values[3], back, entry + seen, rk, own, first, shared + entries, one, two)):
                x.append(y)
            seen, entries = seen + n, entries + m
        left, more, back, entry, rk, own, first, shared, one, two = (np.concatenate(x) for x in held)
        row, common_ = np.zeros(seen, np.int64), np.zeros(seen, np.int64)
        for i, (_, h, payload) in enumerate(LoserTree(runs)):
            row[i], common_[i] = payload, h
        least = np.full(seen, np.iinfo(np.int64).max)
        np.minimum.at(least, entry, own)
        at, offset = earlier_windows(least[row], common_, left[row], back[row], more[row], windows)
        # what an earlier document has goes from the owners with the least id, all from the others
        span, start = row[at], left[row[at]] - offset
        order = np.lexsort((start, span))
        span, start = span[order], start[order]
        new = np.ones(len(span), bool)
        new[1:] = (span[1:] != span[:-1]) | (start[1:] > start[:-1] + windows.length)
        run = np.flatnonzero(new)
        last = np.append(run[1:] - 1, len(span) - 1)[: len(run)]
        span, low, high = span[run], start[run], start[last] + windows.length
        times = np.bincount(span, minlength=seen)
        begins = np.cumsum(times) - times
        alone = np.ones(len(entry), bool)
        alone[shared] = False
        mine, late = np.flatnonzero(alone & (own == least[entry])), np.flatnonzero(alone & (own > least[entry]))
        each = gathered(begins[entry[mine]], times[entry[mine]])
        who = np.repeat(mine, times[entry[mine]])
        starts, ends = np.concatenate([low[each], np.zeros(len(late), np.int64)]), np.concatenate([high[each], more[entry[late]] + windows.length])
        who = np.concatenate([who, late])
        yield from settled_batches(interval_rows(rk[who], own[who], first[who] + starts, first[who] + ends))
        # a shared span's verdict: its least owner, its length, and what goes from that owner
        order = np.lexsort((own[shared], two, one))
        verdicts = []
        for a, _ in runs_of(one[order], two[order]):
            i = order[a]
            e = entry[shared[i]]
            gone = slice(begins[e], begins[e] + times[e])
            lead = struct.pack("<qi", int(own[shared[i]]), int(more[e]) + windows.length)
            verdicts.append((VERDICTS, int(one[i]), int(two[i]), None, lead + np.stack([low[gone], high[gone]], axis=1).astype("<i4").tobytes()))
        yield from settled_batches(verdicts)

    return part


def _first_keeps(own: np.ndarray, verdict: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shared span's owners those of least id lose the intervals, all others the span."""
    least, size = struct.unpack_from("<qi", verdict)
    low, high = np.frombuffer(verdict, "<i4", offset=12).reshape(-1, 2).T
    mine, late = np.flatnonzero(own == least), np.flatnonzero(own > least)
    return (
        np.concatenate([np.repeat(mine, len(low)), late]),
        np.concatenate([np.tile(low, len(mine)), np.zeros(len(late), np.int64)]),
        np.concatenate([np.tile(high, len(mine)), np.full(len(late), size)]),
    )


def _keep_bytes(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            units = units_of(batch.column("text"), "bytes")
            data, starts = units.data, units.starts
            gone = covered(starts, batch.column("found"))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = starts[:-1][starts[:-1] < len(gone)]
            begins[inner] = gone[inner]
            total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])
            kept, stay = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[starts].tolist()
            values = [kept[a:b] for a, b in zip(stay[:-1], stay[1:])]
            column = pa.array(values, pa.binary()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (np.diff(starts), total(gone), total(begins))], column],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeated_bytes(
    docs: DataFrame, length: int = 50, gram: int | None = None, texts: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept), one for each row of ``docs``.

    Each UTF-8 byte that a string of ``length`` bytes covers goes if the string also starts in
    a document with a smaller id. n_spans counts runs of removed bytes. kept (binary) is what
    stays, or with ``texts`` false its SHA-256 in hex. ``gram`` anchors the strings.

    Defined cases: a null or empty text has no bytes; rows that share an id take nothing from
    each other; a row without an id neither takes bytes from others nor loses any; an empty
    table gives an empty table; other columns are left unread.
    """
    windows = Windows("bytes", length, gram or max(1, length * 2 // 5))
    rows = keyed(docs, id_col, text_col)
    open_ = candidates(rows.where("doc_id IS NOT NULL"), windows)
    runs = open_.rows.mapInArrow(_runs(windows, open_.parts, open_.hot), PACKED)
    intervals = settled(runs, open_.parts, _merge(windows), _first_keeps, len(open_.hot) > 0)
    out = gathered_rows(rows, intervals, "left").select("doc_id", "text", "found")
    return out.mapInArrow(_keep_bytes(texts), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'binary' if texts else 'string'}")
