"""Repeated word windows from a compressed FM-index for each shard.

``repeats`` names the spans whose anchors occur more than once and deals them to shards by
anchor. A shard's distinct spans, a separator after each, are indexed by the Burrows-Wheeler
transform in a wavelet tree whose shape follows the words' frequencies. The windows of all its
spans are streamed through backward search, which keeps the interval of suffixes that start
with what has been read, and ends a window when that interval holds one place of the index: a
matching statistic cut off at the window's length. What reaches the length, or ends at a place
that stands for several texts, is reported, and goes to every text that has the span.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .repeats import CONTENTS, PACKED, SLICE, VERDICTS, Windows, candidates, chosen_spans, covered, cut_hot, from_planes, gathered, gathered_rows, interval_rows, keyed, packed_batches, planes, runs_of, settled, settled_batches, shared_spans, spans_of, units_of
from .tables import text_slices
from .words import mix64, split_words

#: Windows that one search takes at a time.
_STREAM = 1 << 17


class WaveletTree:
    """A sequence of small integers with rank queries, compressed to about its entropy.

    The code of a value has ceil(log2(n / times)) bits, so that all nodes together hold no more
    than n * (H0 + 1). Codes are canonical: shorter ones are smaller, and values whose code ends
    at a level are the first of the next one and drop out. A level keeps its bits in 64-bit
    words with the ones before each: 16 bits within a block of 1,024 words, 64 for a block.
    """

    def __init__(self, values: np.ndarray, largest: int):
        times = np.bincount(values, minlength=largest + 1)
        used = np.flatnonzero(times)
        size = np.zeros(largest + 1, np.int64)
        size[used] = np.maximum(1, np.ceil(np.log2(len(values) / times[used]) - 1e-9)) if len(used) else 0
        self.size, deep = size, int(size.max(initial=0))
        order = used[np.lexsort((used, size[used]))]
        code = np.zeros(largest + 1, np.int64)
        code[order] = np.cumsum(np.int64(1) << (deep - size[order])) - (np.int64(1) << (deep - size[order]))
        before = np.concatenate([[0], np.cumsum(times[order])])
        self.words, self.near, self.far, self.begin, self.ones, self.bit = [], [], [], [], [], []
        rest = code[values]
        for level in range(deep):
            bits = (rest >> (deep - 1 - level) & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            count = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.words.append(words)
            self.far.append(count[::1024].copy())
            self.near.append((count - np.repeat(self.far[-1], 1024)[: len(count)]).astype(np.uint16))
            # where the node of each value starts on this level
            done = np.searchsorted(size[order], level, "right")
            prefix = code[order] >> (deep - level)
            begin = np.zeros(largest + 1, np.int64)
            begin[order] = np.maximum(before[np.searchsorted(prefix, prefix)] - before[done], 0)
            self.begin.append(begin.astype(np.int32))
            self.ones.append(self._ones(level, begin).astype(np.int32))
            self.bit.append((code >> (deep - 1 - level) & 1).astype(bool))
            if level + 1 == deep:
                break
            node = np.flatnonzero(np.diff(rest >> (deep - level), prepend=-1))  # starts of the nodes
            block = np.repeat(np.arange(len(node)), np.diff(np.append(node, len(rest))))
            zeros = np.concatenate([[0], np.cumsum(~bits)])
            own = zeros[:-1] - zeros[node][block]  # zeros before each in its node
            inside = np.arange(len(rest)) - node[block]
            total = zeros[np.append(node[1:], len(rest))] - zeros[node]
            place = node[block] + np.where(bits, total[block] + inside - own, own)
            moved = np.empty_like(rest)
            moved[place] = rest
            rest = moved[before[np.searchsorted(size[order], level + 1, "right")] - before[done] :]

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.far[level][word >> 10] + self.near[level][word] + np.bitwise_count(low)

    def rank(self, value: np.ndarray, *at: np.ndarray) -> np.ndarray:
        """How often each value occurs before each of its positions: a row for each ``at``."""
        out = np.zeros((len(at), len(value)), np.int64)
        order = np.argsort(self.size[value])
        value, at = value[order], np.stack(at)[:, order].astype(np.int64)
        ends = np.searchsorted(self.size[value], np.arange(len(self.words) + 1), "right")
        done = ends[0]
        value, at = value[done:], at[:, done:]
        for level in range(len(self.words)):
            ones = self._ones(level, self.begin[level][value] + at) - self.ones[level][value]
            at = np.where(self.bit[level][value], ones, at - ones)
            # values whose code ends here are the first
            end = ends[level + 1] - done
            out[:, order[done : done + end]] = at[:, :end]
            value, at, done = value[end:], at[:, end:], done + end
            if not len(value):
                break
        return out


class FMIndex:
    """Which patterns of up to ``context`` symbols occur twice in a text of integers from 0 on.

    ``twice`` says for each place of the text whether it stands for several occurrences.
    """

    def __init__(self, text: np.ndarray, context: int, twice: np.ndarray | None = None):
        n, largest = len(text), int(text.max(initial=0))
        bits = (largest + 1).bit_length()
        width = max(1, min(62 // bits, context))
        key = np.zeros(n, np.int64)
        for k in range(width):  # as many symbols as fit in a word, past the end 0
            key <<= bits
            key[: max(0, n - k)] += text[k:].astype(np.int64) + 1
        while True:  # order by ever longer prefixes, up to the longest pattern
            order = np.argsort(key)
            new = np.diff(key[order], prepend=key[order[:1]]) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if width >= context or int(new.sum()) == n - 1:
                break
            key = rank * (int(new.sum()) + 2)
            key[: max(0, n - width)] += rank[width:] + 1
            width *= 2
        self.bwt = WaveletTree(text[order - 1], largest)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.twice = np.zeros(n + 1, bool)
        if twice is not None:
            self.twice[:n] = twice[order]

    def repeated(self, text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Whether each window of ``text`` (by its start) occurs twice or more."""
        out = np.zeros(len(start), bool)
        alive = np.arange(len(start))
        symbol = text[start + length - 1]
        low, high = self.less[symbol], self.less[symbol + 1]
        for back in range(length - 2, -2, -1):
            # an interval of one holds the window itself, and keeps to it as the window goes on
            many = high - low > 1
            if not many.all():
                out[alive[~many]] = self.twice[low[~many]]
                alive, low, high = alive[many], low[many], high[many]
            if back < 0 or not len(alive):
                break
            symbol = text[start[alive] + back]
            low, high = self.less[symbol] + self.bwt.rank(symbol, low, high)
        out[alive] = True
        return out


def folded(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, first row of each group) by equal contents; rows lie one after the other.

    Rows are put together by a hash and then compared; one that only shares a hash stays alone.
    """
    begin = np.cumsum(size) - size
    inside = np.arange(len(flat)) - np.repeat(begin, size)
    hashes = np.add.reduceat(mix64(flat.astype(np.uint64) + mix64(inside.astype(np.uint64))), begin) if len(size) else np.zeros(0, np.uint64)
    order = np.lexsort((size, hashes))
    new = np.ones(len(size), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (size[order][1:] != size[order][:-1])
    head = np.empty(len(size), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    unlike = flat != flat[gathered(begin[head], size)]
    if unlike.any():
        bad = np.add.reduceat(unlike, begin) > 0
        head[bad] = np.flatnonzero(bad)
    first, group = np.unique(head, return_inverse=True)
    return group, first


def _span_rows(windows: Windows, parts: int, hot: np.ndarray):
    """Packs the words of candidate spans by part, equal ones of a slice once.

    Of spans of hot anchors only the contents are packed, each of them until the task has sent
    two owners of it, which is all that the index has to know.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple[int, int], int] = {}
        for batch in text_slices(batches, "text", SLICE):
            units = units_of(batch.column("text"), "words")
            spans, deal, cold = cut_hot(units, chosen_spans(spans_of(units, windows), batch.column("found")), windows, hot)
            rk, own = batch.column("rk").to_numpy()[spans.text], batch.column("own").to_numpy()[spans.text]
            size = spans.more + windows.length
            begin = units.starts[spans.text] + spans.first
            some = shared_spans(units.data, begin[cold:], size[cold:], rk[cold:], own[cold:], spans.text[cold:], spans.first[cold:], parts)
            new = []
            for i, key in enumerate(zip(some.one.tolist(), some.two.tolist())):
                if sent.get(key, 0) < 2:
                    sent[key] = sent.get(key, 0) + int(some.count[i])
                    new.append(i)
            chosen = np.concatenate([np.arange(cold), cold + some.keep[new]]).astype(np.int64)
            weight = np.concatenate([np.zeros(cold, np.int64), some.count[new]])  # 0: an owner by itself
            one, two = (np.concatenate([np.zeros(cold, np.int64), x[new]]) for x in (some.one, some.two))
            spans, deal, rk, own, size, begin = spans.take(chosen), deal[chosen], rk[chosen], own[chosen], size[chosen], begin[chosen]
            group, head = folded(units.data[gathered(begin, size)], size)
            part = (deal % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((group, part))
            out = some.owners
            for a, b in runs_of(part[order]):
                at = order[a:b]
                which, code = np.unique(group[at], return_inverse=True)
                first = head[which]
                words, coded = np.unique(units.data[gathered(begin[first], size[first])], return_inverse=True)
                wide = 2 if len(words) <= 1 << 16 else 4
                shared = np.flatnonzero(weight[at])
                data = (
                    struct.pack("<iiiiii", len(first), len(words), len(coded), wide, b - a, len(shared))
                    + planes(size[first], 4)
                    + words.astype("<u8").tobytes()
                    + planes(coded, wide)
                    + planes(code, 4)
                    + rk[at].astype("<i8").tobytes()
                    + own[at].astype("<i8").tobytes()
                    + spans.first[at].astype("<i4").tobytes()
                    + planes(shared, 4)
                    + np.minimum(weight[at[shared]], 2).astype("<i4").tobytes()
                    + one[at[shared]].astype("<i8").tobytes()
                    + two[at[shared]].astype("<i8").tobytes()
                )
                out.append((int(part[at[0]]), CONTENTS, None, None, None, data))
            yield from packed_batches(out)

    return run


def _unpacked(blobs: list[bytes]):
    """(words, sizes) of the spans of a part, (span, rk, own, first) of its entries, and (entry,
    owners, one, two) of those that stand for shared spans."""
    held: list[list] = [[] for _ in range(10)]
    spans = entries = 0
    for data in blobs:
        n, known, total, wide, m, h = struct.unpack_from("<iiiiii", data)
        size, at = from_planes(data, 24, n, 4)
        words, at = np.frombuffer(data, "<u8", known, at), at + 8 * known
        coded, at = from_planes(data, at, total, wide)
        code, at = from_planes(data, at, m, 4)
        values = [words[coded], size, code + spans, np.frombuffer(data, "<i8", m, at), np.frombuffer(data, "<i8", m, at + 8 * m), np.frombuffer(data, "<i4", m, at + 16 * m)]
        shared, at = from_planes(data, at + 20 * m, h, 4)
        values += [shared + entries, np.frombuffer(data, "<i4", h, at), np.frombuffer(data, "<i8", h, at + 4 * h), np.frombuffer(data, "<i8", h, at + 12 * h)]
        for x, y in zip(held, values):
            x.append(y)
        spans, entries = spans + n, entries + m
    return [np.concatenate(x) for x in held]


def _search(windows: Windows):
    def shard(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, size, span, rk, own, first, shared, owners, one, two = _unpacked(blobs)
        group, head = folded(words, size)
        entry = group[span]
        begin, size = (np.cumsum(size) - size)[head], size[head]
        _, codes = np.unique(words[gathered(begin, size)], return_inverse=True)
        place = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.int64)
        text[gathered(place, size)] = codes + 1
        weight = np.ones(len(entry), np.int64)
        weight[shared] = owners
        index = FMIndex(text, windows.length, np.repeat(np.bincount(entry, weight, minlength=len(size)) > 1, size + 1))
        n = size - windows.length + 1
        start = gathered(place, n)
        hit = np.concatenate([index.repeated(text, start[a : a + _STREAM], windows.length) for a in range(0, len(start), _STREAM)])
        # runs of hit windows, as intervals of the span
        of, inside = np.repeat(np.arange(len(n)), n)[hit], (start - np.repeat(place, n))[hit]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (inside[1:] > inside[:-1] + windows.length)
        run = np.flatnonzero(new)
        last = np.append(run[1:] - 1, len(of) - 1)[: len(run)]
        of, low, high = of[run], inside[run], inside[last] + windows.length
        times = np.bincount(of, minlength=len(n))
        begins = np.cumsum(times) - times
        # of every text that has the span by itself
        alone = np.ones(len(entry), bool)
        alone[shared] = False
        alone = np.flatnonzero(alone)
        each = gathered(begins[entry[alone]], times[entry[alone]])
        who = np.repeat(alone, times[entry[alone]])
        yield from settled_batches(interval_rows(rk[who], own[who], first[who] + low[each], first[who] + high[each]))
        # and once of every shared span
        order = np.lexsort((two, one))
        verdicts = []
        for a, _ in runs_of(one[order], two[order]):
            i = order[a]
            g = entry[shared[i]]
            if times[g]:
                at = slice(begins[g], begins[g] + times[g])
                verdicts.append((VERDICTS, int(one[i]), int(two[i]), None, np.stack([low[at], high[at]], axis=1).astype("<i4").tobytes()))
        yield from settled_batches(verdicts)

    return shard


def _same_for_all(own: np.ndarray, verdict: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every owner of a shared span loses the span's intervals."""
    low, high = np.frombuffer(verdict, "<i4").reshape(-1, 2).T
    return np.repeat(np.arange(len(own)), len(low)), np.tile(low, len(own)), np.tile(high, len(own))


def _keep_words(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            cut = split_words(batch.column("text"))
            starts = cut.starts
            stay = ~covered(starts, batch.column("found"))
            kept = np.concatenate([[0], np.cumsum(stay)])[starts]
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), cut.words.filter(pa.array(stay)).cast(pa.string()))
            joined = pc.binary_join(lists, " ")
            column = joined if texts else pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined.to_pylist()], pa.string())
            total = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(total - np.diff(kept), pa.int64()), column.cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeated_words(
    docs: DataFrame, length: int = 50, gram: int | None = None, texts: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each row of ``docs``.

    Each word that a window of ``length`` words covers goes if the window occurs anywhere else,
    in the same text included. kept is what stays, joined by one space, or with ``texts`` false
    its SHA-256 in hex. ``gram`` is the length of the grams that anchor windows.

    Defined cases: a null or empty text has no words; every row is a text of its own, whether
    it has an id, shares it, or is equal to another; words are compared by 64-bit hashes, and spans
    of anchors that very many have are told apart by 128-bit digests; an
    empty table gives an empty table; other columns are left unread.
    """
    windows = Windows("words", length, gram or max(1, length // 3))
    rows = keyed(docs, id_col, text_col)
    open_ = candidates(rows, windows)
    packed = open_.rows.mapInArrow(_span_rows(windows, open_.parts, open_.hot), PACKED)
    intervals = settled(packed, open_.parts, _search(windows), _same_for_all, len(open_.hot) > 0)
    out = gathered_rows(rows, intervals, "left").select("doc_id", "text", "found")
    return out.mapInArrow(_keep_words(texts), "doc_id long, n_words long, n_removed long, kept string")
