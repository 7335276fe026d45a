"""Labels of a vocabulary in passages: a trie in arrays, walked from all word starts of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .topology import indexed

#: Labels of one trie; a larger vocabulary takes several, each of which reads the passages once.
BLOCK = 50_000
#: Characters of words, as ranges of code points.
WORDY = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F))


def _wordy(codes: np.ndarray) -> np.ndarray:
    return np.any([(codes >= a) & (codes <= b) for a, b in WORDY], axis=0)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text begins, with the end last."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


@dataclass
class Trie:
    labels: list[str]
    keys: list[np.ndarray]  # a level each: node and character, sorted
    nodes: list[np.ndarray]  # the node that a key leads to
    ends: np.ndarray  # the label that ends at a node, or -1

    @staticmethod
    def of(labels: list[str]) -> Trie:
        """Levels are numbered one after the other: a node is a distinct pair of parent and character."""
        labels = sorted({x for x in labels if x})
        flat, begin = _codes(labels)
        size, at = np.diff(begin), np.zeros(len(labels), np.int64)
        keys, nodes, total = [], [], 1
        for level in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > level)
            found, which = np.unique(at[on] << 21 | flat[begin[on] + level], return_inverse=True)
            at[on] = total + which
            keys.append(found)
            nodes.append(total + np.arange(len(found)))
            total += len(found)
        ends = np.full(total, -1, np.int64)
        ends[at] = np.arange(len(labels))
        return Trie(labels, keys, nodes, ends)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, label, start, end, open) of labels in texts.

        A label begins after a character that isn't of a word, and ends before one. Bit 1 of
        ``open`` says that its beginning, bit 2 that its end only would be one beside a span that
        is taken away, which asks that the label itself begins, or ends, with no word's character.
        """
        flat, begin = _codes(texts)
        wordy = _wordy(flat)
        text = np.repeat(np.arange(len(texts)), np.diff(begin))
        first = np.ones(len(flat), bool)
        first[1:] = (text[1:] != text[:-1]) | ~wordy[:-1]
        start = np.flatnonzero(first | ~wordy)
        node = np.zeros(len(start), np.int64)
        found: list[np.ndarray] = []
        for level, (keys, nodes) in enumerate(zip(self.keys, self.nodes)):
            inside = start + level < begin[text[start] + 1]
            start, node = start[inside], node[inside]
            if not len(start):
                break
            key = node << 21 | flat[start + level]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[place] == key
            start, node = start[same], nodes[place[same]]
            done = np.flatnonzero(self.ends[node] >= 0)
            found.append(np.stack([start[done], np.full(len(done), level + 1), self.ends[node[done]]]))
        at, size, label = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        end = at + size
        last = end == begin[text[at] + 1]
        after = last | ~wordy[np.minimum(end, max(len(flat) - 1, 0))] if len(flat) else last
        good = after | ~wordy[end - 1]
        at, end, label, after = at[good], end[good], label[good], after[good]
        where = text[at]
        return where, label, at - begin[where], end - begin[where], (~first[at]).astype(np.int64) + 2 * (~after).astype(np.int64)


def taken(hits: list[tuple[str, int, int, int]]) -> list[str]:
    """Labels of one text, from hits (label, start, end, open): the longest first, then by name.

    A label takes the first of its hits that no taken span overlaps; spans are taken away, so
    shorter labels don't count inside, and their edges bound words.
    """
    by: dict[str, list[tuple[int, int, int]]] = {}
    for label, start, end, open_ in hits:
        by.setdefault(label, []).append((start, end, open_))
    gone: set[int] = set()
    out = []
    for label in sorted(by, key=lambda x: (-len(x), x)):
        for start, end, open_ in sorted(by[label]):
            if open_ & 1 and start - 1 not in gone or open_ & 2 and end not in gone:
                continue
            if gone.isdisjoint(range(start, end)):
                gone.update(range(start, end))
                out.append(label)
                break
    return out


def detected_mentions(passages: DataFrame, labels: DataFrame, block: int | None = None) -> DataFrame:
    """Rows (id, label): labels that passages (id, text) hold as whole words, the longest first.

    Each label counts once a passage; a found span is taken away, so that a label inside a longer
    one doesn't count there, and bounds words but is no text. Letters count as they are written.
    A vocabulary of any size is used in blocks: hits of all blocks meet by passage. A null text
    holds nothing, and passages that share an id are told apart.
    """
    block = block or BLOCK
    names = written(indexed(labels.select("label").where("label <> ''").distinct(), "label"), "labels")
    count = names.count()
    one = count <= block
    rows = passages.select("id", "text") if one else written(passages.select("id", "text").withColumn("row", F.monotonically_increasing_id()), "passages")
    kind = dict(passages.dtypes)["id"]
    parts = []
    for first in range(0, max(count, 1), block):
        trie = Trie.of([r["label"] for r in names.where(F.col("index").between(first, first + block - 1)).collect()])

        def find(batches: Iterator[pa.RecordBatch], trie: Trie = trie) -> Iterator[pa.RecordBatch]:
            for b in batches:
                where, label, start, end, open_ = trie.hits([t or "" for t in b.column("text").to_pylist()])
                names_ = [trie.labels[i] for i in label.tolist()]
                if one:
                    by: dict[int, list] = {}
                    for at, *hit in zip(where.tolist(), names_, start.tolist(), end.tolist(), open_.tolist()):
                        by.setdefault(at, []).append(hit)
                    kept = [(at, x) for at, hits in by.items() for x in taken(hits)]
                    at, found = pa.array([k for k, _ in kept], pa.int64()), [pa.array([x for _, x in kept], pa.string())]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), *found], ["id", "label"])
                else:
                    at = pa.array(where)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("row").take(at), pa.array(names_, pa.string()), pa.array(start), pa.array(end), pa.array(open_)], ["id", "row", "label", "start", "end", "open"])

        parts.append(rows.mapInArrow(find, f"id {kind}, label string" if one else f"id {kind}, row long, label string, start long, end long, open long"))
    if one:
        return parts[0]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)

    def settle(g: pa.Table) -> pa.Table:
        columns = [g.column(c).to_pylist() for c in ("label", "start", "end", "open")]
        found = taken(list(zip(*columns)))
        return pa.table({"id": g.column("id").take(pa.array([0] * len(found), pa.int64())), "label": pa.array(found, pa.string())})

    return hits.groupBy("row").applyInArrow(settle, f"id {kind}, label string")
