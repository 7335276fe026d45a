import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from brute import words
from cases import frame, texts
from tessella.llm import fmindex, repeats, suffixes


def brute_words(rows, length):
    cut, times = [(d, words(t)) for d, t in rows], defaultdict(int)
    for d, w in cut:
        for i in range(len(w) - length + 1):
            times[tuple(w[i : i + length])] += 1
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if times[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    cut, first = [(d, (t or "").encode()) for d, t in rows], {}
    for d, b in cut:
        for i in range(len(b) - length + 1) if d is not None else ():
            k = b[i : i + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, b in cut:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def both(rows):
    return [(t[0], t[1]) for t in rows]


@pytest.mark.parametrize("slice_", [1 << 21, 300])
def test_words(spark, monkeypatch, slice_):
    monkeypatch.setattr(repeats, "SLICE", slice_)
    monkeypatch.setattr(fmindex, "SLICE", slice_)
    got = fmindex.remove_repeated_words(frame(spark, texts()), length=12, gram=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(both(texts()), 12)


@pytest.mark.parametrize("slice_", [1 << 21, 300])
def test_bytes(spark, monkeypatch, slice_):
    monkeypatch.setattr(repeats, "SLICE", slice_)
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    got = suffixes.remove_repeated_bytes(frame(spark, texts()), length=30, gram=12).collect()
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=str) == brute_bytes(both(texts()), 30)


def test_few_symbols_have_many_overlaps(spark):
    r = random.Random(9)
    rows = [(d, " ".join(r.choice("ab") for _ in range(r.randint(0, 90))), *texts()[0][2:]) for d in range(30)]
    got = fmindex.remove_repeated_words(frame(spark, rows), length=8, gram=3).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_words(both(rows), 8)
    got = suffixes.remove_repeated_bytes(frame(spark, rows), length=14, gram=6).collect()
    assert sorted(((*x[:4], bytes(x[4])) for x in got), key=str) == brute_bytes(both(rows), 14)


@pytest.mark.parametrize("piece", [40, 1 << 17])
def test_spans_of_a_text_of_many_pieces(monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    r = np.random.default_rng(6)
    values = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    values[700:800] = values[10:110]
    spans = repeats.spans_of(repeats.Units(values, np.array([0, 5, 900, 1000])), repeats.Windows("words", 30, 12))
    assert np.all(np.diff(spans.text * 10_000 + spans.first) > 0)
    windows = [(t, i) for t, a, m in zip(spans.text.tolist(), spans.first.tolist(), spans.more.tolist()) for i in range(a, a + m + 1)]
    assert windows == [(1, i) for i in range(895 - 29)] + [(2, i) for i in range(100 - 29)]
    assert np.all((spans.more <= spans.at) & (spans.at <= 18))
    # the repeat is within text 1: places 5..105 and 695..795
    found = [(int(a), int(f + p)) for t, a, f, p in zip(spans.text, spans.anchor, spans.first, spans.at) if t == 1]
    low, high = ({(a, p - at) for a, p in found if at + 18 <= p < at + 70} for at in (5, 695))
    assert low and low == high


@pytest.mark.parametrize("hot", [1, 5])
def test_hot_anchors_are_cut_and_still_meet(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(11)
    passage, filler = [f"p{i}" for i in range(14)], [f"f{i}" for i in range(6)]
    rows = [(d, " ".join(r.choices(filler, k=r.randint(0, 30)) + passage + r.choices(filler, k=r.randint(0, 30))), *texts()[0][2:]) for d in range(60)]
    got = fmindex.remove_repeated_words(frame(spark, rows + texts()), length=12, gram=4).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_words(both(rows + texts()), 12)
    got = suffixes.remove_repeated_bytes(frame(spark, rows + texts()), length=30, gram=12).collect()
    assert sorted(((*x[:4], bytes(x[4])) for x in got), key=str) == brute_bytes(both(rows + texts()), 30)


def shared_passage(n=300):
    r = random.Random(12)
    passage = [f"p{i}" for i in range(20)]
    return [(d, " ".join([f"u{r.random()}" for _ in range(r.randint(3, 9))] + passage + [f"v{r.random()}" for _ in range(r.randint(3, 9))]), *texts()[0][2:]) for d in range(n)]


@pytest.mark.parametrize("slice_", [1 << 21, 2000])
def test_owners_of_a_shared_passage_are_dealt_out(spark, monkeypatch, slice_):
    for m in (repeats, fmindex, suffixes):
        monkeypatch.setattr(m, "SLICE", slice_)
    monkeypatch.setattr(repeats, "HOT", 20)
    rows = shared_passage()
    docs = frame(spark, rows).repartition(6)
    got = fmindex.remove_repeated_words(docs, length=12, gram=4).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_words(both(rows), 12)
    got = suffixes.remove_repeated_bytes(docs, length=30, gram=12).collect()
    assert sorted(((*x[:4], bytes(x[4])) for x in got), key=str) == brute_bytes(both(rows), 30)
    for windows, pack, keyed in ((repeats.Windows("words", 12, 4), fmindex._span_rows, 0), (repeats.Windows("bytes", 30, 12), suffixes._runs, 1)):
        open_ = repeats.candidates(repeats.keyed(docs, "doc_id", "text"), windows)
        assert len(open_.hot)
        sent = open_.rows.repartition(6).mapInArrow(pack(windows, open_.parts, open_.hot), repeats.PACKED).collect()
        owners = [(x.part, x.one, len(x.data) // 8) for x in sent if x.kind == repeats.OWNERS]
        contents = [x for x in sent if x.kind == repeats.CONTENTS]
        spans = len({o for _, o, _ in owners})
        assert sum(n for *_, n in owners) >= len(rows)
        # a task sends a content to its shard twice at most (words), or as often as a smaller id turns up
        assert sum(len(x.data) for x in contents) < 6 * 2 * spans * (400 if keyed else 600) * (1 if slice_ > 2000 else 4)
        if slice_ == 2000:  # and the owners go to many parts
            assert len({p for p, *_ in owners}) > 1


def test_a_text_beyond_24_bit_places(spark):
    r = np.random.default_rng(8)
    long = r.integers(97, 123, (1 << 24) + 5000).astype(np.uint8).tobytes().decode()
    rows = [(1, long[-700:-400], *texts()[0][2:]), (2, long, *texts()[0][2:]), (3, "x" + long[5000:5300], *texts()[0][2:])]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.remove_repeated_bytes(frame(spark, rows), texts=False).collect()}
    assert got == {1: (300, 0, 0), 2: (len(long), 300, 1), 3: (301, 300, 1)}


def test_digests_and_empty_tables(spark):
    rows = texts()[:6]
    got = fmindex.remove_repeated_words(frame(spark, rows), 12, 4, texts=False).collect()
    assert sorted(r.kept for r in got) == sorted(hashlib.sha256(x[3].encode()).hexdigest() for x in brute_words(both(rows), 12))
    assert fmindex.remove_repeated_words(frame(spark, []), 12).count() == 0
    assert suffixes.remove_repeated_bytes(frame(spark, []), 12).count() == 0


@pytest.mark.parametrize("symbols", [4, 900])
def test_index_counts_like_a_scan(symbols):
    r = np.random.default_rng(2)
    parts = [np.concatenate([r.integers(1, symbols, 40), [0]]) for _ in range(10)]
    parts.append(parts[3][5:])
    text, twice = np.concatenate(parts), np.repeat(np.arange(11) == 7, [len(p) for p in parts])
    index = fmindex.FMIndex(text, 6, twice)
    start = np.array([i for i in range(len(text) - 6) if 0 not in text[i : i + 6]])
    windows = [tuple(text[i : i + 6]) for i in start]
    times = {}
    for i, w in zip(start, windows):
        times[w] = times.get(w, 0) + 1 + int(twice[i])
    assert index.repeated(text, start, 6).tolist() == [times[w] > 1 for w in windows]


def test_equal_rows_fold_and_like_hashes_do_not():
    flat = np.array([1, 2, 3, 1, 2, 1, 2, 3, 2, 1, 1, 2], np.uint64)
    group, first = fmindex.folded(flat, np.array([3, 2, 3, 2, 2]))
    assert group.tolist() == [0, 1, 0, 2, 1] and first.tolist() == [0, 1, 3]


def test_wavelet_ranks():
    r = np.random.default_rng(3)
    for values in (r.integers(0, 77, 1000), (r.pareto(1.0, 5000) % 300).astype(np.int64), np.full(70_000, 5), np.array([3])):
        tree = fmindex.WaveletTree(values, int(values.max()))
        v, at = r.choice(values, 200), r.integers(0, len(values) + 1, 200)
        want = [int((values[:a] == x).sum()) for x, a in zip(v, at)]
        assert tree.rank(v, at, at // 2).tolist() == [want, [int((values[: a // 2] == x).sum()) for x, a in zip(v, at)]]
        share = np.bincount(values) / len(values)
        entropy = -sum(p * np.log2(p) for p in share[share > 0])
        assert sum(len(w) for w in tree.words) * 64 <= len(values) * (entropy + 1) + 130 * len(tree.words)


def test_loser_tree_merges_and_shares():
    r = random.Random(4)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(n)) for n in (0, 1, 7, 20, 33)]
    coded = []
    for k, run in enumerate(runs):
        last = b""
        coded.append([])
        for s in run:
            coded[-1].append((s, suffixes.common(last, s, 0), k))
            last = s
    out = list(suffixes.LoserTree([iter(c) for c in coded]))
    assert [s for s, *_ in out] == sorted(s for run in runs for s in run)
    assert [h for _, h, _ in out] == [suffixes.common(a, b[0], 0) for a, b in zip([b""] + [s for s, *_ in out], out)]
