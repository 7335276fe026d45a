"""Alignments, phrases and focus of two texts against a plain table."""

import random

import pytest

from tessella.operators import diffs


def plain(before, after):
    a, b = diffs.tokens(before), diffs.tokens(after)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            op, text, i, j = "same", a[i], i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            op, text, i = "del", a[i], i + 1
        else:
            op, text, j = "ins", b[j], j + 1
        out = [*out[:-1], (op, out[-1][1] + text)] if out and out[-1][0] == op else [*out, (op, text)]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_rows_of_bits_align_as_the_table_does(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(["a", "b", "cc", " ", "  ", "\n", "é"]) for _ in range(r.randint(0, 60)))
    before, after = text(), text()
    got = diffs.diff_words(before, after)
    assert got == plain(before, after)
    for runs in (got, diffs.coalesced(got)):
        assert "".join(t for op, t in runs if op != "ins") == before
        assert "".join(t for op, t in runs if op != "del") == after
    kinds = [op for op, _ in diffs.coalesced(got)]
    assert not any(a == b != "same" for a, b in zip(kinds, kinds[1:]))


def test_phrases_and_focus():
    runs = diffs.diff_words("The applicant accepted it", "Tollstrand Battery accepted it")
    assert diffs.coalesced(runs) == [("del", "The applicant"), ("ins", "Tollstrand Battery"), ("same", " accepted it")]
    assert diffs.substitution_share(runs) == 0.5 and diffs.substitution_share(None) is None and diffs.substitution_share([]) == 0
    words = " ".join(f"w{i}" for i in range(20))
    found = diffs.focused(diffs.coalesced(diffs.diff_words(f"{words} old {words} x", f"{words} new {words} y")), 2)
    assert [t for _, t in found] == [" …  w18 w19 ", "old", "new", " w0 w1  …  w18 w19 ", "x", "y"]
    assert diffs.focused([("same", words)], 2) == [("same", words)]


def test_long_null_and_empty(spark):
    rows = [(1, "a b", "a c"), (2, None, "x"), (3, "w " * 601, "w"), (4, "", ""), (5, "w " * 600, "w"), (None, "", "x")]
    got = {r.id: r for r in diffs.word_diffs(spark.createDataFrame(rows, "id long, before string, after string")).collect()}
    assert [tuple(x) for x in got[1].phrases] == [("same", "a "), ("del", "b"), ("ins", "c")] and got[1].share == 0.5
    assert got[2].phrases is None and got[3].phrases is None and got[3].share is None
    assert got[4].phrases == [] and got[4].share == 0 and got[5].share == 0
    assert [tuple(x) for x in got[None].phrases] == [("ins", "x")]
