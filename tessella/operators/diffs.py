"""Word differences of two texts: aligned runs, phrases put together, their context, and their share.

A pair's alignment is a longest common subsequence in bit-parallel rows: a row is one integer
whose bits say where the common length rises, so that a table of n x m cells is n additions. What
Spark holds is a row a pair; pairs are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a side beyond which texts aren't aligned, words of context, and white space.
MOST_TOKENS, CONTEXT = 1200, 5
_SPACE = "[\\t\\n\\v\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_CUT = re.compile(f"({_SPACE}+)")
_BLANK = re.compile(f"{_SPACE}*")
_TAIL = re.compile(f"{_SPACE}+$")

Runs = list[tuple[str, str]]


def tokens(text: str) -> list[str]:
    """Words and the white space between them, in turn."""
    return [t for t in _CUT.split(text) if t]


def _words(text: str) -> int:
    return sum(1 for t in tokens(text) if not _BLANK.fullmatch(t))


def diff_words(before: str, after: str, most: int = MOST_TOKENS) -> Runs | None:
    """Runs ('same', 'del' or 'ins'; text); null if a side has more than ``most`` tokens.

    Where both a deletion and an insertion keep the longest subsequence the deletion comes first.
    """
    a, b = tokens(before), tokens(after)
    if len(a) > most or len(b) > most:
        return None
    m = len(b)
    every = (1 << m) - 1
    at: dict[str, int] = {}
    for j, t in enumerate(reversed(b)):
        at[t] = at.get(t, 0) | 1 << j
    rows = [every]  # rows[k]: zeros where the common length of a's last k tokens and b's last ones rises
    for t in reversed(a):
        v = rows[-1]
        u = v & at.get(t, 0)
        rows.append(((v + u) | (v - u)) & every)

    def common(i: int, j: int) -> int:
        low = (1 << (m - j)) - 1
        return (m - j) - (rows[len(a) - i] & low).bit_count()

    found: list[list[str]] = []

    def push(op: str, text: str) -> None:
        if found and found[-1][0] == op:
            found[-1].append(text)
        else:
            found.append([op, text])

    i = j = 0
    while i < len(a) and j < m:
        if a[i] == b[j]:
            push("same", a[i])
            i, j = i + 1, j + 1
        elif common(i + 1, j) >= common(i, j + 1):
            push("del", a[i])
            i += 1
        else:
            push("ins", b[j])
            j += 1
    for t in a[i:]:
        push("del", t)
    for t in b[j:]:
        push("ins", t)
    return [(op, "".join(text)) for op, *text in found]


def coalesced(runs: Runs) -> Runs:
    """Neighbouring changes as one deletion and one insertion.

    White space between changes belongs to both; what both end with goes back to the same text.
    """
    out: Runs = []
    gone = come = ""

    def flush() -> None:
        nonlocal gone, come
        tails = [x.group() if (x := _TAIL.search(t)) else "" for t in (gone, come)]
        tail = tails[0] if tails[0] == tails[1] else ""
        keep = len(tail)
        for op, text in (("del", gone[: len(gone) - keep]), ("ins", come[: len(come) - keep]), ("same", tail)):
            if text:
                out.append((op, text))
        gone = come = ""

    for op, text in runs:
        if op == "del":
            gone += text
        elif op == "ins":
            come += text
        elif (gone or come) and _BLANK.fullmatch(text):
            gone, come = gone + text, come + text
        else:
            flush()
            out.append((op, text))
    flush()
    return out


def _clip(text: str, n: int, start: bool) -> tuple[str, bool]:
    """The first or last ``n`` words of a text with the space among them, and whether that cuts it."""
    parts = tokens(text)
    if _words(text) <= n:
        return text, False
    kept, seen = [], 0
    for t in parts if start else reversed(parts):
        if not _BLANK.fullmatch(t):
            if seen == n:
                break
            seen += 1
        kept.append(t)
    return "".join(kept if start else reversed(kept)), True


def focused(runs: Runs, context: int = CONTEXT) -> Runs:
    """Changes with a few words around, ' … ' for the rest; without changes the runs as they are."""
    changed = [i for i, (op, _) in enumerate(runs) if op != "same"]
    if not changed:
        return runs
    out: Runs = []
    for i, (op, text) in enumerate(runs):
        if op == "same":
            head, cut = _clip(text, context, True)
            tail, _ = _clip(text, context, False)
            if cut:
                text = (head if i > changed[0] else "") + " … " + (tail if i < changed[-1] else "")
        out.append((op, text))
    return out


def substitution_share(runs: Runs | None) -> float | None:
    """The share of the new text's words that are inserted; null without an alignment."""
    if runs is None:
        return None
    kept, added = (sum(_words(t) for op, t in runs if op == want) for want in ("same", "ins"))
    return added / (kept + added) if kept + added else 0.0


_RUNS = "array<struct<op:string,text:string>>"


def word_diffs(pairs: DataFrame, context: int = CONTEXT, most: int = MOST_TOKENS) -> DataFrame:
    """``pairs`` (id, before, after) as rows (id, phrases, focus, share): coalesced changes, these
    with their context, and the substitution share; all null for a null text or one of more than
    ``most`` tokens, which isn't aligned."""
    kind = dict(pairs.dtypes)["id"]
    struct = pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if x is None or y is None else diff_words(x, y, most) for x, y in zip(b.column("before").to_pylist(), b.column("after").to_pylist())]
            phrases = [None if r is None else coalesced(r) for r in raw]
            listed = lambda rows: pa.array([None if r is None else [{"op": o, "text": t} for o, t in r] for r in rows], struct)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), listed(phrases), listed([None if p is None else focused(p, context) for p in phrases]), pa.array([substitution_share(r) for r in raw], pa.float64())],
                ["id", "phrases", "focus", "share"],
            )

    return pairs.select("id", "before", "after").mapInArrow(run, f"id {kind}, phrases {_RUNS}, focus {_RUNS}, share double")


def changed_phrases(op: str) -> Column:
    """Of the column ``phrases``, the texts of one kind of change, in order."""
    return F.transform(F.filter("phrases", lambda r: r["op"] == op), lambda r: r["text"])
