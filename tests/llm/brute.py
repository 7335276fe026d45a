"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def near_duplicates(rows, n, numerator, denominator):
    """{doc_id: (n_shingles, component_id)} by comparing every pair."""
    sets = {d: shingles(t, n) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and denominator * min(len(x), len(y)) >= numerator * max(len(x), len(y)):
                both = len(x & y)
                if denominator * both >= numerator * (len(x) + len(y) - both):
                    r, s = find(a), find(b)
                    root[max(r, s)] = min(r, s)
    return {d: (len(sets[d]), find(d)) for d in ids}
