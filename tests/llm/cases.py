"""Rows that every operator on documents has to stand: nulls, empty and long texts, ties, repeats."""

import random

#: Clashing names: columns that operators use inside, and that must not matter.
DDL = "doc_id long, text string, lang string, source string, n_chars long, part int, rk long, found string, n_words long, key long, `__text` string, ids string"
EXTRA = (1, 2, "f", 3, 4, "t", "i")


def row(d, text, source="a"):
    return (d, text, "en", source, None if text is None else len(text), *EXTRA)


def texts(seed=5, n=24):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "ep silon", "zeta\tx", "日本語", "😀", "THETA", "iota!"]
    base = " ".join(r.choice(words) for _ in range(200))
    out = [row(d, base[r.randint(0, 60) :] if d % 3 else " ".join(r.choice(words) for _ in range(r.randint(0, 120))), f"s{d % 4}") for d in range(n)]
    return out + [
        row(n, None, None),
        row(n + 1, ""),
        row(n + 2, "  \n\t "),
        row(n + 3, "x" * 30_000),
        row(n + 4, base * 20, None),
        row(n + 5, base * 20, "b"),
        row(n + 5, base * 20, "b"),
        row(n + 5, "another text of the same id", "b"),
        row(None, base, "b"),
        row(None, None, "b"),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)
