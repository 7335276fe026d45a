"""Labels in texts against the plain rule: longest first, whole words, spans taken away."""

import random

from tessella.operators import detection


def wordy(c):
    return any(a <= ord(c) <= b for a, b in detection.WORDY)


def plain(text, labels):
    text, out = text or "", set()
    for label in sorted({x for x in labels if x}, key=lambda x: (-len(x), x)):
        at = text.find(label)
        while at >= 0 and (at and wordy(text[at - 1]) or wordy(text[at + len(label) : at + len(label) + 1] or " ")):
            at = text.find(label, at + 1)
        if at >= 0:
            out.add(label)
            text = text[:at] + "\0" * len(label) + text[at + len(label) :]
    return out


def cases(seed, n):
    r = random.Random(seed)
    words = ["ab", "abc", "a", "b-a", "-", "é", "Éa", "日本", "😀", "ab ab", ".", "II", "c"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "", "-", ", "]) for _ in range(r.randint(0, 12))) for _ in range(n)]
    labels = words + ["".join(r.choice(words) + r.choice([" ", "-"]) for _ in range(2)).strip() for _ in range(30)] + [""]
    return texts, labels


def test_trie_equals_the_plain_rule():
    texts, labels = cases(1, 400)
    trie = detection.Trie.of(labels)
    by = {}
    for text, label, *rest in zip(*(x.tolist() for x in trie.hits(texts))):
        by.setdefault(text, []).append((trie.labels[label], *rest))
    for i, t in enumerate(texts):
        assert set(detection.taken(by.get(i, []))) == plain(t, labels), t


def test_one_block_and_several(spark):
    texts, labels = cases(2, 60)
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(7, None), (None, "ab c")]
    passages = spark.createDataFrame(rows, "id long, text string")
    known = spark.createDataFrame([(x,) for x in labels + labels + [None]], "label string")
    want = sorted((str(i), x) for i, t in rows for x in plain(t, labels))
    for block in (50_000, 9):
        assert sorted((str(r.id), r.label) for r in detection.detected_mentions(passages, known, block).collect()) == want
    assert detection.detected_mentions(passages, known.limit(0)).count() == 0
