import random
import re
from collections import Counter

import numpy as np

from brute import words
from cases import frame, texts
from tessella.llm import rules


def counts(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(repeat)


def test_counts(spark):
    lines = [(40, "a b c\na b c\n\n\n  \na b c d\r\nx | <y> ## a b c", "", "", 0, *texts()[0][5:]), (41, "q q q q", "", "", 0, *texts()[0][5:])]
    got = rules.statistics(frame(spark, texts() + lines)).collect()
    want = [(t[0], *counts(t[1])) for t in texts() + lines]
    assert sorted(((r.doc_id, *[r[c] for c in rules.COUNTS[:5]]) for r in got), key=str) == sorted(want, key=str)


def test_learns_a_planted_list():
    r = np.random.default_rng(1)
    n = 600
    table = {k: r.uniform(size=n) for k in rules.STATISTICS}
    bad = (table["symbol_rate"] > 0.7) & (table["mean_word"] < 0.5) | (table["mark_rate"] > 0.9)
    found = rules.learn(table, bad, r.uniform(size=n) < 0.67)
    hit = np.zeros(n, bool)
    for rule in found:
        hit |= rules._covered(rule, table, n)
    assert (hit == bad).mean() > 0.95 and found


def test_no_rule_from_noise():
    r = np.random.default_rng(2)
    table = {k: r.uniform(size=300) for k in rules.STATISTICS}
    found = rules.learn(table, r.uniform(size=300) < 0.1, r.uniform(size=300) < 0.67)
    hit = np.zeros(300, bool)
    for rule in found:
        hit |= rules._covered(rule, table, 300)
    assert hit.mean() < 0.05


def labelled(spark):
    r = random.Random(3)
    rows, labels = [], []
    for d in range(120):
        junk = d % 4 == 0
        text = " ".join(("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) + ("***" if junk else "")) for _ in range(80))
        rows.append((d, text, "", "", 0, *texts()[0][5:]))
        labels.append((d, 0 if junk else 1, "x"))
    more = [(900, None, ""), (None, 1, ""), (901, 0, "")]
    return frame(spark, rows), spark.createDataFrame(labels + more, "doc_id long, quality int, text string")


def test_judges_held_out_documents(spark):
    docs, labels = labelled(spark)
    judged = rules.judge(docs, labels.where("doc_id < 80 OR doc_id IS NULL")).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in judged) and not any(r.base_failed for r in judged)


def test_filter_keeps_rows_as_they_are(spark):
    docs, labels = labelled(spark)
    kept = rules.filter_documents(docs.unionByName(frame(spark, texts()).where("doc_id IS NULL OR text IS NULL OR text = ''")), labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} >= {d for d in range(120) if d % 4}
    assert not {r.doc_id for r in kept.collect()} & {d for d in range(120) if d % 4 == 0} - {24}


def test_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = rules.judge(frame(spark, texts()), none).collect()
    assert all(r.kept != r.base_failed for r in judged) and len(judged) == len(texts())
    assert rules.judge(frame(spark, []), none).count() == 0


def test_rules_are_one_case_expression():
    rule = [rules.Condition("symbol_rate", True, 0.5), rules.Condition("mean_word", False, 3.0)]
    assert rule[0].sql() == "n_symbols / greatest(n_words, 1) >= 0.5D"


def test_rows_of_one_labelled_id_are_bounded(spark, monkeypatch):
    seen = []
    learn = rules.learn
    monkeypatch.setattr(rules, "learn", lambda table, bad, split: seen.append(len(bad)) or learn(table, bad, split))
    counts = spark.range(5000).selectExpr("CAST(id % 2 AS LONG) AS doc_id", *[f"CAST(10 + id % 997 AS LONG) AS {c}" for c in rules.COUNTS])
    labelled = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    rules.fit(counts, labelled, most_rows=100)
    assert seen == [200]
    same = spark.range(5000).selectExpr("0L AS doc_id", *[f"10L AS {c}" for c in rules.COUNTS])
    rules.fit(same, labelled, most_rows=100)
    assert seen == [200, 1]
