import random
import zlib

import cases
import numpy as np

from tessella.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=240, seed=3):
    r = random.Random(seed)
    good = ["the sea was calm today", "we walked along the shore", "a lamp stood near the door", "rain fell over the hills", "she reads every evening"]
    bad = ["you are a zonkish fool", "what zonked rubbish is this", "such a zonkable grumple"]
    rows, labels = [], []
    for d in range(n):
        toxic = d % 4 == 0
        text = [r.choice(good) for _ in range(r.randint(1, 12))]
        if toxic:
            for _ in range(2):
                text.insert(r.randint(0, len(text)), r.choice(bad).upper() if d % 8 else r.choice(bad))
        rows.append(cases.row(d, ". ".join(text) + "!"))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_held_out_documents_and_their_sentences(spark):
    rows, labels = corpus()
    docs, known = cases.frame(spark, rows), spark.createDataFrame(labels, LABELS)
    truth = {d: y for d, _, y in labels}
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert {truth[r.doc_id] for r in held} == {0, 1}
    assert all(r.predicted == truth[r.doc_id] for r in held)
    model = toxicity.fit(docs, known)
    texts = {r[0]: r[1] for r in rows}
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == {d for d, y in truth.items() if y}
    for r in found:
        assert texts[r.doc_id][r.start : r.end] == r.sentence and ("zonk" in r.sentence.lower())
    again = toxicity.toxicity(docs, known).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(120)
    docs = cases.frame(spark, rows)
    turned = [(d, q, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, q, y in labels]
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, turned))
    assert a == b


def test_score_is_the_noisy_or_of_the_sentences(spark):
    rows, labels = corpus(80)
    docs = cases.frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    clean = {}
    for r in toxicity.offending_sentences(docs, model, least=0.0).collect():
        clean[r.doc_id] = clean.get(r.doc_id, 1.0) * (1 - r.score)
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - (1 - clean.get(r.doc_id, 1.0))) < 1e-9


def test_gradient_lowers_the_loss():
    y, other = np.array([1, 0, 1, 0]), np.array([2, 3, 0, 0])
    bag_of, sentence_of, entry = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 0, 2])
    w, b = toxicity.train(y, other, bag_of, sentence_of, entry, 3)
    z = b + np.bincount(sentence_of, w[entry], minlength=4)
    p = 1 - np.exp(-np.bincount(bag_of, np.logaddexp(0, z), minlength=4) - other * np.logaddexp(0, b))
    assert (p[y == 1] > 0.9).all() and (p[y == 0] < 0.1).all()


def test_edge_cases(spark):
    rows = cases.texts()
    labels = [(d, 1, d % 2) for d in range(24)] + [(3, 1, 0), (None, 1, 1), (5, None, None), (6, 1, 7), (900, 0, 1)]
    docs = cases.frame(spark, rows)
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    by = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert by[24] == by[25] == by[26] == 0  # null, empty, blank
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(rows) and max(r.score for r in none) < 0.3
    assert toxicity.toxicity(cases.frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_rows_of_one_labelled_id_are_bounded(spark, monkeypatch):
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda y, *a, **k: seen.append(len(y)) or train(y, *a, **k))
    rows, labels = corpus(80)
    many = cases.frame(spark, rows + [cases.row(1, f"a text of its own {i} shore") for i in range(3000)])
    toxicity.fit(many, spark.createDataFrame(labels, LABELS), most_rows=50)
    assert seen and seen[0] <= 50


def test_registered_query(spark, sf):
    from tessella.llm.queries import QUERIES

    rows = QUERIES["op11_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
