"""Each stage of the pipeline on its own input, held against plain versions."""

import base64
from collections import Counter

import public_tokenizers as public
import pytest
import tiktoken

import corpus_pipeline
from brute import near_duplicates, words
from cases import frame, texts
from test_rules import counts
from test_secrets import base


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def test_columns_stay_those_of_documents(steps):
    assert all(x.schema.simpleString() == steps[0].schema.simpleString() for x in steps[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "mixing", "tokens"]


def test_quality_rejects_junk_and_keeps_clean_documents(spark, sf, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in steps[1].collect()}
    texts = {r.doc_id: r.text for r in steps[0].collect()}
    assert all(kept[d] == texts[d] for d in kept)
    heavy = {d for d in texts if 100 * counts(texts[d])[4] > 50 * counts(texts[d])[0]}
    good = [d for d, q in labels.items() if q == 1 and d not in heavy]
    bad = [d for d, q in labels.items() if q == 0]
    assert all(d in kept for d in good) and sum(d in kept for d in bad) <= 0.1 * len(bad) and not heavy & set(kept)


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {d for d, (_, c) in near_duplicates(rows, 5, 80, 100).items() if d == c}
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(want)


def test_secrets_are_gone(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    after = {r.doc_id: r.text for r in steps[3].collect()}
    assert before.keys() == after.keys()
    for d in before:
        found = base(before[d])
        assert (after[d] == before[d]) if not found else "[SECRET]" in after[d]
        assert not any(before[d][s:e] in after[d] for k, s, e in found if k != "assign")


def test_mix_repeats_and_drops_words_of_its_input(steps):
    source = {r.doc_id: Counter(words(r.text)) for r in steps[3].collect()}
    taken = {}
    for r in steps[4].collect():
        taken.setdefault(r.doc_id, Counter()).update(words(r.text))
    assert taken.keys() <= source.keys()
    assert all(n <= 3 * source[d][w] for d, c in taken.items() for w, n in c.items())
    assert sum(sum(c.values()) for c in taken.values()) == pytest.approx(sum(sum(c.values()) for c in source.values()), rel=0.05)


def test_tokens_are_the_librarys(steps):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in steps[4].collect())
    assert sorted((r.doc_id, r.ids) for r in steps[5].collect()) == want


@pytest.mark.parametrize("rows", [texts(), []], ids=["edge cases", "empty table"])
def test_stages_take_nulls_repeats_and_clashing_names(spark, sf, rows):
    docs = frame(spark, rows)
    key = lambda r: str(tuple(r))
    given = sorted(map(key, docs.collect()))
    apply = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    assert all(x.schema.simpleString() == docs.schema.simpleString() for name, x in apply.items() if name != "tokens")
    out = {name: x.collect() for name, x in apply.items()}
    assert not Counter(map(key, out["quality rules"])) - Counter(given)
    assert not Counter(map(key, out["near-duplicates"])) - Counter(given)
    wordless = lambda found: sum(not words(r.text) for r in found)
    assert wordless(out["near-duplicates"]) == sum(not words(t[1]) for t in rows) and wordless(out["mixing"]) == 0
    assert sorted(map(key, out["secret scan"])) == given  # these texts hold none
    ids = [r for r in out["tokens"] if r.n_tokens == 0]
    assert len(out["tokens"]) == len(rows) and len(ids) == sum(not t[1] for t in rows)
