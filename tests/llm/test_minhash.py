import random

from brute import near_duplicates as brute
from tessella.llm import minhash


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, list string, node int")


def made(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    out = []
    for d in range(n):
        text = list(base) if d % 3 else [r.choice(words) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 4)):
            if text:
                text[r.randrange(len(text))] = r.choice(words)
        out.append((d, " ".join(text), "x", d))
    return out + [(n, None, None, None), (n + 1, "", "", 1), (n + 2, "one two", "", 1), (n + 3, "ONE  two", "", 1)]


def check(spark, rows, **kw):
    got = minhash.near_duplicates(rows_of(spark, rows), **kw).collect()
    want = brute([(d, t) for d, t, *_ in rows], kw.get("shingle", 5), *kw.get("similarity", (80, 100)))
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, n, c, d == c) for d, (n, c) in want.items()}
    assert len(got) == len(rows)


def test_matches_all_pairs(spark):
    check(spark, made(1, 90), shingle=3, similarity=(85, 100))
    check(spark, made(2, 60))


def test_long_lists_meet_leaders_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    check(spark, made(3, 80), shingle=3, similarity=(85, 100))


def test_small_table_of_the_driver(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85, 100)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    rows = rows_of(spark, [(5, text, "", 0), (5, other, "", 0), (3, other, "", 0), (9, text, "", 0), (None, text, "", 0)])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (9, 3, False), (None, None, True)], key=str)


def test_empty(spark):
    assert minhash.near_duplicates(rows_of(spark, [])).count() == 0


def test_sets_do_not_depend_on_the_slice():
    import pyarrow as pa

    texts = pa.array([" ".join(f"w{i * j % 37}" for j in range(40)) for i in range(30)] + [None, ""])
    whole = minhash.shingle_sets(texts, 5)
    for i in range(len(texts)):
        assert minhash.shingle_sets(texts.slice(i, 1), 5)[0].tolist() == whole[i].tolist()


def counted(monkeypatch):
    """The names of the tables that the operator writes from now on."""
    from tessella.llm import components

    names = []
    for module in (minhash, components):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: names.append(name) or f(df, name))
    return names


def test_writes_no_more_tables_than_steps_need(spark, monkeypatch):
    names = counted(monkeypatch)
    check(spark, made(4, 50), shingle=3, similarity=(85, 100))
    assert [x for x in names if x != "edges"] == ["sketches", "classes", "members", "facts", "texts", "groups", "stars", "links"]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    from tessella.llm.components import components

    names = counted(monkeypatch)
    links = lambda rows: {(r.node, r.component) for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert links([(3, 1), (1, 2), (3, 1), (9, 9), (None, 4), (6, 5)]) == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    assert names == ["links"]
    chain = list(range(1, 12))
    assert links([*zip(chain, chain[1:]), (30, 20), (21, 30)]) == {(x, 1) for x in chain} | {(x, 20) for x in (20, 21, 30)}
    assert "edges" in names and links([]) == set()


def test_pairs_of_a_leader_are_judged_as_in_blocks():
    import numpy as np

    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) > q], r.integers(0, 2**63, int(q * 150)).astype(np.uint64)])) for q in np.linspace(0, 0.6, 24)]
    sketches, sizes, every = [x[:48] for x in sets], np.array([len(x) for x in sets]), np.arange(len(sets))
    blocks = minhash.possible(sketches, sizes, every, every, 85, 100)
    for i in every:
        others = every[every != i]
        assert minhash.possible(sketches, sizes, every[i : i + 1], others, 85, 100)[0].tolist() == blocks[i, others].tolist()
    assert blocks.any() and not blocks.all()
