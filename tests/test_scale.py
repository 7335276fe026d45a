"""What large tables ask for: few copies of rows in written tables and shuffles."""

import pytest

from tessella.operators import answering, graph, mining, paths, portable, topology, validation, verdicts
from tessella.plans import fixtures
from tessella.plans.fixtures import World


@pytest.fixture
def spy(monkeypatch):
    """Names and rows of the tables that a module writes."""

    def watch(module):
        seen, real = [], module.written
        monkeypatch.setattr(module, "written", lambda df, name: seen.append((name, out := real(df, name))) or out)
        return seen

    return watch


EDGES = "id string, from_id string, to_id string, weight double, confidence double, evidence array<string>, quarantined boolean, sigma string"


def edges(spark, n=20):
    return spark.createDataFrame([(f"e{i}", f"n{i % 7}", f"m{i % 5}", 0.5, 0.9, ["x"], False, "factual") for i in range(n)], EDGES)


def test_path_search_reads_paths_once_and_lines_once(spark, spy, sf):
    seen = spy(verdicts)
    w = World(spark, sf).settled()
    verdicts.path_verdicts(w.answer_paths(), w.trade_edges(), most_hops=1)
    assert "paths" in [name for name, _ in seen]
    assert "lineitem" not in w.trade_edges()._jdf.queryExecution().optimizedPlan().toString()


def test_links_stay_in_place(spark, spy):
    seen = spy(topology)
    nodes = spark.createDataFrame([(f"n{i}", None, i) for i in range(7)] + [(f"m{i}", "n0", i) for i in range(5)], "id string, parent_id string, place int")
    mentions, held = spark.createDataFrame([("n1", "m1"), ("n1", "gone"), ("gone", "m1")], "id string, passage_id string"), spark.createDataFrame([("n2", "m2")], "id string, asset_id string")
    found = topology.topology_links(nodes, edges(spark), mentions, held)
    got = sorted((r.link, r.a, r.b) for r in found.collect())
    assert [x for x in got if x[0] == "mention"] == [("mention", "n1", "m1")]
    assert [x for x in got if x[0] == "sibling"] == [("sibling", f"m{i}", f"m{i + 1}") for i in range(4)]
    rows = {name: t.count() for name, t in seen}
    assert rows["unknown"] == 1 and "ranks" not in rows and "ranged" not in rows


def test_diffusion_writes_a_link_once(spark, spy):
    seen = spy(paths)
    features = spark.createDataFrame([("n0", [1.0, 2.0]), ("n1", [3.0]), ("m0", [5.0, 1.0]), ("m1", []), ("m2", None)], "id string, v array<double>")
    links = edges(spark).select("id", "from_id", "to_id", "weight")
    got = {r.id: r.v for r in paths.diffused(features, links, rounds=2).collect()}
    assert [t.count() for name, t in seen if name == "weights"] == [20]
    assert got == {r.id: r.v for r in _apart(features, links, 2)}


def _apart(features, links, rounds, alpha=0.45):
    """The same, a component a row."""
    from pyspark.sql import functions as F

    from tessella.operators.graph import incidence

    near, state = incidence(links).select("id", "other", "weight"), features
    for _ in range(rounds):
        sent = near.join(state.select(F.col("id").alias("other"), F.posexplode("v").alias("k", "x")), "other")
        mean = sent.groupBy("id", "k").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("m")).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("m"))
        mixed = F.when(F.col("m").isNull(), F.col("v")).otherwise(F.zip_with("v", "m", lambda a, b: a * (1 - alpha) + b * alpha))
        state = state.join(mean, "id", "left").select("id", mixed.alias("v"))
    return state.collect()


def test_power_iteration_writes_few_states(spark, spy):
    seen = spy(paths)
    assert paths.centrality(edges(spark), rounds=16).count() == 12
    assert len([name for name, _ in seen if name == "centrality"]) == 2


def test_world_is_written_once(spark, spy, sf):
    seen = spy(fixtures)
    w = World(spark, sf).settled()
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t in (w.edges(), w.passages(), *w.faulty().values())]
    assert [name for name, _ in seen] == ["lines", "texts", "sources", "entities"] and not [p for p in plans if "l_linestatus" in p or "l_extendedprice" in p]
    for name in ("edges", "passages", "line_texts", "trade_edges"):
        assert sorted(map(str, getattr(w, name)().collect())) == sorted(map(str, getattr(World(spark, sf), name)().collect()))


def test_few_references_go_back_to_their_rows(spark, spy):
    seen = spy(validation)
    rows = spark.createDataFrame([(f"e{i}", "gone" if i % 2 else None if i % 3 == 0 else "here") for i in range(12)], "id string, ref string")
    got = {r.id for r in validation.unresolved([("x", rows, rows.ref)], spark.createDataFrame([("here",)], "id string")).collect()}
    assert got == {f"e{i}" for i in range(12) if i % 2 or i % 3 == 0}
    assert [(name, t.count()) for name, t in seen] == [("unmet", 2)]


def test_equal_questions_are_answered_once(spark, spy, monkeypatch):
    entities = spark.createDataFrame([("a", "red pipe pipe", 0.5), ("b", "red pipe", 0.9), ("c", "long red iron pipe bent twice over", 0.1), ("d", "red", 0.9), ("e", "red", 0.9)], "id string, label string, centrality double")
    texts = ["red pipe", "the red pipe", "iron bent", "red", "blue", None, "Red?"]
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "question string, text string")
    want = {"q0": ("a", 11.5), "q1": ("a", 11.5), "q2": ("c", 8.1), "q3": ("b", 3.9), "q6": ("b", 3.9)}
    for most in (8, 3, 1, 0):
        monkeypatch.setattr(answering, "SUBSETS", most)
        assert {r.question: (r.id, r.score) for r in answering.best_entities(asked, entities).collect()} == want
    seen = spy(answering)
    w = World(spark, "/root/testdata/sf0.001").settled()
    t = w.rendering()
    many = spark.createDataFrame([(f"q{i}", "What did Supplier#000000001 buy?" if i % 2 else None) for i in range(9)], "question string, text string")
    got = answering.answered(many, t["entities"], t["edges"], t["passages"], t["facts"], answering.asset_tokens(t["passages"], t["assets"])).collect()
    assert len(got) == 9 and len({r.focus for r in got}) == 2 and [x.count() for name, x in seen if name == "texts"] == [2]


def test_pairs_of_passages_meet_edges(spark, spy, monkeypatch):
    seen = spy(graph)
    e = spark.createDataFrame([("e1", "a", "b", "p1"), ("e2", "a", "c", "p1"), ("e3", "a", "a", "p1")], "id string, from_id string, to_id string, primary string")
    said = spark.createDataFrame([(n, p, i) for i, p in enumerate(("p1", "p3", "p2")) for n in "ab"] + [("c", "p1", 0), ("a", "p4", 9)], "id string, passage_id string, seq int")
    want = [("e1", "p3"), ("e3", "p3")]
    for most in (64, 2, 1, 0):
        monkeypatch.setattr(graph, "PAIRED", most, raising=False)
        assert sorted(map(tuple, graph.corroborated(e, said).collect())) == want
    assert [name for name, _ in seen] == ["mentions"] * 4


def test_import_makes_what_is_asked_for(spark, spy):
    w = World(spark, "/root/testdata/sf0.001").settled()
    store, unit = w.shelf("true"), w.shelf("k % 11 = 0")["mentions"].select("passage_id")
    artifact = portable.exported(store, unit)
    seen = spy(portable)
    after = portable.import_artifact(portable.import_artifact(w.destination(), artifact), artifact)
    assert not seen and set(after) == {"nodes", "edges", "mentions", "provenance"}
    assert after["edges"].count() and [name for name, _ in seen] == ["edges", "edges"]


def test_places_are_found_once(spark, spy):
    seen = spy(mining)
    labels = spark.createDataFrame([("t", "T", 0.0), ("a", "A", 0.5)], "id string, label string, centrality double")
    mentions = spark.createDataFrame([("a", "p", "x", 0)], "id string, passage_id string, asset_id string, seq int")
    places = spark.createDataFrame([("a", "t")] * 5, "id string, topic string")
    assert mining.summaries(labels, places, mentions, edges(spark), labels.drop("centrality")).count() == 1
    assert [(name, t.count()) for name, t in seen] == [("places", 1)]
