"""Ranks, neighbours and inherited values against plain versions; hashes that don't heed order."""

import random

from tessella.operators import layout, mining, topology, validation
from tessella.plans.fixtures import World


def test_ranks_and_neighbours(spark):
    r = random.Random(1)
    rows = [(f"g{r.randrange(4)}", r.randrange(20), f"i{i:03}") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, at int, id string").repartition(5)
    got = topology.indexed(df, "g", "at", "id").collect()
    assert [(x.g, x.at, x.id) for x in sorted(got, key=lambda x: x["index"])] == sorted(rows)
    assert sorted(x["index"] for x in got) == list(range(200))
    s = sorted(rows)
    want = {(a[0], a[2], b[2]) for a, b in zip(s, s[1:]) if a[0] == b[0]}
    assert {tuple(x) for x in topology.followed(df, "g", "at").collect()} == want


def test_nearest_ancestor_with_a_value(spark):
    rows = [("n0", None, "root")] + [(f"n{i}", f"n{i - 1}", "mid" if i == 6 else None) for i in range(1, 12)]
    rows += [("x", "gone", None), ("c1", "c2", None), ("c2", "c1", None), ("s", "s", None), ("lone", None, None)]
    got = {r.id: r.community for r in topology.inherited(spark.createDataFrame(rows, "id string, parent_id string, community string")).collect()}
    assert got == {**{f"n{i}": "root" for i in range(6)}, **{f"n{i}": "mid" for i in range(6, 12)}, "x": None, "c1": None, "c2": None, "s": None, "lone": None}


def test_edge_weights(spark):
    nan = float("nan")
    edges = [("e1", "a", "b", 2.0, False, "factual"), ("e2", "a", "b", nan, True, "factual"), ("e3", "b", "a", 0.0, False, "structural"), ("e4", "a", "a", 1.0, False, "factual"), ("e5", "a", "z", 1.0, False, "factual"), ("e6", "b", "a", None, False, "factual")]
    df = spark.createDataFrame(edges, "id string, from_id string, to_id string, weight double, quarantined boolean, sigma string")
    got = topology.edge_links(df, spark.createDataFrame([("a",), ("b",)], "id string")).collect()
    assert sorted(round(r.weight, 6) for r in got) == [0.023, 0.175, 0.5, 1.0]


def test_hash_heeds_content_only(spark):
    h = lambda rows: layout.content_hash(spark.createDataFrame([(x,) for x in rows], "line string").repartition(3)).first()[0]
    assert h(["a", "b", "b"]) == h(["b", "a", "b"]) != h(["a", "b"])
    assert h([]) != h(["a"])


def test_a_world_without_faults_is_valid(spark):
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    import hashlib

    digest = lambda x: "sha256:" + hashlib.sha256(x.encode()).hexdigest()[:32]
    text = "Ann owns Bob.\nBob left."
    edges = [(f"e{i}", "ea", "eb", "owns", "factual", "owned_by", i < 1, "inverse_conflict" if i < 1 else None, ["p1"]) for i in range(25)]
    world = {
        "continents": t([("r",)], "id string"),
        "islands": t([("n", "r")], "id string, parent_id string"),
        "assets": t([("a", "n", "s")], "id string, parent_id string, source_id string"),
        "sources": t([("s", text, digest(text), 0, "verbatim")], "id string, text string, content_hash string, seq int, kind string"),
        "passages": t([("p1", "a", "s", "Ann owns Bob.", "verbatim", 0, 13, digest("Ann owns Bob.")), ("p2", "a", "s", "Bob went.", "resolved", 14, 23, digest("Bob left."))], "id string, parent_id string, source_id string, text string, resolution string, char_start long, char_end long, content_hash string"),
        "entities": t([("ea", "Ann", ["n"], False), ("eb", "Bob", ["n"], False)], "id string, label string, islands array<string>, is_bridge boolean"),
        "mentions": t([("ea", "p1"), ("eb", "p1"), ("eb", "p2")], "id string, passage_id string"),
        "edges": t(edges, "id string, from_id string, to_id string, family string, sigma string, inverse_family string, quarantined boolean, reason string, evidence array<string>"),
        "families": t([("owns", "factual", "owned_by")], "family string, sigma string, inverse string"),
        "staged": t([("q1", ["ea", "eb"], ["e1"]), ("q2", ["p1"], ["e2"])], "id string, node_ids array<string>, edge_ids array<string>"),
    }
    validation.assert_valid(world)
    assert validation.validated(world).count() == len(validation.INVARIANTS)


def test_every_invariant_of_a_row_has_a_faulty_row(spark, sf):
    found = {r.invariant for r in validation.validated(World(spark, sf).faulty()).where("violations > 0").collect()}
    assert found >= {"edge_ends", "claim_in_evidence", "passage_hash", "island_parent", "bridge_flag"}


def test_a_hot_object_is_compared_by_two_subjects(spark):
    edges = [(f"e{i:04}", f"s{i:04}", "hub", "owns", 0.9, False, [f"p{i}"]) for i in range(500)] + [("x1", "s1", "few", "owns", 0.8, True, ["p"])]
    df = spark.createDataFrame(edges, "id string, from_id string, to_id string, family string, confidence double, quarantined boolean, evidence array<string>")
    labels = spark.createDataFrame([(f"s{i:04}", f"S{i}") for i in range(500)] + [("hub", "Hub")], "id string, label string")
    (r,) = mining.comparisons(df, labels).collect()
    assert (r.gold_edge_ids, r.gold_node_ids) == (["e0000", "e0001"], ["s0000", "s0001", "hub", "p0", "p1"])
    assert [x.gold_edge_ids for x in mining.lookups(df, labels, most=1).collect()] == [["e0000"]]
