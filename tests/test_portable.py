"""Units that travel: headers, dropped rows, stubs, repeated imports."""

import pytest

from tessella.operators import portable

NODES, EDGES = "id string, category string, label string, body string", "from_id string, to_id string, relation string"
MENTIONS, PROVENANCE = "id string, passage_id string, asset_id string", EDGES + ", passage_id string, confidence double"


def store(spark, nodes, mentions, provenance):
    return {
        "nodes": spark.createDataFrame(nodes, NODES),
        "edges": spark.createDataFrame([p[:3] for p in provenance], EDGES).distinct(),
        "mentions": spark.createDataFrame(mentions, MENTIONS),
        "provenance": spark.createDataFrame(provenance, PROVENANCE),
    }


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_headers():
    portable.accepted({"artifact_version": 1, "rung": "source"})
    portable.accepted({"artifact_version": 1, "rung": "asset", "asset_id": "a", "asset": {"asset_id": "a"}}, "a")
    for bad in ({"artifact_version": 2, "rung": "source"}, {"artifact_version": 1, "rung": "island"}, {"artifact_version": 1, "rung": "asset", "asset_id": "a"}, {"artifact_version": 1, "rung": "asset", "asset_id": "a", "asset": {"asset_id": "b"}}):
        with pytest.raises(ValueError):
            portable.accepted(bad)
    with pytest.raises(ValueError):
        portable.accepted({"artifact_version": 1, "rung": "asset", "asset_id": "a", "asset": {"asset_id": "a"}}, "b")


def test_export_and_repeated_import(spark):
    full = [(x, "entity", x.upper(), f"about {x}") for x in "abc"]
    mentions = [("a", "p1", "A"), ("b", "p1", "A"), ("b", "p2", "B"), ("c", "p2", "B"), ("gone", "p1", "A"), ("a", "p1", "A")]
    evidence = [("a", "b", "r", "p1", 0.9), ("a", "gone", "r", "p1", 0.8), ("gone", "lost", "r", "p1", 0.7), ("b", "c", "r", "p2", 0.6)]
    home = store(spark, full, mentions, evidence)
    unit = spark.createDataFrame([("p1",)], "passage_id string")
    artifact = portable.exported(home, unit)
    assert rows(artifact["nodes"]) == [("a", "entity", "A", "about a", False), ("b", "extraction_stub", "B", "", True)]
    assert rows(artifact["edges"]) == [("a", "b", "r", "boundary"), ("a", "gone", "r", "boundary")]
    assert rows(artifact["dropped"]) == [("entity_rows", 1), ("provenance_rows", 1)]
    there = store(spark, [("b", "own", "bee", "known")], [("b", "q", "Q")], [("b", "far", "r", "q", 0.5)])
    once = portable.import_artifact(there, artifact)
    want = [("a", "entity", "A", "about a"), ("b", "own", "bee", "known"), ("far", "extraction_stub", "far", ""), ("gone", "extraction_stub", "gone", "")]
    assert rows(once["nodes"]) == want
    twice = portable.import_artifact(once, artifact)
    assert all(rows(twice[t]) == rows(once[t]) for t in once)
    report = dict(rows(portable.import_report(there, once, artifact)))
    assert report["stubs_held_back"] == 1 and report["stubs_made"] == 2 and report["edges_added"] == 2 and report["dropped_entity_rows"] == 1
    assert rows(portable.node_closure(once["mentions"], unit)) == [("a", "derived"), ("b", "boundary")]
