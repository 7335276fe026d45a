"""Queries that take a whole table, held against plain computations over all of it."""

import numpy as np
import pytest

from tessella import queries as core
from tessella.plans.fixtures import World


def test_principal_axes_are_those_of_whole_vectors(spark, sf):
    table = {r.relation: r.v for r in World(spark, sf).relations().collect()}
    v = np.array(list(table.values()))
    u = v - v.mean(axis=0)
    axes = np.linalg.eigh(u.T @ u / len(u))[1][:, ::-1][:, :2]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    want = dict(zip(table, (tuple(x) for x in u @ axes)))
    got = {r.id: (r.px, r.py) for r in core.QUERIES["principal_axes"](spark, sf).collect()}
    assert v.shape[1] == 64 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_string_families_have_every_relation(spark, tmp_path):
    spark.range(1200).selectExpr("id AS vec_id", "array(1.0F) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = set()
    for i in range(1200):
        kind = ["mapped", "generic", "family", "unknown", "unknown"][i % 5]
        want.add((f"rel:{i}", kind, {"mapped": f"rel:{i + 2}", "family": f"rel:{i}"}.get(kind)))
    got = core.QUERIES["string_families"](spark, str(tmp_path)).collect()
    assert len(got) == 1200 and {tuple(r) for r in got} == want


def test_centrality_is_that_of_the_whole_graph(spark, sf):
    edges = World(spark, sf).edges().where("NOT quarantined").collect()
    names = sorted({e.from_id for e in edges} | {e.to_id for e in edges})
    at, m = {k: i for i, k in enumerate(names)}, np.zeros((len(names), len(names)))
    for e in edges:
        m[at[e.from_id], at[e.to_id]] += e.weight
        m[at[e.to_id], at[e.from_id]] += e.weight
    x = np.ones(len(names))
    for _ in range(16):
        x = m @ x
        x /= np.linalg.norm(x)
    want = dict(zip(names, 0.55 * x / x.max() + 0.45 * m.sum(0) / m.sum(0).max()))
    got = {r.id: r.centrality for r in core.QUERIES["centrality"](spark, sf).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
