"""Portable units of a graph: closures for export, and imports that can be repeated.

A store is a dict of nodes (id, category, label, body), edges (from_id, to_id, relation), mentions
(id, passage_id, asset_id) and provenance (from_id, to_id, relation, passage_id, confidence). An
artifact has the same tables, its nodes with ``stub`` and its edges with ``scope``, entities
(asset_id, id, mentions), and two dropped-row counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .provenance import merged


#: Fixed values of the artifact's format.
VERSION, RUNGS, STUB = 1, ("source", "asset"), "extraction_stub"
EDGE = ["from_id", "to_id", "relation"]


def node_closure(mentions: DataFrame, unit: DataFrame) -> DataFrame:
    """Rows (id, scope): entities whose passages are all in the unit are derived, others that it
    mentions are boundary stubs. mentions: id, passage_id; unit: passage_id."""
    inside = unit.select("passage_id", F.lit(True).alias("in_unit")).distinct()
    per = mentions.select("id", "passage_id").join(inside, "passage_id", "left").groupBy("id").agg(F.bool_and(F.coalesce("in_unit", F.lit(False))).alias("all_in"), F.bool_or(F.coalesce("in_unit", F.lit(False))).alias("any_in"))
    return per.where("any_in").select("id", F.when(F.col("all_in"), "derived").otherwise("boundary").alias("scope"))


def edge_closure(edges: DataFrame, nodes: DataFrame, unit: DataFrame) -> DataFrame:
    """Rows (id, scope): edges with evidence in the unit: internal between derived nodes, boundary
    with one, shared with none. Edges without it are left out. edges: id, from_id, to_id, evidence."""
    held = edges.select("id", F.explode("evidence").alias("passage_id")).join(unit, "passage_id", "left_semi").select("id").distinct()
    own = nodes.where("scope = 'derived'").select(F.col("id").alias("n"))
    a, b = own.select(F.col("n").alias("from_id"), F.lit(1).alias("a")), own.select(F.col("n").alias("to_id"), F.lit(1).alias("b"))
    both = edges.join(held, "id", "left_semi").join(a, "from_id", "left").join(b, "to_id", "left")
    n = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return both.select("id", F.when(n == 2, "internal").when(n == 1, "boundary").otherwise("shared").alias("scope"))


def imported(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (id, ..., stub) after an import: new rows win, but a stub never replaces a full node."""
    full = old.where("NOT stub").select("id")
    blocked = new.where("stub").join(full, "id", "left_semi").select("id")
    return merged(old, new.join(blocked, "id", "left_anti"), ["id"])


def checked(artifact_nodes: DataFrame, artifact_edges: DataFrame) -> None:
    """Raises if an artifact's edges have ends that it lacks, or its ids repeat."""
    ends = artifact_edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    if not ends.join(artifact_nodes.select("id"), "id", "left_anti").limit(1).isEmpty():
        raise ValueError("an edge has an end that the artifact lacks")
    if not artifact_nodes.groupBy("id").count().where("count > 1").limit(1).isEmpty():
        raise ValueError("an id is there twice")


def exported(store: dict[str, DataFrame], unit: DataFrame) -> dict[str, DataFrame]:
    """The artifact of a unit (passage_id).

    Nodes that only the unit knows travel whole, shared ones as a label. Edges with evidence in
    the unit travel if an end is one of these nodes: internal between whole nodes, boundary with
    one, shared with none; an end that is no node at all is left for the importer. ``dropped``
    counts the rows that have no place: mentions of what is no node, and evidence of edges that
    don't travel.
    """
    inside = written(unit.select("passage_id").distinct(), "unit")
    scopes = written(node_closure(store["mentions"], inside).join(store["nodes"].select("id"), "id", "left_semi"), "scopes")
    whole = F.col("scope") == "derived"
    nodes = store["nodes"].join(scopes, "id").select("id", F.when(whole, F.col("category")).otherwise(STUB).alias("category"), "label", F.when(whole, F.col("body")).otherwise("").alias("body"), (~whole).alias("stub"))
    end = lambda c: scopes.select(F.col("id").alias(c), whole.cast("int").alias(f"__{c}"))
    evidence = store["provenance"].join(inside, "passage_id", "left_semi")
    known = evidence.select(*EDGE).distinct().join(end("from_id"), "from_id", "left").join(end("to_id"), "to_id", "left").where("__from_id IS NOT NULL OR __to_id IS NOT NULL")
    n = F.coalesce("__from_id", F.lit(0)) + F.coalesce("__to_id", F.lit(0))
    edges = written(known.select(*EDGE, F.when(n == 2, "internal").when(n == 1, "boundary").otherwise("shared").alias("scope")), "edges")
    said = store["mentions"].join(inside, "passage_id", "left_semi")
    entities = said.join(scopes.select("id"), "id", "left_semi").groupBy("asset_id", "id").agg(F.count("*").alias("mentions"))
    lost = said.join(scopes.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("entity_rows").alias("table"), "n")
    unheld = evidence.join(edges.select(*EDGE), EDGE, "left_anti").agg(F.count("*").alias("n")).select(F.lit("provenance_rows").alias("table"), "n")
    return {
        "nodes": nodes,
        "edges": edges,
        "mentions": said.join(scopes.select("id"), "id", "left_semi"),
        "provenance": evidence.join(edges.select(*EDGE), EDGE, "left_semi"),
        "entities": entities,
        "dropped": lost.unionByName(unheld),
    }


def accepted(header: dict, record_id: str | None = None) -> None:
    """Raises ValueError for a header (artifact_version, rung, asset_id, asset) that can't be imported.

    The asset rung needs its record, whose id must be the header's and the expected one.
    """
    if header.get("artifact_version") != VERSION:
        raise ValueError(f"artifact_version {header.get('artifact_version')!r}")
    if header.get("rung") not in RUNGS:
        raise ValueError(f"rung {header.get('rung')!r}")
    if header["rung"] == "asset":
        record = header.get("asset")
        if not record:
            raise ValueError("an asset's artifact has no record of it")
        if record.get("asset_id") != header.get("asset_id") or record_id not in (None, header.get("asset_id")):
            raise ValueError("the record is of another asset")


def _single(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the least of several."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(*rows.columns)


class _Made(Mapping):
    """Tables by name, each made once, when it is first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def import_artifact(store: dict[str, DataFrame], artifact: dict[str, DataFrame]) -> Mapping[str, DataFrame]:
    """The store after an import, which may be repeated; its tables are made when they are asked for.

    Whole nodes replace what the store has; a stub is only taken where the store has nothing or
    a stub. Ends of edges that are no node become stubs with their id for a label. Edges,
    mentions and evidence are there once each.
    """
    once = lambda name, keys: written(merged(_single(store[name], keys), _single(artifact[name].select(*store[name].columns), keys), keys), name)

    def settled() -> DataFrame:
        old = store["nodes"].withColumn("stub", F.col("category") == STUB)
        nodes = written(imported(old, artifact["nodes"].select(*old.columns)).drop("stub"), "nodes")
        ends = out["edges"].select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        unmet = ends.join(nodes.select("id"), "id", "left_anti").select("id", F.lit(STUB).alias("category"), F.col("id").alias("label"), F.lit("").alias("body"))
        return nodes.unionByName(unmet.select(*nodes.columns))

    out = _Made(
        nodes=settled,
        edges=lambda: once("edges", EDGE),
        mentions=lambda: once("mentions", ["id", "passage_id"]),
        provenance=lambda: once("provenance", [*EDGE, "passage_id"]),
    )
    return out


def import_report(before: dict[str, DataFrame], after: dict[str, DataFrame], artifact: dict[str, DataFrame]) -> DataFrame:
    """Rows (measure, n): what an import brought, kept from being overwritten, made up, and what the artifact dropped."""
    count = lambda t, name: t.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    full = before["nodes"].where(F.col("category") != STUB).select("id")
    rows = [
        count(artifact["nodes"].where("NOT stub"), "whole_nodes"),
        count(artifact["nodes"].where("stub"), "stubs"),
        count(artifact["nodes"].where("stub").join(full, "id", "left_semi"), "stubs_held_back"),
        count(after["nodes"].join(before["nodes"].select("id"), "id", "left_anti").join(artifact["nodes"].select("id"), "id", "left_anti"), "stubs_made"),
        count(after["edges"].join(before["edges"].select(*EDGE), EDGE, "left_anti"), "edges_added"),
        *[count(artifact["edges"].where(F.col("scope") == s), f"{s}_edges") for s in ("internal", "boundary", "shared")],
        artifact["dropped"].select(F.concat(F.lit("dropped_"), "table").alias("measure"), "n"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
