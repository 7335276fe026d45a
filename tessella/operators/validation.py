"""Invariants of a whole world, each counted, with its first offenders.

Rows of a table are held against all of its own invariants in one pass: each row lists the names
that it breaks. References of all tables to nodes are one table, anti-joined with the ids once.
Spans are cut from their sources in one join, and serve the checks of passages and of evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .graph import QUARANTINE_REASONS

#: The band of the share of gated edges that are quarantined.
RATE_BAND = (0.02, 0.05)

INVARIANTS = (
    "island_parent asset_parent asset_source passage_parent passage_source source_segment_zero passage_span passage_hash verbatim_text resolved_text "
    "source_hash bridge_flag entity_mentioned edge_ends edge_sigma edge_inverse structural_admitted quarantine_named admitted_without_reason reason_known "
    "edge_evidence claim_in_evidence quarantine_rate staged_nodes staged_edges staged_count"
).split()


def broken(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows (invariant, id): the names of the conditions that hold for a row, in one pass."""
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(named).alias("invariant"), "id")


def unresolved(references: list[tuple[str, DataFrame, Column]], ids: DataFrame) -> DataFrame:
    """Rows (invariant, id) whose reference isn't among ``ids`` (id); a null reference isn't either.

    References are made distinct where they are; only those that aren't met go back to their rows.
    """
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("invariant"), "id", r.alias("ref")) for n, t, r in references])
    gone = written(rows.select("ref").distinct().join(ids.select(F.col("id").alias("ref")), "ref", "left_anti").withColumnRenamed("ref", "__gone"), "unmet")
    return rows.join(gone, F.col("ref").eqNullSafe(F.col("__gone")), "left_semi").select("invariant", "id").distinct()


def digest(text: Column) -> Column:
    """'sha256:' and 32 hex digits."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 32))


def spans(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """``passages`` whose source is known, with whether the span is inside its text, and the span."""
    s = sources.select(F.col("id").alias("source_id"), F.col("text").alias("__whole"))
    inside = (F.col("char_start") >= 0) & (F.col("char_end") <= F.length("__whole")) & (F.col("char_end") > F.col("char_start"))
    cut = F.substring(F.col("__whole"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    return passages.join(s, "source_id").select(*passages.columns, inside.alias("inside"), F.when(inside, cut).alias("span"))


def unevidenced(edges: DataFrame, entities: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows (id) of admitted claims between entities, none of whose evidence names both.

    A passage names an entity in its text or in its span.
    """
    name = lambda end: entities.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"))
    claims = edges.where("NOT quarantined AND sigma <> 'structural'").join(name("from"), "from_id").join(name("to"), "to_id")
    claims = claims.select("id", "from_label", "to_label", F.explode_outer("evidence").alias("passage_id"))
    said = cut.select(F.col("id").alias("passage_id"), F.concat_ws("\n", "text", F.coalesce("span", F.lit(""))).alias("said"))
    both = F.coalesce(F.contains("said", "from_label") & F.contains("said", "to_label"), F.lit(False))
    return claims.join(said, "passage_id", "left").groupBy("id").agg(F.max(both).alias("ok")).where("NOT ok").select("id")


def violations(world: dict[str, DataFrame]) -> DataFrame:
    """Rows (invariant, id) of everything that breaks an invariant.

    world: continents (id), islands (id, parent_id), assets (id, parent_id, source_id), sources
    (id, text, content_hash, seq, kind), passages (id, parent_id, source_id, text, resolution,
    char_start, char_end, content_hash), entities (id, label, islands, is_bridge), mentions
    (id, passage_id), edges (id, from_id, to_id, family, sigma, inverse_family, quarantined,
    reason, evidence), families (family, sigma, inverse), staged (id, node_ids, edge_ids).
    """
    t = world
    col = F.col
    cut = written(spans(t["passages"], t["sources"]), "spans")
    nodes = reduce(DataFrame.union, [t[n].select("id") for n in ("continents", "islands", "assets", "sources", "passages", "entities")])
    dims = F.broadcast(t["families"].select("family", col("sigma").alias("__sigma"), col("inverse").alias("__inverse")))  # a vocabulary
    same = lambda a, b: col(a).eqNullSafe(col(b))
    edges = t["edges"].join(dims, "family", "left")
    structural = col("sigma") == "structural"
    each = [
        unresolved(
            [
                ("island_parent", t["islands"], col("parent_id")),
                ("asset_parent", t["assets"], col("parent_id")),
                ("asset_source", t["assets"], col("source_id")),
                ("passage_parent", t["passages"], col("parent_id")),
                ("passage_source", t["passages"], col("source_id")),
                ("edge_ends", t["edges"], col("from_id")),
                ("edge_ends", t["edges"], col("to_id")),
                ("staged_nodes", t["staged"], F.explode("node_ids")),
            ],
            nodes,
        ),
        unresolved([("staged_edges", t["staged"], F.explode("edge_ids"))], t["edges"]),
        broken(t["sources"], {"source_segment_zero": (col("seq") != 0) | (col("kind") != "verbatim"), "source_hash": ~digest(col("text")).eqNullSafe(col("content_hash"))}),
        broken(
            cut,
            {
                "passage_span": ~col("inside"),
                "passage_hash": col("inside") & ~digest(col("span")).eqNullSafe(col("content_hash")),
                "verbatim_text": col("inside") & (col("resolution") == "verbatim") & ~same("text", "span"),
                "resolved_text": col("inside") & (col("resolution") != "verbatim") & same("text", "span"),
            },
        ),
        broken(t["entities"], {"bridge_flag": ~col("is_bridge").eqNullSafe(F.size("islands") > 1)}),
        t["entities"].join(t["mentions"].select("id").distinct(), "id", "left_anti").select(F.lit("entity_mentioned").alias("invariant"), "id"),
        broken(
            edges,
            {
                "edge_sigma": ~same("sigma", "__sigma"),
                "edge_inverse": ~same("inverse_family", "__inverse") | col("__sigma").isNull(),
                "structural_admitted": structural & col("quarantined"),
                "quarantine_named": col("quarantined") & col("reason").isNull(),
                "admitted_without_reason": ~col("quarantined") & col("reason").isNotNull(),
                "reason_known": ~col("reason").isin(*QUARANTINE_REASONS),
                "edge_evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
            },
        ),
        unevidenced(t["edges"], t["entities"], cut).select(F.lit("claim_in_evidence").alias("invariant"), "id"),
        broken(_totals(t), {"quarantine_rate": ~col("rate").between(*RATE_BAND), "staged_count": col("staged") < 2}),
    ]
    return reduce(DataFrame.unionByName, each)


def _totals(t: dict[str, DataFrame]) -> DataFrame:
    """One row (id, rate, staged)."""
    gated = F.count_if(F.col("sigma") != "structural")
    rate = t["edges"].agg(F.when(gated > 0, F.count_if("quarantined") / gated).otherwise(0.0).alias("rate"))
    return rate.crossJoin(t["staged"].agg(F.count("*").alias("staged"))).select(F.lit("world").alias("id"), "rate", "staged")  # one row each


def validated(world: dict[str, DataFrame], examples: int = 4) -> DataFrame:
    """Rows (invariant, violations, examples), one for each invariant, kept or not.

    ``examples`` are the smallest ids that break it, joined by commas. Rows are ranked with the
    rest cut off where they are, so that an invariant that many rows break gathers few.
    """
    found = written(violations(world), "violations")
    spark = found.sparkSession
    names = spark.createDataFrame([(n,) for n in INVARIANTS], "invariant string")
    rank = F.row_number().over(Window.partitionBy("invariant").orderBy("id"))
    few = found.withColumn("n", rank).where(F.col("n") <= examples)
    listed = few.groupBy("invariant").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    counts = found.groupBy("invariant").agg(F.count("*").alias("violations"))
    return names.join(counts, "invariant", "left").join(listed, "invariant", "left").select("invariant", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("examples", F.lit("")).alias("examples"))


def assert_valid(world: dict[str, DataFrame]) -> None:
    """Raises ValueError that names the invariants that are broken."""
    bad = validated(world, 1).where("violations > 0").orderBy("invariant").collect()
    if bad:
        raise ValueError("; ".join(f"{r['invariant']}: {r['violations']} ({r['examples']})" for r in bad))
