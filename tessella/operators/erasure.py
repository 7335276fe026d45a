"""Cascading erasure as snapshot transforms: tables in, tables without the erased rows out.

Mentions of an erased source go too, which a store with foreign keys would otherwise refuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def _without(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def invalidated_answers(evidence: DataFrame, segments: DataFrame) -> DataFrame:
    """Answers whose verdicts rest on one of the segments."""
    return evidence.join(segments.select("segment_id"), "segment_id", "left_semi").select("answer_id").distinct()


def without_verdicts(tables: Tables, answers: DataFrame) -> Tables:
    """Claims, evidence and run of whole answers go."""
    return tables | {n: _without(tables[n], answers, "answer_id") for n in ("answer_claims", "answer_claim_evidence", "answer_verification_runs")}


def _split(tables: Tables, owned: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """(exclusive segments, shared ones with their new owner: the smallest id that stays)."""
    others = tables["segment_sources"].where(F.col("source_id") != source_id).join(owned, "segment_id", "left_semi")
    homes = others.groupBy("segment_id").agg(F.min("source_id").alias("home"))
    return owned.join(homes, "segment_id", "left_anti"), homes


def _erase_segments(tables: Tables, exclusive: DataFrame, homes: DataFrame, owned: DataFrame, source_id: str) -> Tables:
    out = without_verdicts(tables, invalidated_answers(tables["answer_claim_evidence"], exclusive))
    out["answer_citations"] = _without(tables["answer_citations"], exclusive, "segment_id")
    lost = owned.withColumn("source_id", F.lit(source_id))
    out["segment_sources"] = _without(tables["segment_sources"], lost, "segment_id", "source_id")
    rest = _without(tables["source_segments"], exclusive, "segment_id").join(homes, "segment_id", "left")
    moved = F.when((F.col("source_id") == source_id) & F.col("home").isNotNull(), F.col("home")).otherwise(F.col("source_id"))
    out["source_segments"] = rest.withColumn("source_id", moved).drop("home").select(*tables["source_segments"].columns)
    return out


def erase_source(tables: Tables, source_id: str) -> tuple[Tables, DataFrame]:
    """(tables, counts): a source with its exclusive segments; shared ones get another owner."""
    here = lambda t: t.where(F.col("source_id") == source_id)
    owned = here(tables["segment_sources"]).select("segment_id").union(here(tables["source_segments"]).select("segment_id")).distinct()
    exclusive, homes = _split(tables, owned, source_id)
    out = _erase_segments(tables, exclusive, homes, owned, source_id)
    for name in ("sources", "source_resolution_overlay", "source_mention_clusters"):
        out[name] = tables[name].where(F.col("source_id") != source_id)
    return out, removed(tables, out)


def erase_asset(tables: Tables, source_id: str, segments: DataFrame) -> tuple[Tables, DataFrame]:
    """(tables, counts): listed segments that the source owns; the source too if it owns no other."""
    mine = tables["segment_sources"].where(F.col("source_id") == source_id).select("segment_id")
    owned = mine.join(segments.select("segment_id"), "segment_id", "left_semi").distinct()
    exclusive, homes = _split(tables, owned, source_id)
    out = _erase_segments(tables, exclusive, homes, owned, source_id)
    bare = tables["sources"].where(F.col("source_id") == source_id).join(out["segment_sources"], "source_id", "left_anti").select("source_id")
    for name in ("sources", "source_resolution_overlay", "source_mention_clusters"):
        out[name] = _without(tables[name], bare, "source_id")
    return out, removed(tables, out)


def removed(before: Tables, after: Tables) -> DataFrame:
    """Rows (measure, removed): how many rows each table lost."""
    out = None
    for name in sorted(before):
        n = before[name].agg(F.count("*").alias("b")).crossJoin(after[name].agg(F.count("*").alias("a")))  # one row each
        row = n.select(F.lit(name).alias("measure"), (F.col("b") - F.col("a")).alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out
