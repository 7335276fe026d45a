"""Audit of a store: internal chain, and anchoring of sources in a corpus of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_space, sentences

#: Units shorter than this don't count when a segment is looked for piece by piece.
UNIT_FLOOR = 20
#: Header of a session's text.
SESSION_HEADER = "^\\[Session date: [^\\]]+\\]\\s*"


def dangling_citations(citations: DataFrame, segments: DataFrame) -> DataFrame:
    return citations.join(segments.select("segment_id"), "segment_id", "left_anti")


def snippet_matches(citations: DataFrame, segments: DataFrame) -> DataFrame:
    """verbatim, normalised or absent for each citation with a snippet and a known segment."""
    both = citations.where("trim(evidence_snippet) <> ''").join(segments.select("segment_id", "text"), "segment_id")
    snippet = F.trim("evidence_snippet")
    match = F.when(F.contains("text", snippet), "verbatim").when(F.contains(normalise_space(F.col("text")), normalise_space(F.col("evidence_snippet"))), "normalised").otherwise("absent")
    return both.select("answer_id", "segment_id", "cite_order", match.alias("match"))


def orphan_segments(segments: DataFrame, sources: DataFrame) -> DataFrame:
    return segments.join(sources.select("source_id"), "source_id", "left_anti")


def dual_write(segments: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: ids in both, different texts (null is ''), and ids that one side lacks."""
    a = segments.select("segment_id", F.coalesce("text", F.lit("")).alias("a"), F.lit(1).alias("l"))
    b = passages.select(F.col("passage_id").alias("segment_id"), F.coalesce("raw_text", F.lit("")).alias("b"), F.lit(1).alias("r"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return a.join(b, "segment_id", "full").agg(
        F.count(F.when(both, 1)).alias("shared"),
        F.count(F.when(both & (F.col("a") != F.col("b")), 1)).alias("mismatched"),
        F.count(F.when(F.col("r").isNull(), 1)).alias("only_segments"),
        F.count(F.when(F.col("l").isNull(), 1)).alias("only_passages"),
    )


def uncited_answers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    return answers.join(citations.select("answer_id"), "answer_id", "left_anti")


def anchored_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """EXACT or UNANCHORED per source, with the last path of the file whose hash it has."""
    last = files.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.max("path").alias("path"))
    return sources.select("source_id", "content_hash").join(last, "content_hash", "left").select("source_id", "path", F.when(F.col("path").isNull(), "UNANCHORED").otherwise("EXACT").alias("anchor"))


def segment_class(segment: Column, text: Column) -> Column:
    """WHOLE, NORMALIZED, UNITS, PARTIAL or ABSENT: how a text holds a segment."""
    body = F.regexp_replace(segment, SESSION_HEADER, "")
    flat = normalise_space(text)
    units = F.filter(sentences(body), lambda u: F.length(u) >= UNIT_FLOOR)
    held = F.size(F.filter(units, lambda u: F.contains(flat, u)))
    return (
        F.when(F.contains(text, body), "WHOLE")
        .when(F.contains(flat, normalise_space(body)), "NORMALIZED")
        .when((F.size(units) > 0) & (held == F.size(units)), "UNITS")
        .when(held > 0, "PARTIAL")
        .otherwise("ABSENT")
    )


def segment_classes(segments: DataFrame, anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (source_id, class, segments) over the sources that are anchored in a file."""
    held = anchors.where("anchor = 'EXACT'").join(files, "path").select("source_id", F.col("text").alias("file_text"))
    return segments.join(held, "source_id").groupBy("source_id", segment_class(F.col("text"), F.col("file_text")).alias("class")).agg(F.count("*").alias("segments"))


def report(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows (check, found, verdict): a check fails or warns (its level) if it found rows."""
    out = None
    for name, (rows, level) in checks.items():
        n = rows.agg(F.count("*").alias("found"))
        row = n.select(F.lit(name).alias("check"), "found", F.when(F.col("found") == 0, "PASS").otherwise(F.lit(level)).alias("verdict"))
        out = row if out is None else out.unionByName(row)
    return out


def exit_code(verdicts: list[str]) -> int:
    """1 if a check failed, else 0."""
    return int("FAIL" in verdicts)
