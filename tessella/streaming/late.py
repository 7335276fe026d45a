"""Answers and late responses as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_stream(events: DataFrame) -> DataFrame:
    """Answers (answer_id, at, user_id, render_strategy) of an event stream (event_id, ts, user_id, event_type)."""
    return events.select(F.concat(F.lit("ans:"), F.col("event_id").cast("string")).alias("answer_id"), F.col("ts").cast("timestamp").alias("at"), "user_id", F.col("event_type").alias("render_strategy"))


def with_late_responses(answers: DataFrame, responses: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Answers joined with responses (answer_id, recorded_at, response_text) that come within ``lateness``.

    Watermarks on both sides bound the state: an answer is dropped from it once no response can
    match any more, and comes out without one.
    """
    a = answers.withWatermark("at", lateness)
    r = responses.select(F.col("answer_id").alias("__id"), F.col("recorded_at"), "response_text").withWatermark("recorded_at", lateness)
    near = F.expr(f"answer_id = __id AND recorded_at >= at AND recorded_at <= at + INTERVAL {lateness}")
    return a.join(r, near, "leftOuter").drop("__id")


def strategy_counts(answers: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Answers per strategy and window of event time."""
    return answers.withWatermark("at", lateness).groupBy(F.window("at", window), "render_strategy").agg(F.count("*").alias("answers"))
