"""Compact matching of a few letters in labels, as column expressions: scores, places and highlighted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At the start, at a word's start, next to the letter before; a skipped letter between
#: and before matches; a letter of length; an alias; and what precedes a word.
START, WORD, NEXT, GAP, LEAD, LENGTH, ALIAS = 12, 8, 6, 1, 2, 0.05, 4
BOUNDARIES = " -_.:/"


def _attempt(low: Column, words: Column, start: Column, rest: list[str]) -> Column:
    """struct<prev, score, at> of a match that begins at ``start``; prev is -1 where it can't be finished.

    Every further letter is the very next one or, failing that, the next that begins a word;
    ``words`` has only these, in their places.
    """
    first = F.when(start == 0, START).when(F.contains(F.lit(BOUNDARIES), F.substring(low, start, F.lit(1))), WORD).otherwise(0)
    state = F.struct(start.cast("int").alias("prev"), (first - LEAD * start).cast("int").alias("score"), F.array(start.cast("int")).alias("at"))

    def step(a: Column, c: Column) -> Column:
        following = F.substring(low, a["prev"] + 2, F.lit(1)) == c
        word = F.call_function("locate", c, words, a["prev"] + 3) - 1
        found = F.when(a["prev"] < 0, -1).when(following, a["prev"] + 1).otherwise(word)
        gain = F.when(following, NEXT).otherwise(WORD - GAP * (word - a["prev"] - 1))
        return F.struct(found.cast("int").alias("prev"), (a["score"] + gain).cast("int").alias("score"), F.concat(a["at"], F.array(found.cast("int"))).alias("at"))

    return F.aggregate(F.array(*[F.lit(c) for c in rest]).cast("array<string>"), state, step)


def fuzzy_match(query: str, text: Column) -> Column:
    """struct<score, at> of the best match of a query in a text, null without one.

    Case and the query's spaces don't count. A match may begin anywhere; of equal ones the first
    is taken. An empty query matches everything with 0; an empty text matches nothing.
    """
    q = "".join(query.lower().split())
    if not q:
        return F.when(F.length(text) > 0, F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("at")))
    low = F.lower(text)
    words = F.regexp_replace(low, "(?<![ \\-_.:/])[\\s\\S]", "\u0000")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(low) - 1, F.lit(0))), lambda i: F.substring(low, i + 1, F.lit(1)) == q[0])
    done = F.filter(F.transform(starts, lambda s: _attempt(low, words, s, list(q[1:]))), lambda a: a["prev"] >= 0)
    best = F.array_max(F.transform(done, lambda a: F.struct(a["score"].alias("score"), (-a["at"][0]).alias("first"), a["at"].alias("at"))))
    return F.when(best.isNotNull(), F.struct((best["score"] - F.length(low) * F.lit(LENGTH)).alias("score"), best["at"].alias("at")))


def mark_runs(label: Column, at: Column) -> Column:
    """array<struct<text, hit>>: the label cut where matched places begin and end."""
    hit = lambda i: F.array_contains(at, i)
    cuts = F.filter(F.sequence(F.lit(0), F.length(label)), lambda i: (i == 0) | (i == F.length(label)) | (hit(i) != hit(i - 1)))
    pairs = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda a, b: F.struct(F.substring(label, a + 1, b - a).alias("text"), hit(a).alias("hit")))
    return F.when(F.length(label) > 0, pairs).otherwise(F.array().cast("array<struct<text:string,hit:boolean>>"))


def fuzzy(query: str, labels: DataFrame) -> DataFrame:
    """Rows (id, label, score, runs): each id's best match among its label and aliases (id, label, alias).

    An alias scores less and marks nothing. Of equal scores the label comes first, then names in order.
    """
    m = fuzzy_match(query, F.col("label"))
    scored = labels.withColumn("m", m).where("m IS NOT NULL").select("id", "label", "alias", (F.col("m.score") - F.when(F.col("alias"), ALIAS).otherwise(0)).alias("score"), F.when(F.col("alias"), F.array().cast("array<int>")).otherwise(F.col("m.at")).alias("at"))
    best = scored.groupBy("id").agg(F.min_by(F.struct("label", "score", "at"), F.struct(-F.col("score"), "alias", "label")).alias("b"))
    return best.select("id", "b.label", "b.score", mark_runs(F.col("b.label"), F.col("b.at")).alias("runs"))
