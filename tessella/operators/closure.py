"""How well a vocabulary of relation families covers the relations of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .topology import indexed

#: Fixed values.
THRESHOLD, CLUSTER_COSINE, CHUNK = 0.541, 0.60, 3200
#: Gaps that a round of clustering settles among themselves.
LEADERS = 1024


def chunks(text: Column, cap: int = CHUNK) -> Column:
    """Paragraphs packed greedily into chunks of at most ``cap`` characters, separators not counted."""
    paragraphs = F.filter(F.split(text, "\\n\\n"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        over = (a["n"] > 0) & (a["n"] + F.length(p) > cap)
        return F.when(
            over, F.struct(F.concat(a["done"], F.array(F.array_join(a["open"], "\n\n"))).alias("done"), F.array(p).alias("open"), F.length(p).alias("n"))
        ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(p)).alias("open"), (a["n"] + F.length(p)).alias("n")))

    return F.aggregate(paragraphs, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], "\n\n")))).otherwise(a["done"]))


def parsed_triples(answer: Column) -> Column:
    """[[head, relation, tail]] between the first '[' and the last ']', blank ones left out."""
    inner = F.regexp_extract(answer, "(?s)(\\[.*\\])", 1)
    rows = F.from_json(inner, "array<array<string>>")
    return F.filter(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda t: (F.size(t) == 3) & F.forall(t, lambda x: F.trim(x) != ""))


def relation_stats(triples: DataFrame) -> DataFrame:
    """Rows (relation, freq, registers): distinct relations, lower-cased and trimmed."""
    return triples.groupBy(F.trim(F.lower("relation")).alias("relation")).agg(F.count("*").alias("freq"), F.sort_array(F.collect_set("register")).alias("registers"))


def nearest_family(relations: DataFrame, families: DataFrame, block: int = 4096) -> DataFrame:
    """Rows (relation, family, best): the family of greatest cosine, ties to the first by place.

    Vectors are unit length. A family table is a vocabulary (tens of rows); it goes to the tasks
    in blocks of bounded size, and a batch of relations is one matrix product with each.
    """
    placed = written(indexed(families.select("place", "family", "v"), "place", "family"), "families")
    count, parts = placed.count(), []
    for first in range(0, max(count, 1), block):
        table = placed.where(F.col("index").between(first, first + block - 1)).orderBy("index").toPandas()
        names, matrix = table["family"].tolist(), np.array(table["v"].tolist(), np.float64).reshape(len(table), -1)

        def run(batches: Iterator[pd.DataFrame], names=names, matrix=matrix, first=first) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and names:
                    cosine = np.array(b["v"].tolist(), np.float64) @ matrix.T
                    at = cosine.argmax(axis=1)
                    yield pd.DataFrame({"relation": b["relation"], "at": first + at, "family": [names[i] for i in at], "best": cosine[np.arange(len(b)), at]})

        parts.append(relations.select("relation", "v").mapInPandas(run, "relation string, at long, family string, best double"))
    if len(parts) == 1:
        return parts[0].select("relation", "family", F.round("best", 6).alias("best"))
    rows = reduce(DataFrame.unionByName, parts)
    best = rows.groupBy("relation").agg(F.min_by(F.struct("family", "best"), F.struct(-F.col("best"), "at")).alias("b"))
    return best.select("relation", "b.family", F.round("b.best", 6).alias("best"))


def threshold(true_cosines: DataFrame, default: float = THRESHOLD) -> DataFrame:
    """One row: the value at place n div 20 (from 0) of the sorted cosines, rounded to 3 places.

    Values are counted first; the place is found by running counts over distinct values.
    """
    counts = true_cosines.groupBy(F.round("cosine", 6).alias("x")).agg(F.count("*").alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("x"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    found = running.where("upto > total div 20").agg(F.round(F.min("x"), 3).alias("t"))
    return found.select(F.coalesce("t", F.lit(default)).alias("threshold"))


def coverage_by_register(nearest: DataFrame, stats: DataFrame, limit: float) -> DataFrame:
    """Rows (register, relations, distinct_coverage, edge_coverage); weights are global frequencies."""
    hit = (F.col("best") >= limit).cast("int")
    rows = nearest.join(stats, "relation").select(F.explode("registers").alias("register"), hit.alias("hit"), "freq")
    return rows.groupBy("register").agg(
        F.count("*").alias("relations"), F.round(F.avg("hit"), 3).alias("distinct_coverage"), F.round(F.sum(F.col("hit") * F.col("freq")) / F.sum("freq"), 3).alias("edge_coverage")
    )


def coverage_total(nearest: DataFrame, stats: DataFrame, limit: float) -> DataFrame:
    hit = (F.col("best") >= limit).cast("int")
    return nearest.join(stats, "relation").agg(
        F.count("*").alias("relations"),
        F.count(F.when(hit == 0, 1)).alias("gaps"),
        F.round(F.avg(hit), 3).alias("distinct_coverage"),
        F.round(F.sum(hit * F.col("freq")) / F.sum("freq"), 3).alias("edge_coverage"),
    )


def _leaders(names: list[str], v: np.ndarray, cosine: float) -> tuple[dict[str, str], list[int]]:
    """The leader of each row, in order, and which rows lead."""
    of: dict[str, str] = {}
    lead: list[int] = []
    near = v @ v.T >= cosine
    for i, name in enumerate(names):
        first = next((j for j in lead if near[i, j]), i)
        of[name] = names[first]
        if first == i:
            lead.append(i)
    return of, lead


def gap_clusters(gaps: DataFrame, cosine: float = CLUSTER_COSINE, block: int = LEADERS) -> DataFrame:
    """Rows (relation, leader): by falling frequency, then name, each gap joins the first cluster
    whose leader is near enough, or leads a new one.

    Rounds settle the order without walking through it: the first ``block`` gaps that no leader
    so far is near to are led by each other, one after the other, and all gaps that are left are
    held against these new leaders, first to last, wherever they are. Whatever is near none of
    them waits for the next round. A round brings a block to the driver and leaders to the tasks.
    """
    left, done = written(gaps.select("relation", "freq", "v"), "gaps"), None
    while True:
        first = left.orderBy(F.desc("freq"), "relation").limit(block).toPandas()
        if first.empty:
            return done if done is not None else left.select("relation", F.col("relation").alias("leader"))
        names, v = first["relation"].tolist(), np.array(first["v"].tolist(), np.float64).reshape(len(first), -1)
        own, lead = _leaders(names, v, cosine)
        leaders, matrix = [names[i] for i in lead], v[lead]

        def join(batches: Iterator[pd.DataFrame], own=own, leaders=leaders, matrix=matrix) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.array(b["v"].tolist(), np.float64) @ matrix.T >= cosine
                    at = np.where(near.any(axis=1), near.argmax(axis=1), -1)
                    yield b.assign(leader=[own.get(r) or (leaders[i] if i >= 0 else None) for r, i in zip(b["relation"], at)])

        matched = written(left.mapInPandas(join, f"relation string, freq {dict(left.dtypes)['freq']}, v array<double>, leader string"), "gaps")
        joined = matched.where("leader IS NOT NULL").select("relation", "leader")
        done = joined if done is None else done.unionByName(joined)
        left = matched.where("leader IS NULL").select("relation", "freq", "v")


def extension_candidates(clusters: DataFrame, stats: DataFrame, members: int = 12) -> DataFrame:
    """Rows (leader, size, freq, members) of clusters of two or more, by falling frequency."""
    rows = clusters.join(stats, "relation")
    order = F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("freq"), "relation"))
    top = rows.withColumn("n", order)
    return (
        top.groupBy("leader")
        .agg(F.count("*").alias("size"), F.sum("freq").alias("freq"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= members, F.struct("n", "relation")))), lambda s: s["relation"]), ",").alias("members"))
        .where("size >= 2")
    )


def with_packs(core: DataFrame, packs: DataFrame) -> DataFrame:
    """Families of the core and, where it has no such name, of the first pack (by place)."""
    first = packs.groupBy("family").agg(F.min_by(F.struct(*packs.columns), "place").alias("r")).select("r.*")
    return core.unionByName(first.join(core, "family", "left_anti"), allowMissingColumns=True)


def string_families(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (relation, kind, family): what a mapping of strings says of each relation.

    mapping: relation, family, note; a null family with a note is that kind (generic,
    non_english, junk); a relation that is itself a family's name is 'family'.
    """
    names = mapping.where("family IS NOT NULL").select(F.col("family").alias("relation"), F.lit(True).alias("is_family")).distinct()
    joined = relations.select("relation").join(names, "relation", "left").join(mapping, "relation", "left")
    kind = F.when(F.col("is_family"), "family").when(F.col("family").isNotNull(), "mapped").when(F.col("note").isNotNull(), F.col("note")).otherwise("unknown")
    return joined.select("relation", kind.alias("kind"), F.when(F.col("is_family"), F.col("relation")).otherwise(F.col("family")).alias("family"))
