"""Views, corridors, timelines and checks of a typed graph with a containment spine.

nodes: id, kind, parent_id, label, centrality, degree. edges: id, from_id, to_id, family, sigma,
weight, confidence, evidence (array of passage ids), quarantined, reason, at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Fixed values.
EDGE_CAP, BUNDLE_CAP, EXEMPLARS, CONFIDENCE_FLOOR = 512, 256, 2, 0.55
#: Mentions of a passage whose nodes are paired, at most.
PAIRED = 64
QUARANTINE_REASONS = (
    "span_not_in_source entity_not_grounded inverse_conflict temporal_paradox confidence_below_floor "
    "duplicate_assertion_divergent_object source_hash_mismatch"
).split()


def rung_view(nodes: DataFrame, rung: str, parent: str | None = None) -> DataFrame:
    """Nodes of a kind, below a parent if one is given."""
    out = nodes.where(F.col("kind") == rung)
    return out if parent is None else out.where(F.col("parent_id") == parent)


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids`` (column id)."""
    a, b = ids.select(F.col("id").alias("from_id")), ids.select(F.col("id").alias("to_id"))
    return edges.join(a, "from_id", "left_semi").join(b, "to_id", "left_semi")


def top_edges(edges: DataFrame, ids: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """The heaviest edges among ``ids``, ties by id."""
    return among(edges, ids).orderBy(F.desc("weight"), "id").limit(cap)


def edge_stats(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, edges_drawn (those not quarantined) among ``ids``."""
    e = among(edges, ids).agg(F.count("*").alias("edge_count"), F.count(F.when(~F.col("quarantined"), 1)).alias("edges_drawn"))
    return ids.agg(F.count("*").alias("node_count")).crossJoin(e)  # one row each


def incidence(edges: DataFrame) -> DataFrame:
    """Rows (id, other, edge_id, ...): each edge from both of its ends."""
    rest = [c for c in edges.columns if c not in ("id", "from_id", "to_id")]
    one = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.col("id").alias("edge_id"), F.lit(True).alias("forward"), *rest)
    two = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.col("id").alias("edge_id"), F.lit(False).alias("forward"), *rest)
    return one.unionByName(two)


def degrees(edges: DataFrame) -> DataFrame:
    """Rows (id, degree); a self-loop counts twice."""
    return incidence(edges.select("id", "from_id", "to_id")).groupBy("id").agg(F.count("*").alias("degree"))


def corridors(edges: DataFrame, region_of: DataFrame) -> DataFrame:
    """Edges between regions, by unordered pair: count, leading sigma, weight.

    region_of: id, region. The leading sigma is the most frequent, ties by name. Quarantined
    edges count, and weigh 0.35. Sigmas are counted before pairs meet, so a busy pair is a sum.
    """
    a = region_of.select(F.col("id").alias("from_id"), F.col("region").alias("ra"))
    b = region_of.select(F.col("id").alias("to_id"), F.col("region").alias("rb"))
    weight = F.col("weight") * F.when(F.col("quarantined"), 0.35).otherwise(1.0)
    both = edges.join(a, "from_id").join(b, "to_id").where("ra <> rb")
    pairs = both.groupBy(F.least("ra", "rb").alias("region_a"), F.greatest("ra", "rb").alias("region_b"), "sigma").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    return pairs.groupBy("region_a", "region_b").agg(
        F.sum("n").alias("edges"), F.round(F.sum("w"), 6).alias("weight"), F.min_by("sigma", F.struct(-F.col("n"), "sigma")).alias("sigma")
    )


def corridor_exemplars(edges: DataFrame, region_of: DataFrame, each: int = EXEMPLARS, cap: int = BUNDLE_CAP) -> DataFrame:
    """The heaviest edges of each of the busiest corridors."""
    a = region_of.select(F.col("id").alias("from_id"), F.col("region").alias("ra"))
    b = region_of.select(F.col("id").alias("to_id"), F.col("region").alias("rb"))
    busy = corridors(edges, region_of).orderBy(F.desc("edges"), "region_a", "region_b").limit(cap).select("region_a", "region_b")
    both = edges.join(a, "from_id").join(b, "to_id").where("ra <> rb").select("id", "weight", F.least("ra", "rb").alias("region_a"), F.greatest("ra", "rb").alias("region_b"))
    rank = F.row_number().over(Window.partitionBy("region_a", "region_b").orderBy(F.desc("weight"), "id"))
    return both.join(F.broadcast(busy), ["region_a", "region_b"]).withColumn("rank", rank).where(F.col("rank") <= each)


def crossing(edges: DataFrame, region_of: DataFrame) -> DataFrame:
    """Edges with crosses_strait: both regions are known and differ."""
    a = region_of.select(F.col("id").alias("from_id"), F.col("region").alias("__a"))
    b = region_of.select(F.col("id").alias("to_id"), F.col("region").alias("__b"))
    return edges.join(a, "from_id", "left").join(b, "to_id", "left").withColumn("crosses_strait", F.coalesce(F.col("__a") != F.col("__b"), F.lit(False))).drop("__a", "__b")


def gate_admits(structural: Column, confidence: Column, evidence: Column) -> Column:
    """Structural edges pass; others need the confidence floor and evidence."""
    return structural | ((confidence >= CONFIDENCE_FLOOR) & (evidence > 0))


def integrity_by_reason(edges: DataFrame, examples: int = 4) -> DataFrame:
    """Rows (reason, edges, examples): quarantined edges, with the smallest ids of each reason.

    Ranks are cut before rows are gathered, so that a frequent reason sends few.
    """
    bad = edges.where("quarantined").select("reason", "id")
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("id"))
    few = bad.withColumn("n", rank).where(F.col("n") <= examples).groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    return bad.groupBy("reason").agg(F.count("*").alias("edges")).join(few, "reason")


def integrity_report(edges: DataFrame) -> DataFrame:
    """One row: totals, and edges whose quarantine and reason or gate disagree."""
    gate = gate_admits(F.col("sigma") == "structural", F.col("confidence"), F.size("evidence"))
    return edges.agg(
        F.count("*").alias("total"),
        F.count(F.when(~F.col("quarantined"), 1)).alias("admitted"),
        F.count(F.when(F.col("quarantined"), 1)).alias("quarantined"),
        F.count(F.when(F.col("sigma") == "structural", 1)).alias("exempt"),
        F.count(F.when(F.col("quarantined") != F.col("reason").isNotNull(), 1)).alias("inconsistent"),
        F.count(F.when(~F.col("quarantined") & ~gate, 1)).alias("admitted_against_gate"),
    )


def timeline(assets: DataFrame, edges: DataFrame, start: str, end: str, limit: int = 200, quarantined: bool = False) -> DataFrame:
    """Boundary events of assets and dated edges in an inclusive window, by (at, id)."""
    shown = edges if quarantined else edges.where("NOT quarantined")
    events = assets.select("at", "id", F.lit("boundary").alias("event")).unionByName(
        shown.where("sigma IN ('temporal', 'episodic')").select("at", "id", F.col("family").alias("event"))
    )
    return events.where(F.col("at").between(start, end)).orderBy("at", "id").limit(limit)


def envelope(events: DataFrame, bins: int = 72) -> DataFrame:
    """Rows (bin, events, height): events by share of the span, heights relative to the fullest bin."""
    span = events.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    seconds = lambda c: F.unix_timestamp(F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss")).cast("double")
    share = (seconds(F.col("at")) - seconds(F.col("a"))) / F.greatest(seconds(F.col("b")) - seconds(F.col("a")), F.lit(1.0))
    counts = events.crossJoin(F.broadcast(span)).groupBy(F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("events"))  # one row
    top = counts.agg(F.max("events").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("bin", "events", F.round(F.col("events") / F.col("top"), 6).alias("height"))  # one row


def region_rollup(children: DataFrame, edges: DataFrame, region_of: DataFrame) -> DataFrame:
    """Rows (region, members, mass, degree): members' centrality as a share of the largest, and
    the number of edges with an end in the region (once an edge)."""
    mass = children.groupBy("region").agg(F.count("*").alias("members"), F.sum("centrality").alias("m"))
    ends = incidence(edges.select("id", "from_id", "to_id")).join(region_of, "id").select("edge_id", "region").distinct()
    degree = ends.groupBy("region").agg(F.count("*").alias("degree"))
    top = mass.agg(F.max("m").alias("top"))
    return (
        mass.join(degree, "region", "left")
        .crossJoin(F.broadcast(top))  # one row
        .select("region", "members", F.round(F.when(F.col("top") > 0, F.col("m") / F.col("top")).otherwise(0.0), 6).alias("mass"), F.coalesce("degree", F.lit(0)).alias("degree"))
    )


def bridges(mentions: DataFrame) -> DataFrame:
    """Rows (id, islands): entities that passages of more than one island mention; (id, island) in."""
    return mentions.distinct().groupBy("id").agg(F.count("*").alias("islands")).where("islands > 1")


def world_stats(nodes: DataFrame, edges: DataFrame, entities: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (measure, key, value): the world's measures, each table read in one aggregation.

    nodes: kind, community; edges: family, sigma, quarantined, reason, crosses_strait; entities:
    is_bridge; passages: resolution, tokens; sources: chars. Histograms have a row for each key;
    rates are 0 where there is nothing to divide by.
    """
    row = lambda name, key, value: F.struct(F.lit(name).alias("measure"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    no = F.lit(None)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(row("nodes_by_kind", F.col("kind"), F.col("n")).alias("r"))
    totals = nodes.agg(F.count("*").alias("n"), F.countDistinct("community").alias("c")).select(F.explode(F.array(row("nodes_total", no, F.col("n")), row("communities", no, F.col("c")))).alias("r"))
    # edges are counted once by all that is asked of them, and the few combinations are added up
    by = edges.groupBy("family", "sigma", "quarantined", "reason", "crosses_strait").agg(F.count("*").alias("n"))
    sigmas = by.groupBy("sigma").agg(F.sum("n").alias("n")).select(row("edges_by_sigma", F.col("sigma"), F.col("n")).alias("r"))
    reasons = by.where("quarantined").groupBy(F.coalesce("reason", F.lit("unspecified")).alias("reason")).agg(F.sum("n").alias("n")).select(row("quarantine_by_reason", F.col("reason"), F.col("n")).alias("r"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = by.agg(
        of(F.lit(True)).alias("all"), of(F.col("sigma") != "structural").alias("semantic"), of(F.col("quarantined")).alias("bad"), of(F.col("crosses_strait")).alias("strait"), F.countDistinct("family").alias("families")
    )
    edge_rows = sums.select(
        F.explode(
            F.array(
                row("edges_total", no, F.col("all")),
                row("edges_semantic", no, F.col("semantic")),
                row("edges_structural", no, F.col("all") - F.col("semantic")),
                row("quarantined", no, F.col("bad")),
                row("quarantine_rate", no, share(F.col("bad"), F.col("semantic"))),
                row("strait_edges", no, F.col("strait")),
                row("distinct_families_used", no, F.col("families")),
            )
        ).alias("r")
    )
    bridges = entities.agg(F.count("*").alias("n"), F.count_if("is_bridge").alias("b")).select(F.explode(F.array(row("bridge_entities", no, F.col("b")), row("bridge_entity_rate", no, share(F.col("b"), F.col("n"))))).alias("r"))
    told = passages.agg(F.count("*").alias("n"), F.count_if(F.col("resolution") != "verbatim").alias("b"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    told = told.select(F.explode(F.array(row("resolved_passages", no, F.col("b")), row("resolution_rate", no, share(F.col("b"), F.col("n"))), row("tokens_total", no, F.col("t")))).alias("r"))
    chars = sources.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("c")).select(row("source_characters", no, F.col("c")).alias("r"))
    out = kinds
    for t in (totals, sigmas, reasons, edge_rows, bridges, told, chars):
        out = out.unionByName(t)
    return out.select("r.*")


def source_centrality(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows (id, centrality): each source has that of its most central asset (source_id, centrality), 0 without."""
    best = assets.groupBy(F.col("source_id").alias("id")).agg(F.max("centrality").alias("best"))
    return sources.select("id").join(best, "id", "left").select("id", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("centrality"))


def family_usage(edges: DataFrame, families: DataFrame) -> DataFrame:
    """Each family of the vocabulary with its edges, the admitted ones, and those whose sigma isn't the family's.

    Families that edges have and the vocabulary lacks come with a null sigma.
    """
    used = edges.groupBy("family", F.col("sigma").alias("__sigma")).agg(F.count("*").alias("n"), F.count_if(~F.col("quarantined")).alias("ok"))
    both = families.join(used, "family", "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy("family", "sigma", "inverse", "label", "truth_gated", "self_inverse").agg(
        zero("n").alias("edges"), zero("ok").alias("admitted"), zero(F.when(~F.col("__sigma").eqNullSafe(F.col("sigma")), F.col("n"))).alias("other_sigma")
    )


def reading_fiber(passages: DataFrame) -> DataFrame:
    """Rows (from_id, to_id, family): neighbours in reading order both ways, and _co_doc two apart."""
    w = Window.partitionBy("parent_id").orderBy("seq", "id")
    near = passages.select("id", F.lead("id", 1).over(w).alias("next"), F.lead("id", 2).over(w).alias("second"))
    rows = F.array(
        F.struct(F.col("next").alias("from_id"), F.col("id").alias("to_id"), F.lit("_follows").alias("family")),
        F.struct(F.col("id").alias("from_id"), F.col("next").alias("to_id"), F.lit("_precedes").alias("family")),
        F.struct(F.col("id").alias("from_id"), F.col("second").alias("to_id"), F.lit("_co_doc").alias("family")),
    )
    return near.select(F.inline(rows)).where("from_id IS NOT NULL AND to_id IS NOT NULL")


def session_fiber(sessions: DataFrame) -> DataFrame:
    """Rows (from_id, to_id, family): sessions of a region linked by date, both ways; (id, region, at) in.

    Neighbours meet by their rank over all sessions, so that a region may have any number.
    """
    from .topology import followed

    near = written(followed(sessions, "region", "at"), "fiber")
    return near.select(F.col("next").alias("from_id"), F.col("id").alias("to_id"), F.lit("_session_follows").alias("family")).unionByName(
        near.select(F.col("id").alias("from_id"), F.col("next").alias("to_id"), F.lit("_session_precedes").alias("family"))
    )


def mentioned_before(mentions: DataFrame, most: int = 3) -> DataFrame:
    """Rows (parent_id, from_id, to_id): each entity and the one first met next, strictly later."""
    first = mentions.groupBy("parent_id", "id").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("parent_id").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    later = first.withColumn("to_id", F.min(F.struct("seq", "id")).over(w)["id"]).where("to_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("seq", "id"))
    return later.withColumn("n", rank).where(F.col("n") <= most).select("parent_id", F.col("id").alias("from_id"), "to_id")


def vocabulary_problems(families: DataFrame) -> DataFrame:
    """Rows (family, problem): inverses that don't point back, sigma differences, wrong prefixes, repeats."""
    other = families.select(F.col("family").alias("inverse"), F.col("inverse").alias("back"), F.col("sigma").alias("other_sigma"))
    joined = families.join(other, "inverse", "left")
    checks = F.filter(
        F.array(
            F.when(F.col("inverse").isNotNull() & ~F.col("back").eqNullSafe(F.col("family")), "inverse_not_mutual"),
            F.when(F.col("other_sigma") != F.col("sigma"), "sigma_differs"),
            F.when(F.startswith("family", F.lit("_")) != (F.col("sigma") == "structural"), "prefix"),
        ),
        lambda x: x.isNotNull(),
    )
    return joined.select("family", F.explode(checks).alias("problem")).unionByName(families.groupBy("family").count().where("count > 1").select("family", F.lit("repeated").alias("problem")))


def scope_assets(nodes: DataFrame, scope: str) -> DataFrame:
    """Rows (id): assets that a scope stands for: a continent's or island's, an asset itself, and
    for anything else its owner; without one, the scope's own id."""
    own = nodes.where(F.col("id") == scope).select("kind", F.col("parent_id").alias("owner"))
    assets = nodes.where("kind = 'asset'").select("id", F.col("parent_id").alias("island"))
    islands = nodes.where("kind = 'island'").select(F.col("id").alias("island"), F.col("parent_id").alias("continent"))
    below = assets.join(islands, "island", "left").where((F.col("island") == scope) | (F.col("continent") == scope)).select("id")
    rest = own.where("kind NOT IN ('continent', 'island')").select(F.when(F.col("kind") == "asset", F.lit(scope)).otherwise(F.coalesce("owner", F.lit(scope))).alias("id"))
    return below.unionByName(rest).distinct()


def constellation(edges: DataFrame, gold_edges: DataFrame, gold_nodes: DataFrame) -> DataFrame:
    """Edges of an answer: those named (id), and those with both ends among the named nodes (id)."""
    named = edges.join(gold_edges.select("id"), "id", "left_semi")
    return named.unionByName(among(edges, gold_nodes).select(*edges.columns)).dropDuplicates(["id"])


def corroborated(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rows (id, passage_id): the first other passage that holds both ends of an edge.

    edges: id, from_id, to_id, primary; mentions: id, passage_id, seq. Nodes of a passage are
    paired, and pairs meet edges, so that a node of very many edges and passages doesn't bring
    each of its edges together with each of its passages. Passages of more than ``PAIRED``
    mentions, whose pairs would be too many, go by the edges of their nodes instead.
    """
    a = edges.select(F.col("id").alias("edge_id"), "from_id", "to_id", "primary")
    n = F.count("*").over(Window.partitionBy("passage_id"))
    said = written(mentions.select("id", "passage_id", "seq").withColumn("n", n), "mentions")
    few, many = said.where(F.col("n") <= PAIRED).drop("n"), said.where(F.col("n") > PAIRED).drop("n")
    one, two = lambda t: t.withColumnRenamed("id", "from_id"), lambda t: t.select(F.col("id").alias("to_id"), "passage_id")
    both = one(few).join(two(few), "passage_id").join(a, ["from_id", "to_id"]).select("edge_id", "passage_id", "seq", "primary")
    if not many.isEmpty():
        wide = a.join(one(many), "from_id").join(two(many), ["to_id", "passage_id"])
        both = both.unionByName(wide.select("edge_id", "passage_id", "seq", "primary"))
    both = both.where("passage_id <> primary")
    return both.groupBy(F.col("edge_id").alias("id")).agg(F.min(F.struct("seq", "passage_id"))["passage_id"].alias("passage_id"))


def passage_offsets(passages: DataFrame, separator: int = 2) -> DataFrame:
    """Adds char_start and char_end in the joined document, and the span's hash.

    passages: parent_id, seq, id, text. The hash is 'sha256:' and 32 hex digits.
    """
    w = Window.partitionBy("parent_id").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + separator).over(w), F.lit(0)).cast("long")
    return passages.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text")).withColumn("span_hash", F.concat(F.lit("sha256:"), F.substring(F.sha2("text", 256), 1, 32)))


def first_periods(mentions: DataFrame) -> DataFrame:
    """Rows (from_id, to_id, family): each asset covers the period it mentions first; (parent_id, id, seq) in."""
    first = mentions.groupBy("parent_id").agg(F.min(F.struct("seq", "id"))["id"].alias("to_id"))
    return first.select(F.col("parent_id").alias("from_id"), "to_id", F.lit("_covers_period").alias("family"))


def truth_gated_rate(edges: DataFrame) -> DataFrame:
    """One row (gated, rate): edges that the gate applies to, and the quarantined share of them."""
    report = integrity_report(edges).withColumn("gated", F.col("total") - F.col("exempt"))
    return report.select("gated", F.when(F.col("gated") > 0, F.col("quarantined") / F.col("gated")).otherwise(0.0).alias("rate"))


def entity_overlay(entities: DataFrame, places: DataFrame, view: DataFrame) -> DataFrame:
    """Entities (id, centrality, ...) that have a place (id, place_id: asset, passage or island) in
    the view (id), the most central first."""
    seen = places.join(view.select(F.col("id").alias("place_id")), "place_id", "left_semi").select("id").distinct()
    return entities.join(seen, "id", "left_semi").orderBy(F.desc("centrality"), "id")


def hover_edges(edges: DataFrame, view: DataFrame, hovered: str, hops: int = 1, cap: int = EDGE_CAP, most_nodes: int = 4096) -> DataFrame:
    """The heaviest edges of a view (id) with either end within ``hops`` of the hovered node."""
    from .paths import hop_closure

    near = hop_closure(edges, view.sparkSession.createDataFrame([(hovered,)], "id string"), max(1, hops), most_nodes).select("id")
    inside = among(edges, view)
    either = [inside.join(near.select(F.col("id").alias(end)), end, "left_semi").select(*edges.columns) for end in ("from_id", "to_id")]
    return either[0].unionByName(either[1]).dropDuplicates(["id"]).orderBy(F.desc("weight"), "id").limit(cap)


def scoped_timeline(assets: DataFrame, edges: DataFrame, owners: DataFrame, scope: DataFrame, start: str, end: str, limit: int = 200) -> DataFrame:
    """Rows (at, id, event, truncated): the timeline of the assets in ``scope`` (id).

    A dated edge is in scope if an end or a passage of its evidence belongs (owners: id,
    asset_id) to one of them. truncated is how many events the limit leaves out.
    """
    held = owners.join(scope.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").select(F.col("id").alias("part")).distinct()
    dated = edges.where("NOT quarantined AND sigma IN ('temporal', 'episodic')").where(F.col("at").between(start, end))
    parts = F.concat(F.array("from_id", "to_id"), F.coalesce("evidence", F.array().cast("array<string>")))
    touching = dated.select("id", F.explode(parts).alias("part")).join(held, "part", "left_semi").select("id").distinct()
    own = assets.join(scope.select("id"), "id", "left_semi").where(F.col("at").between(start, end)).select("at", "id", F.lit("boundary").alias("event"))
    events = own.unionByName(dated.join(touching, "id", "left_semi").select("at", "id", F.col("family").alias("event")))
    total = events.agg(F.greatest(F.count("*") - max(1, limit), F.lit(0)).alias("truncated"))
    return events.orderBy("at", "id").limit(max(1, limit)).crossJoin(F.broadcast(total))  # one row
