"""Answers under a token budget: matching, citations, admission, and the account of it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TERM_BREAK, content_terms, question_fit, token_count

#: Fixed values.
BUDGET, CITATIONS, SLOTS, POINTERS = 10_000, 5, 8, 128
WEIGHTS = {"semantic": 0.40, "topology": 0.25, "temporal": 0.10, "authorial": 0.25}


def citation_cost(quote: Column) -> Column:
    return token_count(quote) + 128


def summary_cost(mentions: Column, assets: Column) -> Column:
    return 128 + 12 * mentions + 24 * assets


def pointer_cost(mentions: Column, assets: Column) -> Column:
    return 30 + mentions + assets


def entity_matches(query: str, entities: DataFrame) -> DataFrame:
    """Rows (id, label, score): entities whose label words the query has; summed lengths plus centrality.

    Words of three characters or more count as often as they occur, stopwords too.
    """
    low = F.lit(query.lower())
    words = F.filter(F.split(F.lower("label"), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & low.contains(w))
    score = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return entities.select("id", "label", score.alias("n"), "centrality").where("n > 0").select("id", "label", (F.col("n") + F.col("centrality")).alias("score"))


def evidence_edges(edges: DataFrame, node: str, take: int = 3) -> DataFrame:
    """The surest edges at a node that aren't quarantined and have evidence, ties by id."""
    at = (F.col("from_id") == node) | (F.col("to_id") == node)
    return edges.where(at & ~F.col("quarantined") & (F.size("evidence") > 0)).orderBy(F.desc("confidence"), "id").limit(take)


def candidate_passages(hops: DataFrame, passages: DataFrame, query: str) -> DataFrame:
    """Evidence of hops (place, evidence, confidence) as passages, each at its first place, scored
    half by question fit and half by confidence."""
    rows = hops.select("place", "confidence", F.posexplode("evidence").alias("k", "id"))
    first = rows.groupBy("id").agg(F.min(F.struct("place", "k", "confidence")).alias("x")).select("id", "x.place", "x.k", "x.confidence")
    terms = content_terms(F.lit(query))
    score = 0.5 * question_fit(terms, F.col("text")) + 0.5 * F.col("confidence")
    return first.join(passages.select("id", "text"), "id").select("id", "place", "k", "text", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def budgeted(rows: DataFrame, order: list, budget: int, most: int, scope: list[str] | None = None) -> DataFrame:
    """Rows up to the first that overflows the budget, at most ``most`` of them, per scope."""
    w = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(*order)
    numbered = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)  # cut before the sum
    return numbered.withColumn("spent", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("spent") <= budget)


def admission(candidates: DataFrame, budget: int, slots: int = SLOTS, scope: str = "question", spent: str | None = None) -> DataFrame:
    """Rows (scope, id, lod, cost): candidates in order, those that overflow skipped, not ending it.

    candidates: scope, place, id, on_path, mentions, assets, and what of the budget is gone
    before (column ``spent``, the same for all of a scope). A node on the path, and the first
    ``slots`` admitted, come as summaries (lod 1), others as pointers (lod 2). Whether a node
    fits depends on all before it, so a question's ordered candidates (its path's neighbours,
    hundreds) are folded as one array.
    """
    kind = "array<struct<id:string,lod:int,cost:long>>"
    rows = F.sort_array(F.collect_list(F.struct("place", "id", "on_path", "mentions", "assets")))
    before = F.lit(0) if spent is None else F.max(spent)
    start = F.struct(before.cast("long").alias("spent"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))

    def step(a: Column, c: Column) -> Column:
        full = c["on_path"] | (a["n"] < slots)
        cost = F.when(full, summary_cost(c["mentions"], c["assets"])).otherwise(pointer_cost(c["mentions"], c["assets"])).cast("long")
        fits = a["spent"] + cost <= budget
        lod = F.when(~fits, 0).when(full, 1).otherwise(2)
        return F.struct(
            F.when(fits, a["spent"] + cost).otherwise(a["spent"]).alias("spent"),
            (a["n"] + fits.cast("int")).alias("n"),
            F.concat(a["out"], F.array(F.struct(c["id"].alias("id"), lod.alias("lod"), F.when(fits, cost).otherwise(F.lit(0).cast("long")).alias("cost"))).cast(kind)).alias("out"),
        )

    folded = candidates.groupBy(scope).agg(F.aggregate(rows, start, step, lambda a: a["out"]).alias("out"))
    return folded.select(scope, F.inline("out"))


def omitted(evicted: DataFrame, admitted: DataFrame, touching: DataFrame, cap: int = POINTERS) -> DataFrame:
    """Rows (id, reason): evicted nodes, then connected ones that weren't admitted, up to the cap.

    touching: id, quarantined, structural, one row for each link to an admitted node.
    """
    reason = F.when(F.min("quarantined"), "reached_only_through_quarantined_edge").when(F.min("structural"), "structural_link_only").otherwise("below_threshold")
    rest = touching.join(admitted.select("id"), "id", "left_anti").join(evicted.select("id"), "id", "left_anti").groupBy("id").agg(reason.alias("reason"))
    return evicted.select("id", F.lit("budget_exhausted").alias("reason")).unionByName(rest.orderBy("id").limit(cap))


def render_stats(admitted: DataFrame, whole: DataFrame, scope: str = "question") -> DataFrame:
    """Rows (scope, summaries, pointers, evicted, tokens, counterfactual, saved_pct)."""
    part = admitted.groupBy(scope).agg(
        F.count(F.when(F.col("lod") == 1, 1)).alias("summaries"),
        F.count(F.when(F.col("lod") == 2, 1)).alias("pointers"),
        F.count(F.when(F.col("lod") == 0, 1)).alias("evicted"),
        F.sum("cost").alias("tokens"),
    )
    saved = F.when(F.col("counterfactual") > 0, F.round(100.0 * (1 - F.col("tokens") / F.col("counterfactual")), 1)).otherwise(0.0)
    return part.join(whole, scope).withColumn("saved_pct", saved)


def composite(signals: DataFrame, scope: str = "question") -> DataFrame:
    """Rows (scope, composite): the weighted mean of the signals there are, to two places."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + F.coalesce(F.col(name) * w, F.lit(0.0))
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    return signals.select(scope, F.when(weight > 0, F.round(total / weight, 2)).alias("composite"))


def families_used(edges: DataFrame) -> DataFrame:
    """Rows (family, edges) of edges that aren't quarantined."""
    return edges.where("NOT quarantined").groupBy("family").agg(F.count("*").alias("edges"))


def trace_problems(citations: DataFrame, admitted: DataFrame, left_out: DataFrame) -> DataFrame:
    """Rows (problem, rows) of what a trace may not have."""
    count = lambda name, t: t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("problem"), "rows")
    parts = [
        count("blank_quote", citations.where("trim(coalesce(quote, '')) = ''")),
        count("score_range", citations.where("score < 0 OR score > 1 OR score IS NULL")),
        count("hash_prefix", citations.where("content_hash NOT LIKE 'sha256:%' OR content_hash IS NULL")),
        count("admitted_twice", admitted.groupBy("id").count().where("count > 1")),
        count("omitted_and_admitted", left_out.join(admitted.select("id"), "id", "left_semi")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("rows > 0")


def traces_checked(traces: DataFrame, citations: DataFrame, admitted: DataFrame, omitted_: DataFrame) -> DataFrame:
    """Rows (trace_id, problem, rows): what traces may not have; a trace without faults has none.

    citations: trace_id, passage_id, quote, content_hash, tokens, score; admitted: trace_id, id,
    tokens, score; omitted: trace_id, id, hop. A citation is an admission of its passage too.
    Rows of a trace are held against all rules in one pass; repeats and what is both admitted
    and omitted are found by grouping.
    """
    named = lambda rows, checks: rows.select("trace_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("problem"))
    score = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    whole = lambda least: F.col("tokens").isNull() | (F.col("tokens") != F.floor("tokens")) | (F.col("tokens") < least)
    told = named(
        citations,
        {
            "hash_prefix": ~F.coalesce(F.startswith("content_hash", F.lit("sha256:")), F.lit(False)),
            "blank_quote": F.trim(F.coalesce("quote", F.lit(""))) == "",
            "citation_cost": whole(1),
            "score_range": score,
        },
    )
    nodes = named(admitted, {"admission_cost": whole(0), "score_range": score})
    hops = named(omitted_, {"pointer_hop": F.col("hop").isNull() | (F.col("hop") < 1) | (F.col("hop") != F.floor("hop"))})
    every = citations.select("trace_id", F.col("passage_id").alias("id"), F.lit(1).alias("c"), F.lit(0).alias("a"), F.lit(0).alias("o"))
    every = every.unionByName(admitted.select("trace_id", "id", F.lit(0).alias("c"), F.lit(1).alias("a"), F.lit(0).alias("o")))
    every = every.unionByName(omitted_.select("trace_id", "id", F.lit(0).alias("c"), F.lit(0).alias("a"), F.lit(1).alias("o")))
    ids = every.groupBy("trace_id", "id").agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.sum("o").alias("o"))
    both = named(ids, {"cited_twice": F.col("c") > 1, "admitted_twice": (F.col("a") + F.col("c") > 1) & (F.col("a") > 0), "omitted_and_admitted": (F.col("o") > 0) & (F.col("a") + F.col("c") > 0)})
    none = traces.select("trace_id").join(citations.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.lit("no_citation").alias("problem"))
    rows = told.unionByName(nodes).unionByName(hops).unionByName(both).unionByName(none)
    return rows.groupBy("trace_id", "problem").agg(F.count("*").alias("rows"))


def counterfactual(touched: DataFrame, assets: DataFrame, spent: int) -> DataFrame:
    """One row (tokens, widened): what reading all touched assets costs; if that is less than was
    spent, what their whole islands cost. touched: id; assets: id, island, tokens."""
    own = assets.join(touched.select("id").distinct(), "id", "left_semi")
    wide = assets.join(own.select("island").distinct(), "island", "left_semi")
    sums = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("a")).crossJoin(wide.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("b")))  # one row each
    return sums.select(F.when(F.col("a") < spent, F.col("b")).otherwise(F.col("a")).alias("tokens"), (F.col("a") < spent).alias("widened"))


def signals(cited: DataFrame, admitted: DataFrame, links: DataFrame, path: DataFrame) -> DataFrame:
    """One row (semantic, topology, temporal, authorial), null where a signal has nothing to go by.

    semantic is the mean score of citations; topology the share of admitted nodes that the path
    reaches over admitted links; temporal the admitted share of temporal edges; authorial half
    the verbatim share and half the share of distinct sources. cited: score, verbatim, source_id;
    links: id, from_id, to_id, sigma, quarantined, evidence; path: id.
    """
    from .graph import among
    from .paths import hop_closure

    inside = among(links, admitted)
    reached = hop_closure(inside, path.join(admitted.select("id"), "id", "left_semi"), 24).select("id")
    n = admitted.agg(F.count("*").alias("n"))
    r = admitted.join(reached, "id", "left_semi").agg(F.count("*").alias("r"))
    t = links.where("sigma = 'temporal'").agg(F.count("*").alias("t"), F.count(F.when(~F.col("quarantined"), 1)).alias("ta"))
    c = cited.agg(F.avg("score").alias("semantic"), F.count("*").alias("c"), F.count(F.when(F.col("verbatim"), 1)).alias("v"), F.countDistinct("source_id").alias("s"))
    one = n.crossJoin(r).crossJoin(t).crossJoin(c)  # one row each
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return one.select("semantic", share("r", "n").alias("topology"), share("ta", "t").alias("temporal"), (0.5 * share("v", "c") + 0.5 * share("s", "c")).alias("authorial"))


def lexical_matches(query: str, entities: DataFrame) -> DataFrame:
    """Rows (id, label, score) of entities (id, label, aliases, centrality) that a question names.

    The lengths of the question's terms of three characters or more that the label or an alias
    contains, repeated terms and stopwords included, plus the centrality.
    """
    text = F.lower(F.concat_ws(" ", "label", F.concat_ws(" ", "aliases")))
    terms = F.filter(F.split(F.lit(query.lower()), TERM_BREAK), lambda t: F.length(t) > 2)
    hits = F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(text.contains(t), F.length(t)).otherwise(0))
    return entities.select("id", "label", hits.alias("hits"), "centrality").where("hits > 0").select("id", "label", (F.col("hits") + F.col("centrality")).alias("score"))


def best_match(matches: DataFrame) -> DataFrame:
    """One row (best, score, second, error): the best match, and the best of those before it.

    Matches are in order of id, and the first of equal scores is the best; second isn't the
    runner-up of all but of the rows before the best. error is QUERY_NO_MATCH without a match.
    """
    top = matches.groupBy("score").agg(F.min("id").alias("id")).agg(F.max_by(F.struct("id", "score"), "score").alias("b")).select(F.col("b.id").alias("best"), F.col("b.score").alias("score"))
    before = matches.join(F.broadcast(top.select("best")), F.col("id") < F.col("best"))  # one row
    after = before.groupBy("score").agg(F.min("id").alias("id")).agg(F.max_by("id", "score").alias("second"))
    return top.crossJoin(after).select("best", "score", "second", F.when(F.col("best").isNull(), "QUERY_NO_MATCH").alias("error"))  # one row each


def dispatched(questions: DataFrame, pinned: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows (question, route, query_id): pinned, then staged by id or by text, else free.

    questions: question, text; pinned: text, query_id; staged: query_id, text. Texts are compared
    trimmed and lower-cased; of several entries the smallest id counts.
    """
    key = F.lower(F.trim("text"))
    asked = questions.select("question", key.alias("key"))
    one = pinned.groupBy(key.alias("key")).agg(F.min("query_id").alias("p"))
    named = staged.select(F.lower("query_id").alias("key"), "query_id").unionByName(staged.select(key.alias("key"), "query_id")).groupBy("key").agg(F.min("query_id").alias("s"))
    found = asked.join(one, "key", "left").join(named, "key", "left")
    route = F.when(F.col("p").isNotNull(), "pinned").when(F.col("s").isNotNull(), "staged").otherwise("free")
    return found.select("question", route.alias("route"), F.coalesce("p", "s").alias("query_id"))


def staged_answers(staged: DataFrame, families: DataFrame) -> DataFrame:
    """Rows (query_id, answer): the answer, and its chain in words, if it has one.

    staged: query_id, gold, chain (array of subject, family, object); families: family, label.
    """
    steps = staged.select("query_id", F.posexplode("chain").alias("k", "c")).select("query_id", "k", "c.subject", "c.family", "c.object")
    said = steps.join(families.select("family", "label"), "family", "left").select("query_id", F.struct("k", F.concat_ws(" ", "subject", F.coalesce("label", "family"), "object").alias("text")).alias("t"))
    chains = said.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["text"]), "; ").alias("chain"))
    answer = F.concat("gold", F.lit("."), F.coalesce(F.concat(F.lit(" "), F.col("c.chain"), F.lit(".")), F.lit("")))
    return staged.alias("s").join(chains.alias("c"), "query_id", "left").select("query_id", answer.alias("answer"))


def staged_seeds(staged: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (query_id, id): ends of the gold edges, and the gold nodes that are no passages."""
    gold = staged.select("query_id", F.explode("gold_edge_ids").alias("id")).join(edges.select("id", "from_id", "to_id"), "id")
    ends = gold.select("query_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    named = staged.select("query_id", F.explode("gold_node_ids").alias("id")).join(nodes.where("kind <> 'passage'").select("id"), "id", "left_semi")
    return ends.unionByName(named.select("query_id", "id")).distinct()


def candidate_nodes(path: DataFrame, seeds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (id, kind, on_path, centrality): what an answer may admit, in order of admission.

    Nodes of the path (from_id, to_id), seeds (id), and neighbours of the path's nodes by edges
    that aren't quarantined; entities, and assets that are on the path.
    """
    from .graph import incidence

    own = path.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    near = incidence(edges.where("NOT quarantined").select("id", "from_id", "to_id")).join(own, "id", "left_semi").select(F.col("other").alias("id"))
    ids = own.unionByName(seeds.select("id")).unionByName(near).distinct().join(own.withColumn("__on", F.lit(True)), "id", "left")
    rows = ids.join(nodes, "id").select("id", "kind", F.coalesce("__on", F.lit(False)).alias("on_path"), "centrality")
    return rows.where("kind = 'entity' OR kind = 'asset' AND on_path").orderBy(F.desc("on_path"), F.desc("centrality"), "id")


def mention_links(cited: DataFrame, mentions: DataFrame, admitted: DataFrame) -> DataFrame:
    """Rows (passage_id, entity_ids): the admitted entities that each cited passage mentions."""
    held = mentions.select("passage_id", "id").distinct().join(admitted.select("id"), "id", "left_semi")
    lists = held.groupBy("passage_id").agg(F.sort_array(F.collect_list("id")).alias("entity_ids"))
    return cited.select("passage_id").distinct().join(lists, "passage_id", "left").select("passage_id", F.coalesce("entity_ids", F.array().cast("array<string>")).alias("entity_ids"))
