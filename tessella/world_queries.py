"""Queries of the operators that settle, check and mine a whole graph, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import text as T
from .functions import vocabulary
from .operators import answering, answers, diffs, graph, layout, mining, paths, portable, render, search, topology, trust, validation, verdicts
from .operators import provenance as P
from .operators.graph import QUARANTINE_REASONS


@query(
    """, n AS (SELECT path_id, id, count(*) AS degree, sum(o) AS o, min(a) AS a FROM (
            SELECT path_id, from_id AS id, 2 * step AS a, 1 AS o FROM answer_paths UNION ALL SELECT path_id, to_id, 2 * step + 1, 0 FROM answer_paths) GROUP BY ALL),
       w AS (SELECT path_id, count(*) = sum(degree) / 2 + 1 AND count(*) FILTER (degree = 1) = 2 AND count(*) FILTER (degree > 2 OR degree = 2 AND o <> 1) = 0 AS chain,
            arg_min(id, a) FILTER (degree = 1) AS s, arg_max(id, a) FILTER (degree = 1) AS e FROM n GROUP BY path_id),
       ends AS MATERIALIZED (SELECT path_id, CASE WHEN chain THEN s END AS s, CASE WHEN chain THEN e END AS e FROM w),
       pairs AS (SELECT DISTINCT s, e FROM ends WHERE s IS NOT NULL),
       c AS (SELECT id, from_id, to_id, 1 - confidence * CASE WHEN len(evidence) > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS c FROM trade_edges WHERE NOT quarantined),
       near AS MATERIALIZED (SELECT from_id AS a, to_id AS b, id, c FROM c UNION ALL SELECT to_id, from_id, id, c FROM c),
       one AS MATERIALIZED (SELECT a AS s, b AS m, min(c) AS c, arg_min(id, (c, id)) AS id FROM near WHERE a IN (SELECT s FROM pairs) GROUP BY ALL),
       direct AS (SELECT pairs.s, pairs.e, 1 AS hops, c AS cost, [id] AS route FROM pairs JOIN one ON one.s = pairs.s AND m = e),
       two AS (SELECT p.s, p.e, 2 AS hops, min(o.c + n.c) AS cost, arg_min([o.id, n.id], (o.c + n.c, m, n.id)) AS route
            FROM (SELECT * FROM pairs ANTI JOIN direct USING (s, e)) p JOIN one o ON o.s = p.s JOIN near n ON n.a = o.m AND n.b = p.e GROUP BY ALL),
       routes AS (FROM direct UNION ALL FROM two),
       own AS (SELECT path_id, count(*) AS steps, list(edge_id) AS edges FROM answer_paths GROUP BY path_id)
       SELECT path_id, CASE WHEN s IS NULL THEN 'not-a-chain' WHEN hops IS NULL THEN 'no-admitted-route' WHEN hops = steps AND list_has_all(edges, route) THEN 'identical' ELSE 'differs' END AS verdict,
              s AS start, e AS "end", steps, hops::BIGINT AS hops, round(cost, 6) AS cost
       FROM ends JOIN own USING (path_id) LEFT JOIN routes USING (s, e)""",
    "trade_edges",
    "answer_paths",
)
def path_verdicts(w):
    """Every order's path taken again: the cheapest of its shortest routes of at most two hops."""
    w = w.settled()
    return verdicts.path_verdicts(w.answer_paths(), w.trade_edges(), most_hops=2).withColumn("cost", F.round("cost", 6))


@query(
    f""", ids AS (SELECT 'r:' || r_regionkey AS id FROM region UNION ALL SELECT id FROM f_islands UNION ALL SELECT id FROM f_assets UNION ALL SELECT id FROM f_sources
              UNION ALL SELECT id FROM f_passages UNION ALL SELECT id FROM f_entities),
       refs AS (SELECT 'island_parent' AS i, id, parent_id AS r FROM f_islands UNION ALL SELECT 'asset_parent', id, parent_id FROM f_assets UNION ALL SELECT 'asset_source', id, source_id FROM f_assets
              UNION ALL SELECT 'passage_parent', id, parent_id FROM f_passages UNION ALL SELECT 'passage_source', id, source_id FROM f_passages UNION ALL SELECT 'edge_ends', id, unnest([from_id, to_id]) FROM f_edges
              UNION ALL SELECT 'staged_nodes', id, unnest(node_ids) FROM f_staged),
       cut AS MATERIALIZED (SELECT p.*, char_start >= 0 AND char_end <= length(s.text) AND char_end > char_start AS inside, substr(s.text, char_start + 1, char_end - char_start) AS span
              FROM f_passages p JOIN f_sources s ON s.id = p.source_id),
       dims AS (SELECT * FROM (VALUES ('supplies', 'factual', 'supplied_by'), ('_follows', 'structural', '_precedes')) t(family, ds, di)),
       e AS MATERIALIZED (SELECT * FROM f_edges JOIN dims USING (family)),
       said AS (SELECT id, text || chr(10) || CASE WHEN inside THEN span ELSE '' END AS said FROM cut),
       claim AS (SELECT e.id, a.label AS a, b.label AS b, evidence FROM e JOIN f_entities a ON a.id = from_id JOIN f_entities b ON b.id = to_id WHERE NOT quarantined AND sigma <> 'structural'),
       bad AS (SELECT DISTINCT i, id FROM refs WHERE r NOT IN (SELECT id FROM ids)
         UNION ALL SELECT 'staged_edges', id FROM (SELECT id, unnest(edge_ids) AS r FROM f_staged) WHERE r NOT IN (SELECT id FROM f_edges)
         UNION ALL SELECT 'source_segment_zero', id FROM f_sources WHERE seq <> 0 OR kind <> 'verbatim'
         UNION ALL SELECT 'source_hash', id FROM f_sources WHERE content_hash <> 'sha256:' || sha256(text)[:32]
         UNION ALL SELECT 'passage_span', id FROM cut WHERE NOT inside
         UNION ALL SELECT 'passage_hash', id FROM cut WHERE inside AND content_hash <> 'sha256:' || sha256(span)[:32]
         UNION ALL SELECT 'verbatim_text', id FROM cut WHERE inside AND resolution = 'verbatim' AND text <> span
         UNION ALL SELECT 'resolved_text', id FROM cut WHERE inside AND resolution <> 'verbatim' AND text = span
         UNION ALL SELECT 'bridge_flag', id FROM f_entities WHERE is_bridge <> (islands > 1)
         UNION ALL SELECT 'entity_mentioned', id FROM f_entities WHERE id NOT IN (SELECT id FROM f_mentions)
         UNION ALL SELECT 'edge_sigma', id FROM e WHERE sigma <> ds UNION ALL SELECT 'edge_inverse', id FROM e WHERE inverse_family <> di
         UNION ALL SELECT 'structural_admitted', id FROM e WHERE sigma = 'structural' AND quarantined
         UNION ALL SELECT 'quarantine_named', id FROM e WHERE quarantined AND reason IS NULL
         UNION ALL SELECT 'admitted_without_reason', id FROM e WHERE NOT quarantined AND reason IS NOT NULL
         UNION ALL SELECT 'reason_known', id FROM e WHERE reason NOT IN ({", ".join(f"'{r}'" for r in QUARANTINE_REASONS)})
         UNION ALL SELECT 'edge_evidence', id FROM e WHERE len(evidence) = 0
         UNION ALL SELECT 'claim_in_evidence', c.id FROM claim c LEFT JOIN said s ON s.id = c.evidence[1] WHERE NOT coalesce(contains(said, a) AND contains(said, b), false)
         UNION ALL SELECT 'quarantine_rate', 'world' FROM (SELECT count(*) FILTER (quarantined) / count(*) FILTER (sigma <> 'structural') AS x FROM e) WHERE x NOT BETWEEN 0.02 AND 0.05
         UNION ALL SELECT 'staged_count', 'world' FROM (SELECT count(*) AS n FROM f_staged) WHERE n < 2)
       SELECT i AS invariant, count(id) AS violations, coalesce(array_to_string(list_sort(list(id) FILTER (id IS NOT NULL))[1:4], ','), '') AS examples
       FROM (SELECT unnest({validation.INVARIANTS!r}) AS i) LEFT JOIN bad USING (i) GROUP BY i""",
    "f_islands",
    "f_assets",
    "f_sources",
    "f_passages",
    "f_entities",
    "f_edges",
    "f_staged",
)
def validated_world(w):
    """Every invariant of a world with faults: how many rows break it, and the first of them."""
    return validation.validated(w.settled().faulty())


@query(
    """, lab AS (SELECT id, label FROM nodes),
       adm AS (SELECT * FROM edges WHERE NOT quarantined),
       lookup AS (SELECT 'q:lookup:' || e.id AS id, 'lookup' AS intent, 'Who ' || family || ' ' || b.label || '?' AS query, a.label AS gold, list_concat([from_id, to_id], evidence) AS nodes, [e.id] AS own,
              NULL::VARCHAR AS bridge_entity_id, [a.label || '|' || family || '|' || b.label] AS chain
            FROM (SELECT * FROM adm WHERE len(evidence) > 0 QUALIFY row_number() OVER (PARTITION BY family ORDER BY confidence DESC, id) <= 25) e JOIN lab a ON a.id = from_id JOIN lab b ON b.id = to_id),
       pairs AS (SELECT DISTINCT family, to_id, from_id FROM adm),
       busy AS (SELECT family, to_id FROM (SELECT family, to_id, count(*) AS n FROM pairs GROUP BY ALL HAVING n >= 2) QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, to_id) <= 25),
       pair AS (SELECT * FROM pairs SEMI JOIN busy USING (family, to_id) QUALIFY row_number() OVER (PARTITION BY family, to_id ORDER BY from_id) <= 2),
       used AS (SELECT family, to_id, min(from_id) AS a, max(from_id) AS b, list(id ORDER BY id) AS own, flatten(list(evidence ORDER BY id)) AS ev FROM adm SEMI JOIN pair USING (family, to_id, from_id) GROUP BY ALL),
       compare AS (SELECT 'q:compare:' || family || ':' || to_id, 'compare', 'Compare how ' || x.label || ' and ' || y.label || ' stand to ' || z.label || '.', x.label || ' and ' || y.label || ' both ' || family || ' ' || z.label,
              list_concat([a, b, to_id], ev), own, NULL, [x.label || '|' || family || '|' || z.label, y.label || '|' || family || '|' || z.label]
            FROM used JOIN lab x ON x.id = a JOIN lab y ON y.id = b JOIN lab z ON z.id = to_id),
       four AS (SELECT parent_id AS topic, id, "at", row_number() OVER w AS r, lag(id) OVER w AS before FROM assets WINDOW w AS (PARTITION BY parent_id ORDER BY "at", id) QUALIFY r <= 4),
       timeline AS (SELECT 'q:timeline:' || topic, 'timeline', 'Put the dated sessions on ' || label || ' in order and say what changed between them.', string_agg("at"[:10], ' -> ' ORDER BY r),
              list_concat([topic], list(four.id ORDER BY r)), list('sf:' || four.id ORDER BY r) FILTER (r > 1), NULL, list(four.id || '|_session_follows|' || before ORDER BY r) FILTER (r > 1)
            FROM four JOIN lab ON lab.id = topic GROUP BY topic, label HAVING count(*) >= 3),
       ment AS (SELECT part AS id, id AS passage_id, parent_id AS asset_id, seq FROM passages UNION ALL SELECT supplier, id, parent_id, seq FROM passages),
       places AS (SELECT DISTINCT m.id, a.parent_id AS topic FROM ment m JOIN assets a ON a.id = asset_id),
       cent AS (SELECT id, count(*) AS c FROM (SELECT unnest([from_id, to_id]) AS id FROM adm) GROUP BY id),
       top AS (SELECT topic, p.id FROM places p JOIN cent USING (id) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY c DESC, p.id) = 1),
       said AS (SELECT id, list(passage_id ORDER BY r) AS said FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY asset_id, seq, passage_id) AS r FROM ment SEMI JOIN top USING (id) QUALIFY r <= 6) GROUP BY id),
       own AS (SELECT id, list(e ORDER BY e) AS own FROM (SELECT e, id FROM (SELECT id AS e, unnest([from_id, to_id]) AS id FROM adm) SEMI JOIN top USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY e) <= 8) GROUP BY id),
       sums AS (SELECT 'q:summarize:' || topic, 'summarize', 'Summarise what the ' || p.label || ' record establishes about ' || l.label || '.', l.label, list_concat([topic, top.id], coalesce(said, [])), coalesce(own, []),
              CASE WHEN (SELECT count(*) FROM places q WHERE q.id = top.id) > 1 THEN top.id END, []
            FROM top JOIN lab l ON l.id = top.id JOIN lab p ON p.id = topic LEFT JOIN said ON said.id = top.id LEFT JOIN own ON own.id = top.id)
       SELECT id, intent, query, gold, array_to_string(nodes, ',') AS gold_node_ids, array_to_string(own, ',') AS gold_edge_ids, bridge_entity_id, array_to_string(chain, ';') AS chain
       FROM (FROM lookup UNION ALL FROM compare UNION ALL FROM timeline UNION ALL FROM sums)""",
    "edges",
    "assets",
    "nodes",
    "passages",
)
def mined_questions(w):
    """Lookup, compare, timeline and summarize questions of the whole graph; degree stands for centrality."""
    w = w.settled()
    edges, labels = w.edges(), w.nodes().select("id", "label")
    p = w.passages()
    mentions = p.select(F.explode(F.array("part", "supplier")).alias("id"), F.col("id").alias("passage_id"), F.col("parent_id").alias("asset_id"), "seq")
    homes = w.assets().select(F.col("id").alias("asset_id"), F.col("parent_id").alias("topic"))
    places = p.select("part", "supplier", F.col("parent_id").alias("asset_id")).join(homes, "asset_id").select(F.explode(F.array("part", "supplier")).alias("id"), "topic")
    central = edges.where("NOT quarantined").select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("centrality"))
    found = mining.mined(
        mining.lookups(edges, labels),
        mining.comparisons(edges, labels),
        mining.timelines(w.assets().withColumnRenamed("parent_id", "topic"), labels),
        mining.summaries(labels.join(central, "id"), places, mentions, edges, labels),
    )
    flat = [F.array_join(c, ";" if c == "chain" else ",").alias(c) if c in ("gold_node_ids", "gold_edge_ids", "chain") else F.col(c) for c in mining.COLUMNS]
    return found.select(*flat)


@query(
    """, own AS (SELECT n.*, coalesce(n.community, p.community, g.community) AS c, p.id AS up FROM layout_nodes n LEFT JOIN layout_nodes p ON p.id = n.parent_id LEFT JOIN layout_nodes g ON g.id = p.parent_id)
       SELECT row_number() OVER (ORDER BY o.id) - 1 AS index, o.id, kind, least(centrality, 1.0) AS centrality, c AS community,
              CASE WHEN c IS NOT NULL THEN (dense_rank() OVER (ORDER BY c NULLS LAST)) - 1 END AS community_index, up AS parent_id, coalesce(k.n, 0) AS children, k.n IS NULL AS free
       FROM own o LEFT JOIN (SELECT parent_id AS id, count(*) AS n FROM layout_nodes GROUP BY 1) k ON k.id = o.id""",
    "layout_nodes",
)
def topology_nodes(w):
    """All nodes with their index, and the community of the island that holds them."""
    return topology.topology_nodes(w.layout_nodes())


def _links(w):
    w = w.settled()
    return topology.topology_links(w.layout_nodes(), w.edges(), *w.layout_links())


@query("SELECT link, a, b, round(weight, 6) AS weight FROM layout_links", "layout_links")
def topology_links(w):
    """All links of a layout: edges, containment, reading order, mentions and attachments."""
    return _links(w).withColumn("weight", F.round("weight", 6))


@query(
    """, h AS (SELECT sha256(concat_ws('|', link, a, b, round(weight * 1000000)::BIGINT)) AS h FROM layout_links),
       w AS (SELECT count(*) AS n, sum(('0x' || h[1:16])::UBIGINT::HUGEINT) AS a, sum(('0x' || h[17:32])::UBIGINT::HUGEINT) AS b, sum(('0x' || h[33:48])::UBIGINT::HUGEINT) AS c, sum(('0x' || h[49:64])::UBIGINT::HUGEINT) AS d FROM h)
       SELECT sha256(concat_ws(',', n, a, b, c, d))[1:16] AS bake_id FROM w""",
    "layout_links",
)
def topology_hash(w):
    """A hash of all links, whatever their order."""
    return layout.content_hash(_links(w).select(F.concat_ws("|", "link", "a", "b", F.round(F.col("weight") * 1000000).cast("long").cast("string")).alias("line")))


@query(
    """, near AS MATERIALIZED (SELECT a AS id, b AS other, weight FROM layout_links UNION ALL SELECT b, a, weight FROM layout_links),
       v0 AS MATERIALIZED (SELECT id, centrality AS x, (kind = 'entity')::INT::DOUBLE AS y FROM layout_nodes),
       v1 AS MATERIALIZED (SELECT v.id, coalesce(v.x * (1 - 0.45) + m.x * 0.45, v.x) AS x, coalesce(v.y * (1 - 0.45) + m.y * 0.45, v.y) AS y FROM v0 v LEFT JOIN
            (SELECT n.id, sum(weight * x) / sum(weight) AS x, sum(weight * y) / sum(weight) AS y FROM near n JOIN v0 ON v0.id = other GROUP BY n.id) m ON m.id = v.id),
       v2 AS (SELECT v.id, coalesce(v.x * (1 - 0.45) + m.x * 0.45, v.x) AS x, coalesce(v.y * (1 - 0.45) + m.y * 0.45, v.y) AS y FROM v1 v LEFT JOIN
            (SELECT n.id, sum(weight * x) / sum(weight) AS x, sum(weight * y) / sum(weight) AS y FROM near n JOIN v1 ON v1.id = other GROUP BY n.id) m ON m.id = v.id)
       SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM v2""",
    "layout_nodes",
    "layout_links",
)
def topology_diffused(w):
    """Two features of all nodes after two rounds of diffusion over all links."""
    w = w.settled()
    links = _links(w).select(F.lit("").alias("id"), F.col("a").alias("from_id"), F.col("b").alias("to_id"), "weight")
    features = w.layout_nodes().select("id", F.array("centrality", (F.col("kind") == "entity").cast("double")).alias("v"))
    return paths.diffused(features, links, rounds=2).select("id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


_UNIT = "p % 5 = 0 OR s % 10 = 0 OR k % 11 = 0"


def _imported(w):
    """(destination, the artifact of a unit, the destination after two imports of it)"""
    w = w.settled()
    store, unit = w.shelf("true"), w.shelf(_UNIT)["mentions"].select("passage_id")
    artifact, before = portable.exported(store, unit), w.destination()
    once = portable.import_artifact(before, artifact)
    return before, artifact, portable.import_artifact(once, artifact)


@query("SELECT * FROM landed_nodes", "landed_nodes")
def imported_nodes(w):
    """The nodes of a store that has imported a unit of another twice."""
    return _imported(w)[2]["nodes"]


@query("SELECT * FROM landed_edges", "landed_edges")
def imported_edges(w):
    """The edges of that store."""
    return _imported(w)[2]["edges"]


@query(
    """, missing AS (SELECT t.* FROM told t WHERE unit AND id NOT IN (SELECT id FROM scopes))
       SELECT 'whole_nodes' AS measure, count(*) AS n FROM scopes WHERE scope = 'derived' UNION ALL SELECT 'stubs', count(*) FROM scopes WHERE scope <> 'derived'
       UNION ALL SELECT 'stubs_held_back', count(*) FROM scopes WHERE scope <> 'derived' AND id IN (SELECT id FROM dest_nodes WHERE category = 'own')
       UNION ALL SELECT 'stubs_made', count(*) FROM landed_nodes WHERE id NOT IN (SELECT id FROM dest_nodes UNION SELECT id FROM scopes)
       UNION ALL SELECT 'edges_added', count(*) FROM landed_edges WHERE (from_id, to_id) NOT IN (SELECT (supplier, part) FROM said WHERE dest)
       UNION ALL SELECT s || '_edges', count(from_id) FROM (SELECT unnest(['internal', 'boundary', 'shared']) AS s) LEFT JOIN sent_edges ON scope = s GROUP BY s
       UNION ALL SELECT 'dropped_entity_rows', count(*) FROM missing
       UNION ALL SELECT 'dropped_provenance_rows', count(*) FROM said WHERE unit AND (supplier, part) NOT IN (SELECT (from_id, to_id) FROM sent_edges)""",
    "landed_nodes",
)
def import_report(w):
    """What the import brought, held back, made up and dropped."""
    before, artifact, after = _imported(w)
    return portable.import_report(before, after, artifact)


@query(
    """, held AS (SELECT id, passage_id, unit FROM told WHERE dest UNION SELECT id, passage_id, unit FROM told WHERE unit AND id IN (SELECT id FROM scopes))
       SELECT id, CASE WHEN bool_and(unit) THEN 'derived' ELSE 'boundary' END AS scope FROM held GROUP BY id HAVING bool_or(unit)""",
    "scopes",
)
def reclosed_nodes(w):
    """The unit's closure computed anew where it was imported: what was shared may be derived there."""
    return portable.node_closure(_imported(w)[2]["mentions"], w.shelf(_UNIT)["mentions"].select("passage_id"))


@query(
    """, n AS (SELECT count(*) AS n FROM positions), r AS (SELECT *, row_number() OVER (ORDER BY community, id) - 1 AS i, count(*) OVER (PARTITION BY community) AS size FROM positions),
       d AS (SELECT r.*, min(i) OVER (PARTITION BY community) AS first, draw FROM r, range(4) t(draw)),
       h AS (SELECT *, ('0x' || md5('0#intra#' || id || '#' || draw)[1:8])::BIGINT AS a, ('0x' || md5('0#inter#' || id || '#' || draw)[1:8])::BIGINT AS b FROM d),
       p AS (SELECT 'intra' AS stratum, first + (i - first + 1 + a % greatest(size - 1, 1)) % size AS partner, x, y, size - 1 AS w FROM h WHERE size > 1 UNION ALL
             SELECT 'inter', (first + size + b % (n - size)) % n, x, y, n - size FROM h, n WHERE size < n)
       SELECT stratum, count(*) AS pairs, round(sum(sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2) * w) / sum(w), 6) AS distance FROM p JOIN r ON r.i = partner GROUP BY stratum""",
    "positions",
)
def community_separation(w):
    """The mean distance within and across communities, from four draws of each node."""
    return layout.separation(w.positions())


@query(
    """, c AS (SELECT c_custkey::VARCHAR AS point, (c_custkey * 17 % 1000 + 0.25)::DOUBLE AS px, (c_custkey * 29 % 1000 + 0.5)::DOUBLE AS py FROM customer)
       SELECT point, arg_min(id, (r, (x - px) ** 2 + (y - py) ** 2, id)) AS id FROM c JOIN positions ON (x - px) ** 2 + (y - py) ** 2 <= (r + 0.5) ** 2 GROUP BY point""",
    "positions",
)
def picks(w):
    """What is picked at a place for each customer, in one join."""
    points = w.table("customer").select(F.col("c_custkey").cast("string").alias("point"), F.expr("CAST(c_custkey * 17 % 1000 + 0.25 AS DOUBLE)").alias("px"), F.expr("CAST(c_custkey * 29 % 1000 + 0.5 AS DOUBLE)").alias("py"))
    return layout.picked_many(w.positions(), points, base=1.0, slop=0.5)


#: ASCII white space and its opposite; what documents must not hold to be compared in SQL.
_GAP, _INK = r"[\t\n\v\f\r ]", r"[^\t\n\v\f\r ]"
_ODD = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}#]"
_FIGURE = f"{_INK}*[0-9]{_INK}*"


@query(
    f"""t AS (SELECT doc_id AS id, text, regexp_replace(text, '{_FIGURE}', '#', 'g') AS masked FROM documents WHERE NOT regexp_matches(text, '{_ODD}')),
        n AS (SELECT *, regexp_extract_all(text, '{_INK}+') AS words, len(regexp_extract_all(text, '{_INK}+')) + len(regexp_extract_all(text, '{_GAP}+')) AS size FROM t),
        c AS (SELECT *, len(list_filter(words, lambda x: regexp_matches(x, '[0-9]'))) AS hit FROM n)
        SELECT id, CASE WHEN size <= 1200 THEN array_to_string(regexp_extract_all(text, '{_FIGURE}({_GAP}+{_FIGURE})*'), '|') END AS removed,
               CASE WHEN size <= 1200 THEN array_to_string(regexp_extract_all(masked, '#({_GAP}+#)*'), '|') END AS added,
               CASE WHEN size > 1200 THEN NULL WHEN len(words) = 0 THEN 0 ELSE round(hit / len(words), 6) END AS share FROM c"""
)
def masked_diffs(w):
    """Whole documents against themselves with every word of a digit masked: what changed, and how much.

    Documents that hold the mask, or white space beyond ASCII, have no such plain answer.
    """
    java = _FIGURE.replace(r"\v", r"\x0B")
    pairs = w.table("documents").where(~F.col("text").rlike(_ODD)).select(F.col("doc_id").alias("id"), F.col("text").alias("before"), F.regexp_replace("text", java, "#").alias("after"))
    found = diffs.word_diffs(pairs)
    phrases = lambda op: F.array_join(diffs.changed_phrases(op), "|")
    return found.select("id", phrases("del").alias("removed"), phrases("ins").alias("added"), F.round("share", 6).alias("share"))


@query(
    """, l AS (SELECT id, label, false AS alias FROM nodes UNION ALL SELECT 'p:' || p_partkey, p_brand, true FROM part),
       a AS (SELECT *, lower(label) AS h FROM l),
       s AS (SELECT *, unnest(list_filter(range(len(h)), lambda i: h[i + 1] = 'r')) AS p0 FROM a),
       b AS (SELECT *, CASE WHEN h[p0 + 2] = 'w' THEN p0 + 1 ELSE list_filter(range(p0 + 2, len(h)), lambda i: h[i + 1] = 'w' AND contains(' -_.:/', h[i]))[1] END AS p1 FROM s),
       c AS (SELECT *, CASE WHEN h[p1 + 2] = 'i' THEN p1 + 1 ELSE list_filter(range(p1 + 2, len(h)), lambda i: h[i + 1] = 'i' AND contains(' -_.:/', h[i]))[1] END AS p2 FROM b WHERE p1 IS NOT NULL),
       m AS (SELECT *, CASE WHEN p0 = 0 THEN 12 WHEN contains(' -_.:/', h[p0]) THEN 8 ELSE 0 END - 2 * p0 + CASE WHEN p1 = p0 + 1 THEN 6 ELSE 8 - (p1 - p0 - 1) END
                 + CASE WHEN p2 = p1 + 1 THEN 6 ELSE 8 - (p2 - p1 - 1) END - len(h) * 0.05::DOUBLE - CASE WHEN alias THEN 4 ELSE 0 END AS score FROM c WHERE p2 IS NOT NULL),
       o AS (SELECT *, list_transform(range(len(label)), lambda i: NOT alias AND (i = p0 OR i = p1 OR i = p2)) AS hits FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, alias, label, p0) = 1)
       SELECT id, label, round(score, 6) AS score, array_to_string(list_transform(range(len(label)), lambda i: CASE WHEN hits[i + 1] AND (i = 0 OR NOT hits[i]) THEN '[' ELSE '' END || label[i + 1]
              || CASE WHEN hits[i + 1] AND (i + 1 = len(label) OR NOT hits[i + 2]) THEN ']' ELSE '' END), '') AS marked FROM o""",
    "nodes",
)
def fuzzy_search(w):
    """All nodes, and the brands of parts as aliases, that match a few letters, with the letters marked."""
    labels = w.nodes().select("id", "label", F.lit(False).alias("alias")).unionByName(w.table("part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_brand").alias("label"), F.lit(True).alias("alias")))
    found = search.fuzzy("rw i", labels)
    marked = F.array_join(F.transform("runs", lambda r: F.when(r["hit"], F.concat(F.lit("["), r["text"], F.lit("]"))).otherwise(r["text"])), "")
    return found.select("id", "label", F.round("score", 6).alias("score"), marked.alias("marked"))


@query(
    """, own AS (SELECT n.kind, coalesce(n.community, p.community, g.community) AS c FROM layout_nodes n LEFT JOIN layout_nodes p ON p.id = n.parent_id LEFT JOIN layout_nodes g ON g.id = p.parent_id),
       e AS (SELECT f.*, coalesce(a.island <> b.island, false) AS strait FROM f_edges f LEFT JOIN region_of a ON a.id = from_id LEFT JOIN region_of b ON b.id = to_id),
       t AS (SELECT count(*) AS n, count(*) FILTER (sigma <> 'structural') AS m, count(*) FILTER (quarantined) AS q, count(*) FILTER (strait) AS s, count(DISTINCT family) AS f FROM e),
       p AS (SELECT count(*) AS n, count(*) FILTER (resolution <> 'verbatim') AS r, sum(greatest(1, floor(length(text) / 4.0 + 0.5))) AS k FROM f_passages),
       b AS (SELECT count(*) AS n, count(*) FILTER (is_bridge) AS b FROM f_entities)
       SELECT measure, key, round(value::DOUBLE, 6) AS value FROM (
         SELECT 'nodes_by_kind' AS measure, kind AS key, count(*)::DOUBLE AS value FROM own GROUP BY kind UNION ALL SELECT 'nodes_total', NULL, count(*) FROM own UNION ALL SELECT 'communities', NULL, count(DISTINCT c) FROM own
         UNION ALL SELECT 'edges_by_sigma', sigma, count(*) FROM e GROUP BY sigma UNION ALL SELECT 'quarantine_by_reason', coalesce(reason, 'unspecified'), count(*) FROM e WHERE quarantined GROUP BY 2
         UNION ALL SELECT 'edges_total', NULL, n FROM t UNION ALL SELECT 'edges_semantic', NULL, m FROM t UNION ALL SELECT 'edges_structural', NULL, n - m FROM t UNION ALL SELECT 'quarantined', NULL, q FROM t
         UNION ALL SELECT 'quarantine_rate', NULL, q / m FROM t UNION ALL SELECT 'strait_edges', NULL, s FROM t UNION ALL SELECT 'distinct_families_used', NULL, f FROM t
         UNION ALL SELECT 'bridge_entities', NULL, b FROM b UNION ALL SELECT 'bridge_entity_rate', NULL, b / n FROM b UNION ALL SELECT 'resolved_passages', NULL, r FROM p UNION ALL SELECT 'resolution_rate', NULL, r / n FROM p
         UNION ALL SELECT 'tokens_total', NULL, k FROM p UNION ALL SELECT 'source_characters', NULL, sum(length(text)) FROM f_sources)""",
    "layout_nodes",
    "f_edges",
    "f_passages",
    "f_entities",
    "f_sources",
    "region_of",
)
def world_stats(w):
    """All measures of the world with faults, and its nodes by kind and community."""
    t = w.settled().faulty()
    nodes = topology.inherited(w.layout_nodes()).select("kind", "community")
    edges = graph.crossing(t["edges"], w.region_of())
    passages = t["passages"].select("resolution", T.token_count(F.col("text")).alias("tokens"))
    found = graph.world_stats(nodes, edges, t["entities"], passages, t["sources"].select(F.length("text").alias("chars")))
    return found.select("measure", "key", F.round("value", 6).alias("value"))


@query(
    """SELECT 'c:' || c_custkey AS id, coalesce(max(o_orderkey % 10 / 10.0), 0)::DOUBLE AS centrality FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def source_centrality(w):
    """Customers as sources of their orders."""
    assets = w.table("orders").select(F.concat(F.lit("c:"), "o_custkey").alias("source_id"), F.expr("o_orderkey % 10 / 10D").alias("centrality"))
    return graph.source_centrality(w.table("customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id")), assets)


def _values(rows) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


@query(
    f""", dims AS (SELECT * FROM (VALUES {_values(vocabulary.family_rows())}) t(family, ds, inverse, label, truth_gated, self_inverse, place))
       SELECT coalesce(d.family, e.family) AS family, ds AS sigma, inverse, label, truth_gated, self_inverse, count(e.id) AS edges, count(e.id) FILTER (NOT quarantined) AS admitted,
              count(e.id) FILTER (e.sigma IS DISTINCT FROM ds) AS other_sigma
       FROM dims d FULL JOIN (SELECT id, family, sigma, quarantined FROM f_edges UNION ALL SELECT id, 'ships', sigma, quarantined FROM edges WHERE sigma = 'episodic') e ON e.family = d.family GROUP BY ALL""",
    "f_edges",
)
def family_usage(w):
    """The vocabulary with what edges use of it; some edges are of a family that it lacks."""
    edges = w.faulty()["edges"].select("family", "sigma", "quarantined")
    odd = w.edges().where("sigma = 'episodic'").select(F.lit("ships").alias("family"), "sigma", "quarantined")
    return graph.family_usage(edges.unionByName(odd), vocabulary.families(w.spark).drop("place"))


_RENDER = """RECURSIVE , q AS MATERIALIZED (SELECT l.parent_id AS question, CASE WHEN k % 13 = 0 THEN 'Why, though?' WHEN k % 17 = 0 THEN 'What did ' || c_name || ' buy?' ELSE 'Which supplier delivers the ' || p_name || '?' END AS text
         FROM line_texts l JOIN part ON part = 'p:' || p_partkey JOIN orders ON l.parent_id = 'o:' || o_orderkey JOIN customer ON c_custkey = o_custkey WHERE seq = 0),
       ed AS MATERIALIZED (SELECT e.id, from_id, to_id, sigma, quarantined, confidence, l.id AS passage FROM edges e JOIN line_texts l ON e.id = 'x:' || k || '-' || substr(part, 3) || '-' || substr(supplier, 3)),
       ok AS (SELECT * FROM ed WHERE NOT quarantined), inc AS MATERIALIZED (SELECT from_id AS id, to_id AS other, id AS edge_id, confidence, passage FROM ok UNION ALL SELECT to_id, from_id, id, confidence, passage FROM ok),
       deg AS (SELECT id, count(*) AS d FROM inc GROUP BY id),
       ent AS MATERIALIZED (SELECT n.id, label, round(coalesce(d, 0) / (SELECT max(d) FROM deg), 6) AS centrality FROM nodes n LEFT JOIN deg USING (id) WHERE kind = 'entity'),
       facts AS MATERIALIZED (SELECT id, centrality, count(*) AS mentions, count(DISTINCT parent_id) AS assets FROM ent JOIN (SELECT unnest([part, supplier]) AS id, parent_id FROM line_texts) USING (id) GROUP BY ALL),
       lab AS (SELECT label, max(centrality) AS centrality, arg_min(id, (-centrality, id)) AS id FROM ent GROUP BY label),
       lw AS (SELECT label, w, sum(length(w)) AS n FROM (SELECT label, unnest(string_split_regex(lower(label), '[^a-z0-9]+')) AS w FROM lab) WHERE length(w) > 2 GROUP BY ALL),
       qw AS (SELECT DISTINCT question, w FROM (SELECT question, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM q) WHERE length(w) > 2),
       focus AS MATERIALIZED (SELECT question, arg_min(lab.id, (-(n + centrality), lab.id)) AS id FROM (SELECT question, label, sum(n) AS n FROM qw JOIN lw USING (w) GROUP BY ALL) JOIN lab USING (label) GROUP BY question),
       hops AS MATERIALIZED (SELECT f.question, t.* FROM focus f JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, edge_id) AS place FROM inc QUALIFY place <= 3) t USING (id)),
       terms AS (SELECT question, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9åäöæøéèüß-]+'), lambda t: length(t) >= 3 AND NOT list_contains(STOP, t))) AS terms FROM q),
       sc AS (SELECT question, passage, place, least(greatest(0.5 * CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(v), t))) / len(terms) ELSE 0 END + 0.5 * confidence, 0), 1) AS score,
              greatest(1, floor(length(v) / 4.0 + 0.5))::BIGINT + 128 AS cost, 'src:' || k AS source_id, parent_id AS asset_id, seq % 5 <> 4 AS verbatim
            FROM (SELECT question, passage, min(h.place) AS place, arg_min(h.confidence, h.place) AS confidence FROM hops h GROUP BY question, passage) JOIN line_texts l ON l.id = passage JOIN terms USING (question)),
       cited AS MATERIALIZED (SELECT *, row_number() OVER w AS n, sum(cost) OVER w AS spent FROM sc WINDOW w AS (PARTITION BY question ORDER BY place, passage ROWS UNBOUNDED PRECEDING) QUALIFY n <= 5 AND spent <= 6000),
       spent AS MATERIALIZED (SELECT question, max(spent)::BIGINT AS spent, string_agg(passage, ',' ORDER BY n) AS cited FROM cited GROUP BY question),
       path AS (SELECT DISTINCT question, unnest([id, other]) AS id FROM hops),
       cand AS MATERIALIZED (SELECT question, id, on_path, mentions AS m, assets AS a, s.spent, row_number() OVER (PARTITION BY question ORDER BY on_path DESC, centrality DESC, id) AS place
            FROM (SELECT question, id, bool_or(p) AS on_path FROM (SELECT question, id, true AS p FROM path UNION ALL SELECT f.question, i.other, false FROM focus f JOIN inc i USING (id)) GROUP BY ALL) JOIN facts USING (id) JOIN spent s USING (question)),
       fold AS (SELECT question, 0::BIGINT AS place, ''::VARCHAR AS id, spent::BIGINT AS spent, 0 AS n, 0 AS lod, 0::BIGINT AS cost FROM spent UNION ALL
            SELECT question, place, id, CASE WHEN spent + c <= 6000 THEN spent + c ELSE spent END, n + (spent + c <= 6000)::INT, CASE WHEN spent + c > 6000 THEN 0 WHEN fl THEN 1 ELSE 2 END, CASE WHEN spent + c <= 6000 THEN c ELSE 0 END
            FROM (SELECT cand.question, cand.place, cand.id, fold.spent, fold.n, on_path OR fold.n < 4 AS fl, CASE WHEN on_path OR fold.n < 4 THEN 128 + 12 * m + 24 * a ELSE 30 + m + a END AS c FROM fold JOIN cand ON cand.question = fold.question AND cand.place = fold.place + 1)),
       adm AS MATERIALIZED (SELECT * FROM fold WHERE place > 0),
       st AS (SELECT question, count(*) FILTER (lod = 1) AS summaries, count(*) FILTER (lod = 2) AS pointers, count(*) FILTER (lod = 0) AS evicted, sum(cost) AS t FROM adm GROUP BY question),
       tok AS (SELECT a.id, a.parent_id AS island, sum(greatest(1, floor(length(v) / 4.0 + 0.5)))::BIGINT AS tokens FROM assets a JOIN line_texts l ON l.parent_id = a.id GROUP BY ALL),
       own AS (SELECT DISTINCT question, tok.* FROM cited JOIN tok ON tok.id = asset_id),
       wide AS (SELECT question, sum(t) AS b FROM (SELECT DISTINCT question, island FROM own) JOIN (SELECT island, sum(tokens) AS t FROM tok GROUP BY island) USING (island) GROUP BY question),
       cf AS (SELECT question, sum(tokens) AS a FROM own GROUP BY question),
       links AS (SELECT DISTINCT b.question, e.id, from_id, to_id, sigma, quarantined FROM adm b JOIN ed e ON e.to_id = b.id JOIN adm a ON a.question = b.question AND a.id = e.from_id WHERE a.lod > 0 AND b.lod > 0),
       in_ AS (SELECT question, id FROM path SEMI JOIN (SELECT question, id FROM adm WHERE lod > 0) USING (question, id)),
       way AS (SELECT question, from_id AS a, to_id AS b FROM links WHERE NOT quarantined UNION SELECT question, to_id, from_id FROM links WHERE NOT quarantined),
       r1 AS (SELECT question, id FROM in_ UNION SELECT question, b FROM in_ JOIN way USING (question) WHERE a = id), r2 AS (SELECT question, id FROM r1 UNION SELECT question, b FROM r1 JOIN way USING (question) WHERE a = id),
       sig AS (SELECT question, semantic, r / n AS topology, temporal, authorial FROM (SELECT question, count(*) AS n FROM adm WHERE lod > 0 GROUP BY 1) LEFT JOIN (SELECT question, count(*) AS r FROM r2 GROUP BY 1) USING (question)
            LEFT JOIN (SELECT question, avg((NOT quarantined)::INT) AS temporal FROM links WHERE sigma = 'temporal' GROUP BY 1) USING (question)
            FULL JOIN (SELECT question, avg(score) AS semantic, 0.5 * avg(verbatim::INT) + 0.5 * count(DISTINCT source_id) / count(*) AS authorial FROM cited GROUP BY 1) USING (question)),
       comp AS (SELECT question, round((coalesce(semantic * 0.4, 0) + coalesce(topology * 0.25, 0) + coalesce(temporal * 0.1, 0) + coalesce(authorial * 0.25, 0))
            / ((semantic IS NOT NULL)::INT * 0.4::DOUBLE + (topology IS NOT NULL)::INT * 0.25::DOUBLE + (temporal IS NOT NULL)::INT * 0.1::DOUBLE + (authorial IS NOT NULL)::INT * 0.25::DOUBLE), 2) AS composite FROM sig),
       fin AS (SELECT question, st.*EXCLUDE (question), spent.spent + t AS tokens, CASE WHEN coalesce(a, 0) < spent.spent + t THEN coalesce(b, 0) ELSE coalesce(a, 0) END AS cfa FROM st JOIN spent USING (question) LEFT JOIN cf USING (question) LEFT JOIN wide USING (question))
       SELECT q.question, f.id AS focus, CASE WHEN f.id IS NULL THEN 'QUERY_NO_MATCH' WHEN s.cited IS NULL THEN 'QUERY_NO_EVIDENCE' END AS error, s.cited, s.spent, summaries, pointers, evicted, tokens::BIGINT AS tokens, cfa::BIGINT AS counterfactual,
              CASE WHEN cfa > 0 THEN round(100.0::DOUBLE * (1 - tokens / cfa), 1) WHEN cfa = 0 THEN 0 END AS saved_pct, composite
       FROM q LEFT JOIN focus f USING (question) LEFT JOIN spent s USING (question) LEFT JOIN fin USING (question) LEFT JOIN comp USING (question)""".replace(
    "STOP", "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
)


@query(_RENDER, "line_texts", "edges", "nodes", "assets")
def answered_questions(w):
    """A question for each order, answered: what it names, what is cited and admitted under a budget, and how sure that is."""
    t = w.settled().rendering()
    assets = answering.asset_tokens(t["passages"], t["assets"])
    return answering.answered(w.asked(), t["entities"], t["edges"], t["passages"], t["facts"], assets, budget=6000, most=5, slots=4)


# -- stores and views ---------------------------------------------------------------------------


@query(
    """SELECT s.segment_id, CASE WHEN m THEN 'doc:new' ELSE s.source_id END AS source_id, count(DISTINCT o.source_id) + (m AND NOT bool_or(o.source_id = 'doc:new'))::INT AS owners
       FROM (SELECT *, seq = 1 AND substr(source_id, 5)::BIGINT % 7 = 0 AS m FROM segments) s JOIN ownership o USING (segment_id) GROUP BY s.segment_id, s.source_id, m""",
    "segments",
    "ownership",
)
def reowned_segments(w):
    """Primary owners and their number, once a new source has taken every seventh document's first line."""
    new = w.segments().where("seq = 1 AND CAST(substring(source_id, 5) AS LONG) % 7 = 0").withColumn("source_id", F.lit("doc:new"))
    segments, owners = P.upsert_segments(w.segments(), w.ownership(), new)
    n = owners.groupBy("segment_id").agg(F.countDistinct("source_id").alias("owners"))
    return segments.join(n, "segment_id").select("segment_id", "source_id", "owners")


@query("SELECT DISTINCT segment_id, source_id FROM ownership", "ownership")
def back_filled_owners(w):
    """Owners of all segments, once those of every fifth document are lost and filled in again."""
    fifth = F.expr("CAST(substring(source_id, 5) AS LONG) % 5 = 0")
    shared = w.ownership().join(w.segments().select("segment_id", "source_id"), ["segment_id", "source_id"], "left_anti")
    kept = w.segments().select("segment_id", "source_id").where(~fifth).unionByName(shared)
    return P.back_filled_ownership(w.segments(), kept).distinct()


@query("SELECT 'sources' AS measure, count(*) AS rows FROM sources UNION ALL SELECT 'segments', count(*) FROM segments UNION ALL SELECT 'citations', count(*) FROM citations", "sources", "segments", "citations")
def store_health(w):
    """How many rows the store's tables have."""
    return P.health({"sources": w.sources(), "segments": w.segments(), "citations": w.citations()})


@query("SELECT user_id, answer_id, answered_at FROM answers QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY answer_id DESC) = 1", "answers")
def latest_answers(w):
    """Each user's last answer by its id."""
    return P.latest(w.answers(), ["user_id"], "answer_id").select("user_id", "answer_id", "answered_at")


@query("SELECT sigma, count(*) AS edges, count(*) FILTER (quarantined) AS quarantined FROM edges WHERE 's:1' IN (from_id, to_id) GROUP BY sigma", "edges")
def sigma_mix(w):
    """The edges of one supplier by sigma."""
    return answers.sigma_mix(w.edges(), "s:1")


_SEEN = """seen AS (SELECT id, kind, id AS label, place AS degree, 2 AS depth FROM layout_nodes WHERE kind <> 'passage' UNION ALL SELECT id, kind, 'near ' || id, place, 1 FROM layout_nodes WHERE place % 3 = 0 AND kind = 'entity'
        UNION ALL SELECT id, kind, 'here ' || id, place, 0 FROM layout_nodes WHERE place % 9 = 0 AND kind = 'entity')"""


@query(f", {_SEEN} SELECT id, kind, label, degree FROM seen QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth) = 1", "layout_nodes")
def search_index(w):
    """Nodes of three views, each from the view that is nearest."""
    n = w.layout_nodes()
    entity = n.where("kind = 'entity'")
    view = lambda t, label, depth: t.select("id", "kind", F.concat(F.lit(label), "id").alias("label"), F.col("place").alias("degree"), F.lit(depth).alias("depth"))
    views = view(n.where("kind <> 'passage'"), "", 2).unionByName(view(entity.where("place % 3 = 0"), "near ", 1)).unionByName(view(entity.where("place % 9 = 0"), "here ", 0))
    return answers.search_index(views).select("id", "kind", "label", "degree")


@query(
    """, own AS (SELECT DISTINCT unnest([from_id, to_id]) AS id, id AS e FROM edges WHERE asset_id = 'o:7'), step AS (SELECT id, count(*) AS step FROM own GROUP BY id)
       SELECT id FROM layout_nodes LEFT JOIN step USING (id) ORDER BY step NULLS LAST, centrality DESC, id LIMIT 200""",
    "edges",
    "layout_nodes",
)
def outline(w):
    """The nodes of one order's answer, then the most central ones."""
    path = w.edges().where("asset_id = 'o:7'").select(F.explode(F.array("from_id", "to_id")).alias("id"), F.col("id").alias("e")).distinct().groupBy("id").agg(F.count("*").alias("step"))
    return answers.outline(w.layout_nodes(), path).select("id")


@query(
    """SELECT id, greatest(0, CASE WHEN kind IN ('continent', 'island') THEN 0 WHEN kind IN ('asset', 'entity') THEN 1 ELSE 2 END - (centrality >= 0.8 OR place % 50 = 1)::INT)::INT AS lod,
              round(CASE kind WHEN 'continent' THEN 0.06 WHEN 'island' THEN 0.03 WHEN 'asset' THEN 0.008 ELSE 0.003 END::DOUBLE * 1000 * (1 + least(sqrt(place) / 10, 1.0)), 6) AS r FROM layout_nodes""",
    "layout_nodes",
)
def discs(w):
    """The level of detail and the radius of all nodes; every fiftieth counts as a bridge."""
    rows = layout.radii(w.layout_nodes().withColumn("content", F.col("place")))
    return rows.select("id", layout.lod_hint(F.col("kind"), F.col("centrality"), F.expr("place % 50 = 1")).alias("lod"), F.round("r", 6).alias("r"))


@query(
    """, near1 AS (SELECT 's:1' AS id UNION SELECT to_id FROM edges WHERE from_id = 's:1' AND NOT quarantined), near AS (FROM near1 UNION SELECT from_id FROM edges WHERE NOT quarantined AND to_id IN (SELECT id FROM near1)),
       kept AS (SELECT id FROM layout_nodes SEMI JOIN near USING (id) ORDER BY centrality DESC, id LIMIT 400)
       SELECT id, weight FROM edges WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept) ORDER BY weight DESC, id LIMIT 40""",
    "edges",
    "layout_nodes",
)
def neighborhood_edges(w):
    """The heaviest edges among the most central nodes within two hops of one supplier."""
    seed = w.spark.createDataFrame([("s:1",)], "id string")
    return paths.neighborhood(w.layout_nodes(), w.edges(), seed, 2, 400, 40)[1].select("id", "weight")


def _lod_view(w):
    k = "CAST(substring(id, 3) AS LONG)"
    view = w.nodes().select("id", "kind", F.expr(f"CASE WHEN {k} % 4 = 3 THEN NULL ELSE element_at(array('lod-0', 'lod-1', 'ghost'), CAST({k} % 4 AS INT) + 1) END").alias("hint"))
    return view, lambda t, where: t.where(where.format(k=k))


@query(
    """, n AS (SELECT id, kind, substr(id, 3)::BIGINT AS k, CASE substr(id, 3)::BIGINT % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END AS h FROM nodes)
       SELECT id, ['lod-0', 'lod-1', 'lod-2', 'ghost', 'latent'][CASE WHEN kind = 'entity' AND k % 101 = 5 THEN 0 WHEN kind = 'asset' THEN least(h, 2) ELSE h END + 1] AS lod FROM n""",
    "nodes",
)
def lod_at_rest(w):
    """Levels of all nodes without a receipt: hints, labels for the rung in view, and some selected."""
    view, some = _lod_view(w)
    return answers.derived_lod(view, "asset", some(view, "kind = 'entity' AND {k} % 101 = 5").select("id"))


@query(
    """, n AS (SELECT id, kind, substr(id, 3)::BIGINT AS k FROM nodes UNION ALL SELECT id, 'passage', substr(parent_id, 3)::BIGINT FROM passages WHERE substr(parent_id, 3)::BIGINT % 19 = 0),
       r AS (SELECT *, CASE WHEN kind = 'passage' THEN 0 WHEN k % 6 = 1 THEN CASE WHEN k % 5 = 0 THEN 2 ELSE k % 3 END WHEN k % 4 = 1 THEN CASE WHEN k % 3 < 2 THEN 3 ELSE 4 END ELSE 4 END AS told FROM n)
       SELECT id, ['lod-0', 'lod-1', 'lod-2', 'ghost', 'latent'][CASE WHEN kind = 'entity' AND k % 101 = 5 THEN 0 WHEN kind = 'entity' AND k % 7 = 2 THEN least(told, 1) ELSE told END + 1] AS lod FROM r""",
    "nodes",
    "passages",
)
def lod_of_receipt(w):
    """Levels of all nodes under a receipt that points, admits, cites and has a path, and of what is selected."""
    view, some = _lod_view(w)
    k = F.expr("CAST(substring(id, 3) AS LONG)")
    odd = F.expr("CASE WHEN CAST(substring(id, 3) AS LONG) % 5 = 0 THEN 'unknown' ELSE concat('lod-', CAST(substring(id, 3) AS LONG) % 3) END")
    trace = {
        "pointers": some(view, "{k} % 4 = 1").select("id", (k % 3).cast("int").alias("hop")),
        "admitted": some(view, "{k} % 6 = 1").select("id", odd.alias("lod")),
        "cited": w.passages().where("CAST(substring(parent_id, 3) AS LONG) % 19 = 0").select("id"),
        "path": some(view, "kind = 'entity' AND {k} % 7 = 2").select("id"),
    }
    return answers.derived_lod(view, "asset", some(view, "kind = 'entity' AND {k} % 101 = 5").select("id"), trace)


@query(
    """, c AS (SELECT parent_id AS trace_id, CASE WHEN k % 23 = 1 THEN 'same' ELSE id END AS id, CASE WHEN k % 29 = 2 THEN ' ' ELSE v END AS quote, CASE WHEN k % 31 = 3 THEN 'md5:x' ELSE 'sha256:x' END AS h, CASE WHEN k % 37 = 4 THEN 0 ELSE length(v) END AS tokens,
            CASE WHEN k % 41 = 5 THEN 1.5 ELSE seq / 10.0 END AS score FROM line_texts WHERE k % 43 <> 6 AND seq < 3),
       a AS (SELECT parent_id AS trace_id, CASE WHEN k % 47 = 7 THEN id ELSE part END AS id, CASE WHEN k % 53 = 8 THEN 1.5 ELSE 12 END AS tokens, CASE WHEN k % 59 = 9 THEN NULL ELSE 0.5 END AS score FROM line_texts),
       o AS (SELECT parent_id AS trace_id, CASE WHEN k % 61 = 10 THEN part ELSE supplier END AS id, CASE WHEN k % 67 = 11 THEN 0 ELSE 1 END AS hop FROM line_texts),
       i AS (SELECT trace_id, id, sum(c) AS c, sum(a) AS a, sum(o) AS o FROM (SELECT trace_id, id, 1 AS c, 0 AS a, 0 AS o FROM c UNION ALL SELECT trace_id, id, 0, 1, 0 FROM a UNION ALL SELECT trace_id, id, 0, 0, 1 FROM o) GROUP BY ALL),
       bad AS (SELECT trace_id, 'hash_prefix' AS problem FROM c WHERE h NOT LIKE 'sha256:%' UNION ALL SELECT trace_id, 'blank_quote' FROM c WHERE trim(quote) = '' UNION ALL SELECT trace_id, 'citation_cost' FROM c WHERE tokens < 1
            UNION ALL SELECT trace_id, 'score_range' FROM c WHERE score > 1 UNION ALL SELECT trace_id, 'score_range' FROM a WHERE score IS NULL UNION ALL SELECT trace_id, 'admission_cost' FROM a WHERE tokens <> floor(tokens)
            UNION ALL SELECT trace_id, 'pointer_hop' FROM o WHERE hop < 1 UNION ALL SELECT trace_id, 'cited_twice' FROM i WHERE c > 1 UNION ALL SELECT trace_id, 'admitted_twice' FROM i WHERE a + c > 1 AND a > 0
            UNION ALL SELECT trace_id, 'omitted_and_admitted' FROM i WHERE o > 0 AND a + c > 0 UNION ALL SELECT DISTINCT parent_id, 'no_citation' FROM line_texts WHERE parent_id NOT IN (SELECT trace_id FROM c))
       SELECT trace_id, problem, count(*) AS rows FROM bad GROUP BY ALL""",
    "line_texts",
)
def traces_checked(w):
    """A trace for each order, a few with a fault of each kind."""
    t = w.line_texts().withColumnRenamed("parent_id", "trace_id")
    either = lambda when, bad, good: F.expr(f"CASE WHEN {when} THEN {bad} ELSE {good} END")
    citations = t.where("k % 43 <> 6 AND seq < 3").select(
        "trace_id", either("k % 23 = 1", "'same'", "id").alias("passage_id"), either("k % 29 = 2", "' '", "v").alias("quote"), either("k % 31 = 3", "'md5:x'", "'sha256:x'").alias("content_hash"),
        either("k % 37 = 4", "0", "length(v)").alias("tokens"), either("k % 41 = 5", "1.5D", "seq / 10D").alias("score"),
    )
    admitted = t.select("trace_id", either("k % 47 = 7", "id", "part").alias("id"), either("k % 53 = 8", "1.5D", "12D").alias("tokens"), either("k % 59 = 9", "NULL", "0.5D").alias("score"))
    omitted = t.select("trace_id", either("k % 61 = 10", "part", "supplier").alias("id"), either("k % 67 = 11", "0", "1").alias("hop"))
    return render.traces_checked(t.select("trace_id").distinct(), citations, admitted, omitted)


@query(
    """, b AS (SELECT id, 2 * (0.6 * x + 0.8 * y) + 30 + CASE WHEN k % 10 = 0 THEN 5 ELSE 0 END AS x, -2 * (-0.8 * x + 0.6 * y) + 7 AS y, x AS u, y AS v, 0.25 + k % 4 / 4.0::DOUBLE AS w FROM (SELECT *, substr(id, 3)::BIGINT AS k FROM positions) WHERE k % 9 <> 0),
       m AS (SELECT sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * u) / sum(w) AS mu, sum(w * v) / sum(w) AS mv FROM b),
       c AS (SELECT sum(b.w * ((x - mx) ** 2 + (y - my) ** 2)) AS q, sum(b.w * ((u - mu) ** 2 + (v - mv) ** 2)) AS p, sum(b.w * (x - mx) * (u - mu)) AS xu, sum(b.w * (y - my) * (v - mv)) AS yv, sum(b.w * (x - mx) * (v - mv)) AS xv, sum(b.w * (y - my) * (u - mu)) AS yu FROM b, m),
       s AS (SELECT *, p - ((xu - yv) ** 2 + (xv + yu) ** 2) / q < 0.999 * (p - ((xu + yv) ** 2 + (xv - yu) ** 2) / q) AS mirror FROM c),
       f AS (SELECT mirror, atan2(xv - g * yu, xu + g * yv) AS rotation, sqrt((xu + g * yv) ** 2 + (xv - g * yu) ** 2) / q AS scale, g FROM (SELECT *, CASE WHEN mirror THEN -1 ELSE 1 END AS g FROM s)),
       t AS (SELECT f.*, mu - scale * (cos(rotation) * mx - sin(rotation) * g * my) AS tx, mv - scale * (sin(rotation) * mx + cos(rotation) * g * my) AS ty FROM f, m),
       d AS (SELECT avg(sqrt((scale * (cos(rotation) * x - sin(rotation) * g * y) + tx - u) ** 2 + (scale * (sin(rotation) * x + cos(rotation) * g * y) + ty - v) ** 2)) AS mean_drift FROM b, t)
       SELECT round(rotation, 6) AS rotation, round(scale, 6) AS scale, round(tx, 6) AS tx, round(ty, 6) AS ty, mirror, round(mean_drift, 6) AS mean_drift,
              round(mean_drift / (SELECT sqrt((max(x + r) - min(x - r)) ** 2 + (max(y + r) - min(y - r)) ** 2) FROM positions) * 100, 6) AS drift_pct FROM t, d""",
    "positions",
)
def alignment(w):
    """Turned, mirrored and scaled positions, some of them moved and some new, on the old ones."""
    k = F.expr("CAST(substring(id, 3) AS LONG)")
    old = w.positions()
    moved = old.select("id", (2 * (0.6 * F.col("x") + 0.8 * F.col("y")) + 30 + F.when(k % 10 == 0, 5).otherwise(0)).alias("x"), (-2 * (-0.8 * F.col("x") + 0.6 * F.col("y")) + 7).alias("y"))
    new = moved.select(F.when(k % 9 == 0, F.concat(F.lit("new:"), "id")).otherwise(F.col("id")).alias("id"), "x", "y")
    found = layout.alignment(old, new, old.select("id", (0.25 + k % 4 / 4.0).alias("w")))
    return found.select(*[F.col(c) if c == "mirror" else F.round(c, 6).alias(c) for c in found.columns])


@query(
    """SELECT doc_id, CASE WHEN d > 0 THEN text[:d - 1] || ((text[d]::INT + 1) % 10) || text[d + 1:] WHEN l > 0 THEN text[:l - 1] || CASE WHEN text[l] = lower(text[l]) THEN upper(text[l]) ELSE lower(text[l]) END || text[l + 1:] ELSE text || '.' END AS quote,
              h[:63] || lower(to_base(('0x' || h[64])::BIGINT + 1, 16))[-1:] AS signature
       FROM (SELECT *, length(regexp_extract(text, '^[^0-9]*')) + 1 AS d0, length(regexp_extract(text, '^[^A-Za-z]*')) + 1 AS l0, sha256(text) AS h, CASE WHEN regexp_matches(text, '[0-9]') THEN d0 ELSE 0 END AS d, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN l0 ELSE 0 END AS l FROM documents)"""
)
def tampered_quotes(w):
    """Whole documents with one character changed, and digests with their last digit changed."""
    return w.table("documents").select("doc_id", trust.tampered(F.col("text")).alias("quote"), trust.tampered_signature(F.sha2("text", 256)).alias("signature"))
