"""The queries of the provenance and graph operators, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import ORACLES, QUERIES, query
from .functions import text as T
from .operators import answers as A
from .operators import audit, closure, detection, erasure, graph, layout, paths, portable, render, trust
from .operators import provenance as P
from .plans.fixtures import World
from .sources.scratch import written

def explained(w: World) -> DataFrame:
    return P.explain_citations(w.citations(), w.segments(), w.sources(), w.overlay())


# -- provenance -------------------------------------------------------------------------------


@query("SELECT * FROM explained", "explained")
def citation_explain(w):
    """Every citation with its segment, source and overlay flag."""
    return explained(w)


@query(
    """SELECT a.answer_id, count(e.answer_id) AS citations, count(e.source_label) AS known,
         count(CASE WHEN e.source_label IS NOT NULL AND NOT (e.has_overlay AND e.seq > 0) THEN 1 END) AS verbatim,
         CASE WHEN count(e.source_label) = 0 THEN 'none' WHEN count(e.source_label) = count(e.answer_id) THEN 'full' ELSE 'partial' END AS coverage
       FROM answers a LEFT JOIN explained e ON e.answer_id = a.answer_id GROUP BY a.answer_id""",
    "explained",
    "answers",
)
def trace_coverage(w):
    return P.trace_coverage(w.answers(), explained(w))


@query(
    "SELECT coalesce(nullif(render_strategy, ''), 'unattributed') AS strategy, verdict, count(*) AS claims FROM claims JOIN answers USING (answer_id) GROUP BY ALL",
    "claims",
    "answers",
)
def claim_verdicts_by_strategy(w):
    return P.verdicts_by_strategy(w.claims(), w.answers())


@query(
    """SELECT c.answer_id, c.claim_index, verdict, string_agg(rank || '=' || segment_id, ';' ORDER BY rank) AS evidence
       FROM claims c JOIN evidence e USING (answer_id, claim_index) GROUP BY ALL""",
    "claims",
    "evidence",
)
def claims_with_evidence(w):
    rows = P.claims_with_evidence(w.claims(), w.evidence())
    return rows.select("answer_id", "claim_index", "verdict", F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["rank"].cast("string"), e["segment_id"])), ";").alias("evidence"))


@query(
    """SELECT a.segment_id AS anchor_id, b.segment_id, b.source_id, b.seq FROM segments a JOIN segments b ON a.source_id = b.source_id AND b.seq BETWEEN a.seq - 1 AND a.seq + 1
       WHERE a.segment_id LIKE '%:3'""",
    "segments",
)
def segment_window_k1(w):
    """Neighbours by reading order of the third segment of each source."""
    return P.segment_context(w.segments().where("segment_id LIKE '%:3'"), w.segments(), 1)


@query(
    """, hit AS (SELECT s.source_id, h.heading, s.segment_id, s.seq,
          CASE WHEN lower(text) LIKE '%**' || lower(heading) || '**%' THEN 1 WHEN lower(text) LIKE '%# ' || lower(heading) || '%' THEN 2 WHEN lower(text) LIKE '%' || lower(heading) || '%' THEN 3 END::INT AS pass
          FROM segments s, (SELECT unnest(['the', 'license']) AS heading) h WHERE seq > 0)
       SELECT * FROM hit WHERE pass IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, heading ORDER BY pass, seq DESC) = 1""",
    "segments",
)
def heading_lookup(w):
    """The segment that two headings name in each source."""
    headings = w.sources().select("source_id", F.explode(F.array(F.lit("the"), F.lit("license"))).alias("heading"))
    return P.heading_segment(headings, w.segments())


@query("SELECT o.source_id, s.segment_id, s.seq FROM ownership o JOIN segments s USING (segment_id)", "ownership")
def source_segments_owned(w):
    return P.owned_segments(w.ownership(), w.segments(), w.sources()).select("source_id", "segment_id", "seq")


@query(
    """SELECT source_id, CASE WHEN n THEN 'renamed' ELSE source_label END AS source_label, '2024-01-01T00:00:00+00:00' AS imported_at
       FROM (SELECT *, substr(source_id, 5)::BIGINT % 7 = 0 AS n FROM sources)
       UNION ALL SELECT 'doc:new', 'renamed', '2025-01-01T00:00:00+00:00'""",
    "sources",
)
def upsert_sources(w):
    """Sources after an upsert: new labels win, first import times stay."""
    old = w.sources().select("source_id", "source_label", "imported_at")
    some = old.where("CAST(substring(source_id, 5) AS LONG) % 7 = 0").select("source_id", F.lit("renamed").alias("source_label"), F.lit("2025-01-01T00:00:00+00:00").alias("imported_at"))
    more = w.spark.createDataFrame([("doc:new", "renamed", "2025-01-01T00:00:00+00:00")], "source_id string, source_label string, imported_at string")
    return P.merged(old, some.unionByName(more), ["source_id"], keep=("imported_at",))


def store(w: World) -> dict[str, DataFrame]:
    runs = w.claims().select("answer_id").distinct()
    mentions = w.sources().select("source_id", F.lit("c0").alias("cluster_id"))
    return {
        "sources": w.sources(),
        "source_segments": w.segments(),
        "segment_sources": w.ownership(),
        "source_resolution_overlay": w.overlay(),
        "source_mention_clusters": mentions,
        "answer_claims": w.claims(),
        "answer_claim_evidence": w.evidence(),
        "answer_verification_runs": runs,
        "answer_citations": w.citations(),
    }


_ERASED = """, owned AS (SELECT segment_id FROM ownership WHERE source_id = 'doc:10'),
    kept AS (SELECT DISTINCT segment_id FROM ownership JOIN owned USING (segment_id) WHERE source_id <> 'doc:10'),
    lost AS (SELECT DISTINCT segment_id FROM owned WHERE segment_id NOT IN (SELECT segment_id FROM kept)),
    hit AS (SELECT DISTINCT answer_id FROM evidence WHERE segment_id IN (SELECT segment_id FROM lost)) """


@query(
    _ERASED
    + """SELECT 'answer_citations' AS measure, count(*) AS removed FROM citations WHERE segment_id IN (SELECT segment_id FROM lost)
         UNION ALL SELECT 'answer_claim_evidence', count(*) FROM evidence WHERE answer_id IN (SELECT answer_id FROM hit)
         UNION ALL SELECT 'answer_claims', count(*) FROM claims WHERE answer_id IN (SELECT answer_id FROM hit)
         UNION ALL SELECT 'answer_verification_runs', count(DISTINCT answer_id) FROM claims WHERE answer_id IN (SELECT answer_id FROM hit)
         UNION ALL SELECT 'segment_sources', count(*) FROM ownership WHERE source_id = 'doc:10'
         UNION ALL SELECT 'source_mention_clusters', count(*) FROM sources WHERE source_id = 'doc:10'
         UNION ALL SELECT 'source_resolution_overlay', count(*) FROM overlay WHERE source_id = 'doc:10'
         UNION ALL SELECT 'source_segments', count(*) FROM lost
         UNION ALL SELECT 'sources', count(*) FROM sources WHERE source_id = 'doc:10'""",
    "ownership",
    "sources",
    "overlay",
    "citations",
    "claims",
    "evidence",
)
def erase_source_counts(w):
    """Rows that each table loses when a source is erased."""
    return erasure.erase_source(store(w), "doc:10")[1]


@query(
    _ERASED
    + """, home AS (SELECT segment_id, min(source_id) AS home FROM ownership WHERE source_id <> 'doc:10' GROUP BY 1)
       SELECT s.segment_id, CASE WHEN s.source_id = 'doc:10' AND home IS NOT NULL THEN home ELSE s.source_id END AS source_id
       FROM segments s LEFT JOIN home USING (segment_id) WHERE s.segment_id NOT IN (SELECT segment_id FROM lost)""",
    "ownership",
    "evidence",
)
def erase_source_survivors(w):
    """Segments and owners that are left after a source is erased."""
    return erasure.erase_source(store(w), "doc:10")[0]["source_segments"].select("segment_id", "source_id")


@query(
    """, owned AS (SELECT segment_id FROM ownership WHERE source_id = 'doc:3' AND segment_id IN ('seg:3:1', 'seg:3:2'))
       SELECT 'source_segments' AS measure, count(*) AS removed FROM owned UNION ALL SELECT 'segment_sources', count(*) FROM owned
       UNION ALL SELECT 'sources', 0 UNION ALL SELECT 'answer_citations', count(*) FROM citations WHERE segment_id IN (SELECT segment_id FROM owned)""",
    "ownership",
    "citations",
)
def erase_asset_counts(w):
    """Rows that go with two segments of a source which keeps others."""
    listed = w.spark.createDataFrame([("seg:3:1",), ("seg:3:2",), ("seg:9:1",)], "segment_id string")
    return erasure.erase_asset(store(w), "doc:3", listed)[1].where("measure IN ('source_segments', 'segment_sources', 'sources', 'answer_citations')")


# -- audit ------------------------------------------------------------------------------------


@query("SELECT answer_id, segment_id, cite_order FROM citations WHERE segment_id NOT IN (SELECT segment_id FROM segments)", "citations", "segments")
def audit_dangling(w):
    return audit.dangling_citations(w.citations(), w.segments()).select("answer_id", "segment_id", "cite_order")


_SPACE = "trim(regexp_replace({}, '[\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+', ' ', 'g'))"


@query(
    f"""SELECT answer_id, segment_id, cite_order, CASE WHEN contains(text, trim(evidence_snippet)) THEN 'verbatim'
          WHEN contains({_SPACE.format('text')}, {_SPACE.format('evidence_snippet')}) THEN 'normalised' ELSE 'absent' END AS match
        FROM citations JOIN segments USING (segment_id) WHERE trim(evidence_snippet) <> ''""",
    "citations",
    "segments",
)
def audit_snippets(w):
    return audit.snippet_matches(w.citations(), w.segments())


@query("SELECT segment_id, source_id FROM segments WHERE source_id NOT IN (SELECT source_id FROM sources WHERE substr(source_id, 5)::BIGINT % 9 <> 0)", "segments", "sources")
def audit_orphans(w):
    """Segments without a source, once every ninth source is gone."""
    return audit.orphan_segments(w.segments(), w.sources().where("CAST(substring(source_id, 5) AS LONG) % 9 <> 0")).select("segment_id", "source_id")


@query(
    """, p AS (SELECT segment_id AS passage_id, CASE WHEN seq % 8 = 5 THEN 'other' ELSE text END AS raw_text FROM segments WHERE seq % 10 <> 9 UNION ALL SELECT 'extra', '')
       SELECT count(*) FILTER (segment_id IS NOT NULL AND passage_id IS NOT NULL) AS shared,
         count(*) FILTER (segment_id IS NOT NULL AND passage_id IS NOT NULL AND coalesce(text, '') <> coalesce(raw_text, '')) AS mismatched,
         count(*) FILTER (passage_id IS NULL) AS only_segments, count(*) FILTER (segment_id IS NULL) AS only_passages
       FROM segments FULL JOIN p ON passage_id = segment_id""",
    "segments",
)
def audit_dual_write(w):
    """A copy with changed, missing and extra texts against the segments."""
    copy = w.segments().where("seq % 10 <> 9").select(F.col("segment_id").alias("passage_id"), F.expr("CASE WHEN seq % 8 = 5 THEN 'other' ELSE text END").alias("raw_text"))
    return audit.dual_write(w.segments(), copy.unionByName(w.spark.createDataFrame([("extra", "")], "passage_id string, raw_text string")))


@query("SELECT answer_id FROM answers WHERE answer_id NOT IN (SELECT answer_id FROM citations)", "answers", "citations")
def audit_zero_cite(w):
    return audit.uncited_answers(w.answers(), w.citations()).select("answer_id")


@query(
    """SELECT 'dangling' AS "check", count(*) AS found, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM citations WHERE segment_id NOT IN (SELECT segment_id FROM segments)
       UNION ALL SELECT 'orphans', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM segments WHERE source_id NOT IN (SELECT source_id FROM sources)
       UNION ALL SELECT 'uncited', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END FROM answers WHERE answer_id NOT IN (SELECT answer_id FROM citations)""",
    "citations",
    "segments",
    "sources",
    "answers",
)
def audit_report(w):
    return audit.report(
        {
            "dangling": (audit.dangling_citations(w.citations(), w.segments()), "FAIL"),
            "orphans": (audit.orphan_segments(w.segments(), w.sources()), "FAIL"),
            "uncited": (audit.uncited_answers(w.answers(), w.citations()), "WARN"),
        }
    )


def files(w: World) -> DataFrame:
    """Half of the documents as files, every tenth of them changed."""
    rows = w.table("documents").where("doc_id % 2 = 0")
    return rows.select(F.concat(F.lit("corpus/"), "doc_id").alias("path"), F.expr("CASE WHEN doc_id % 10 = 0 THEN concat(text, '!') ELSE text END").alias("text"))


_FILES = "files AS (SELECT 'corpus/' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0)"


@query(
    f""", {_FILES}, last AS (SELECT sha256(text) AS content_hash, max(path) AS path FROM files GROUP BY 1)
       SELECT source_id, path, CASE WHEN path IS NULL THEN 'UNANCHORED' ELSE 'EXACT' END AS anchor FROM sources LEFT JOIN last USING (content_hash)""",
    "sources",
)
def anchor_sources(w):
    return audit.anchored_sources(w.sources(), files(w))


@query(
    f""", {_FILES}, last AS (SELECT sha256(text) AS content_hash, max(path) AS path FROM files GROUP BY 1),
       asked AS (SELECT source_id, CASE seq % 5 WHEN 0 THEN '[Session date: 2024-01-01] ' || text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN text || ' ' || text
              WHEN 3 THEN text || ' This was never written by anyone here.' ELSE 'Nothing of this is in any file, not a single line.' END AS text FROM segments WHERE seq > 0),
       b AS (SELECT a.source_id, regexp_replace(a.text, '^\\[Session date: [^\\]]+\\]\\s*', '') AS body, f.text AS file, trim(regexp_replace(f.text, '\\s+', ' ', 'g')) AS flat
              FROM asked a JOIN sources r USING (source_id) JOIN last l USING (content_hash) JOIN files f USING (path)),
       u AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS near, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 20) AS units FROM b),
       c AS (SELECT *, len(list_filter(units, lambda x: contains(flat, x))) AS held FROM u)
       SELECT source_id, CASE WHEN contains(file, body) THEN 'WHOLE' WHEN contains(flat, near) THEN 'NORMALIZED' WHEN len(units) > 0 AND held = len(units) THEN 'UNITS' WHEN held > 0 THEN 'PARTIAL' ELSE 'ABSENT' END AS class,
              count(*) AS segments FROM c GROUP BY ALL""",
    "segments",
    "sources",
)
def segment_classes(w):
    """How the anchoring files hold lines: as they are, spaced out, twice over, with an addition, or not at all."""
    told = F.expr(
        """CASE seq % 5 WHEN 0 THEN concat('[Session date: 2024-01-01] ', text) WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN concat(text, ' ', text)
           WHEN 3 THEN concat(text, ' This was never written by anyone here.') ELSE 'Nothing of this is in any file, not a single line.' END"""
    )
    lines = w.segments().where("seq > 0").select("source_id", told.alias("text"))
    return audit.segment_classes(lines, audit.anchored_sources(w.sources(), files(w)), files(w))


# -- vocabulary closure -----------------------------------------------------------------------


@query("SELECT relation, count(*) AS freq, array_to_string(list_sort(list(DISTINCT register)), ',') AS registers FROM triples GROUP BY relation", "triples")
def relation_stats(w):
    return closure.relation_stats(w.triples()).withColumn("registers", F.array_join("registers", ","))


@query("SELECT * FROM nearest", "nearest")
def nearest_family(w):
    return closure.nearest_family(w.relations(), w.families())


@query(
    """SELECT register, count(*) AS relations, round(avg((best >= 0.19)::INT), 3) AS distinct_coverage, round(sum((best >= 0.19)::INT * freq)::DOUBLE / sum(freq), 3) AS edge_coverage
       FROM (SELECT DISTINCT register, relation FROM triples) JOIN nearest USING (relation) JOIN stats USING (relation) GROUP BY register""",
    "nearest",
    "stats",
)
def coverage_by_register(w):
    return closure.coverage_by_register(closure.nearest_family(w.relations(), w.families()), closure.relation_stats(w.triples()), 0.19)


@query(
    """SELECT count(*) AS relations, count(*) FILTER (best < 0.19) AS gaps, round(avg((best >= 0.19)::INT), 3) AS distinct_coverage,
         round(sum((best >= 0.19)::INT * freq)::DOUBLE / sum(freq), 3) AS edge_coverage FROM nearest JOIN stats USING (relation)""",
    "nearest",
    "stats",
)
def coverage_total(w):
    return closure.coverage_total(closure.nearest_family(w.relations(), w.families()), closure.relation_stats(w.triples()), 0.19)


@query("SELECT round(best, 3) AS threshold FROM (SELECT best, row_number() OVER (ORDER BY best) - 1 AS i, count(*) OVER () AS n FROM nearest) WHERE i = n // 20", "nearest")
def coverage_threshold(w):
    return closure.threshold(closure.nearest_family(w.relations(), w.families()).select(F.col("best").alias("cosine")))


@query(
    """RECURSIVE , g AS MATERIALIZED (SELECT relation, freq, v, row_number() OVER (ORDER BY freq DESC, relation) AS k FROM nearest JOIN stats USING (relation) JOIN relations USING (relation) WHERE best < 0.19),
       near AS MATERIALIZED (SELECT a.k AS i, list(b.k) AS js FROM g a JOIN g b ON a.k <= b.k AND (a.k = b.k OR list_inner_product(a.v, b.v) >= 0.25) GROUP BY a.k),
       led AS (SELECT i, js AS held FROM near WHERE i = 1 UNION ALL
            SELECT i, list_concat(held, js) FROM (SELECT held, list_filter(range(1, (SELECT count(*) + 1 FROM g)), lambda x: NOT list_contains(held, x))[1] AS nxt FROM led) JOIN near ON i = nxt),
       own AS (SELECT j, min(i) AS i FROM (SELECT led.i, unnest(js) AS j FROM led JOIN near USING (i)) GROUP BY j),
       r AS (SELECT l.relation AS leader, m.relation, m.freq, row_number() OVER (PARTITION BY l.relation ORDER BY m.freq DESC, m.relation) AS n FROM own JOIN g l ON l.k = own.i JOIN g m ON m.k = own.j)
       SELECT leader, count(*) AS size, sum(freq)::BIGINT AS freq, string_agg(relation, ',' ORDER BY n) FILTER (n <= 12) AS members FROM r GROUP BY leader HAVING count(*) >= 2""",
    "nearest",
    "stats",
)
def gap_clusters(w):
    """Clusters of relations that no family covers, by the first leader that is near enough."""
    near = closure.nearest_family(w.relations(), w.families()).where("best < 0.19")
    stats = closure.relation_stats(w.triples())
    gaps = near.join(stats, "relation").join(w.relations().select("relation", "v"), "relation")
    return closure.extension_candidates(closure.gap_clusters(gaps, 0.25), stats)


# -- graph ------------------------------------------------------------------------------------


def _rung(kind: str):
    @query(f"SELECT id, parent_id, label FROM nodes WHERE kind = '{kind}'", "nodes")
    def rung(w):
        return graph.rung_view(w.nodes(), kind).select("id", "parent_id", "label")

    QUERIES[f"rung_view_{kind}"], ORACLES[f"rung_view_{kind}"] = QUERIES.pop("rung"), ORACLES.pop("rung")


for _kind in ("continent", "island", "asset"):
    _rung(_kind)


def _corridor_sql(rung: str) -> str:
    return f"""SELECT least(a.{rung}, b.{rung}) AS region_a, greatest(a.{rung}, b.{rung}) AS region_b, count(*) AS edges,
         round(sum(weight * CASE WHEN quarantined THEN 0.35 ELSE 1 END), 6) AS weight,
         arg_min(sigma, (-c, sigma)) AS sigma
       FROM (SELECT e.*, a.{rung} AS ra, count(*) OVER (PARTITION BY least(a.{rung}, b.{rung}), greatest(a.{rung}, b.{rung}), sigma) AS c FROM edges e
             JOIN region_of a ON a.id = from_id JOIN region_of b ON b.id = to_id WHERE a.{rung} <> b.{rung}) e
       JOIN region_of a ON a.id = from_id JOIN region_of b ON b.id = to_id GROUP BY 1, 2"""


@query(_corridor_sql("island"), "edges", "region_of")
def corridors_island(w):
    return graph.corridors(w.edges(), w.region_of("island"))


@query(_corridor_sql("continent"), "edges", "region_of")
def corridors_continent(w):
    return graph.corridors(w.edges(), w.region_of("continent"))


@query(
    """, pair AS (SELECT e.id, weight, least(a.continent, b.continent) AS region_a, greatest(a.continent, b.continent) AS region_b FROM edges e
          JOIN region_of a ON a.id = from_id JOIN region_of b ON b.id = to_id WHERE a.continent <> b.continent)
       SELECT region_a, region_b, id, row_number() OVER (PARTITION BY region_a, region_b ORDER BY weight DESC, id)::INT AS rank FROM pair QUALIFY rank <= 2""",
    "edges",
    "region_of",
)
def corridor_exemplars(w):
    return graph.corridor_exemplars(w.edges(), w.region_of("continent")).select("region_a", "region_b", "id", "rank")


@query(
    "SELECT id, weight FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE parent_id IN ('n:1', 'n:2', 'n:3')) ORDER BY weight DESC, id LIMIT 512", "edges", "nodes"
)
def top_edges(w):
    """The heaviest edges among some islands' suppliers and all parts."""
    ids = w.nodes().where("parent_id IN ('n:1', 'n:2', 'n:3') OR id LIKE 'p:%'").select("id")
    return graph.top_edges(w.edges(), ids).select("id", "weight")


@query(
    """SELECT (SELECT count(*) FROM nodes WHERE kind = 'entity') AS node_count, count(*) AS edge_count, count(*) FILTER (NOT quarantined) AS edges_drawn FROM edges""", "edges", "nodes"
)
def edge_policy_stats(w):
    return graph.edge_stats(w.nodes().where("kind = 'entity'").select("id"), w.edges())


_EVENTS = "ev AS (SELECT \"at\", id, 'boundary' AS event FROM assets UNION ALL SELECT \"at\", id, family FROM edges WHERE sigma IN ('temporal', 'episodic') AND NOT quarantined)"


@query(f", {_EVENTS} SELECT * FROM ev WHERE \"at\" BETWEEN '1995-01-01' AND '1996-12-31' ORDER BY \"at\", id LIMIT 200", "assets", "edges")
def timeline_events(w):
    return graph.timeline(w.assets(), w.edges(), "1995-01-01", "1996-12-31")


@query(
    """, s AS (SELECT epoch(strptime("at", '%Y-%m-%dT%H:%M:%S')) AS t, epoch(strptime(min("at") OVER (), '%Y-%m-%dT%H:%M:%S')) AS a, epoch(strptime(max("at") OVER (), '%Y-%m-%dT%H:%M:%S')) AS b FROM assets),
       c AS (SELECT least(floor((t - a) / greatest(b - a, 1) * 72), 71)::INT AS bin, count(*) AS events FROM s GROUP BY 1)
       SELECT bin, events, round(events / max(events) OVER (), 6) AS height FROM c""",
    "assets",
)
def timeline_envelope(w):
    return graph.envelope(w.assets())


@query("SELECT min(\"at\") AS first, max(\"at\") AS last FROM (SELECT \"at\" FROM assets UNION ALL SELECT \"at\" FROM edges WHERE sigma IN ('temporal', 'episodic'))", "assets", "edges")
def corpus_span(w):
    both = w.assets().select("at").unionByName(w.edges().where("sigma IN ('temporal', 'episodic')").select("at"))
    return both.agg(F.min("at").alias("first"), F.max("at").alias("last"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (NOT quarantined) AS admitted, count(*) FILTER (quarantined) AS quarantined, count(*) FILTER (sigma = 'structural') AS exempt,
         count(*) FILTER (quarantined <> (reason IS NOT NULL)) AS inconsistent,
         count(*) FILTER (NOT quarantined AND NOT (sigma = 'structural' OR (confidence >= 0.55 AND len(evidence) > 0))) AS admitted_against_gate FROM edges""",
    "edges",
)
def integrity_report(w):
    return graph.integrity_report(w.edges())


@query(
    """SELECT reason, count(*) AS edges, array_to_string(list_sort(list(id))[1:4], ',') AS examples FROM edges WHERE quarantined GROUP BY reason""",
    "edges",
)
def integrity_by_reason(w):
    return graph.integrity_by_reason(w.edges())


@query(
    """, m AS (SELECT parent_id AS region, count(*) AS members, sum(price) AS m FROM assets GROUP BY 1),
       d AS (SELECT region, count(*) AS degree FROM (SELECT DISTINCT e.id, island AS region FROM edges e JOIN region_of r ON r.id IN (e.from_id, e.to_id)) GROUP BY 1)
       SELECT region, members, round(m / max(m) OVER (), 6) AS mass, coalesce(degree, 0) AS degree FROM m LEFT JOIN d USING (region)""",
    "assets",
    "edges",
    "region_of",
)
def region_rollup(w):
    children = w.assets().select(F.col("parent_id").alias("region"), F.col("price").alias("centrality"))
    return graph.region_rollup(children, w.edges(), w.region_of("island"))


@query("SELECT part AS id, count(DISTINCT a.parent_id) AS islands FROM passages p JOIN assets a ON a.id = p.parent_id GROUP BY 1 HAVING count(DISTINCT a.parent_id) > 1", "passages", "assets")
def bridge_entities(w):
    island = w.assets().select(F.col("id").alias("parent_id"), F.col("parent_id").alias("island"))
    return graph.bridges(w.passages().select(F.col("part").alias("id"), "parent_id").join(island, "parent_id").select("id", "island"))


@query(
    """, n AS (SELECT id, lead(id) OVER w AS a, lead(id, 2) OVER w AS b FROM passages WINDOW w AS (PARTITION BY parent_id ORDER BY seq, id))
       SELECT a AS from_id, id AS to_id, '_follows' AS family FROM n WHERE a IS NOT NULL UNION ALL SELECT id, a, '_precedes' FROM n WHERE a IS NOT NULL
       UNION ALL SELECT id, b, '_co_doc' FROM n WHERE b IS NOT NULL""",
    "passages",
)
def reading_fiber(w):
    return graph.reading_fiber(w.passages())


@query(
    """, n AS (SELECT id, lead(id) OVER (PARTITION BY parent_id ORDER BY "at", id) AS a FROM assets)
       SELECT a AS from_id, id AS to_id, '_session_follows' AS family FROM n WHERE a IS NOT NULL UNION ALL SELECT id, a, '_session_precedes' FROM n WHERE a IS NOT NULL""",
    "assets",
)
def session_fiber(w):
    return graph.session_fiber(w.assets().select("id", F.col("parent_id").alias("region"), "at"))


@query(
    """, f AS (SELECT parent_id, part AS id, min(seq) AS seq FROM passages GROUP BY ALL),
       j AS (SELECT a.parent_id, a.id AS from_id, a.seq, arg_min(b.id, (b.seq, b.id)) AS to_id FROM f a JOIN f b ON a.parent_id = b.parent_id AND b.seq > a.seq GROUP BY ALL)
       SELECT parent_id, from_id, to_id FROM j QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY seq, from_id) <= 3""",
    "passages",
)
def mentioned_before(w):
    return graph.mentioned_before(w.passages().select("parent_id", F.col("part").alias("id"), "seq"))


@query(
    """SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY id""",
    "edges",
)
def node_degrees(w):
    return graph.degrees(w.edges())


@query(
    """, near AS (SELECT from_id AS id, to_id AS other FROM edges WHERE NOT quarantined UNION SELECT to_id, from_id FROM edges WHERE NOT quarantined),
       one AS (SELECT DISTINCT other AS id FROM near WHERE id = 's:1'), two AS (SELECT DISTINCT other AS id FROM near WHERE id IN (SELECT id FROM one))
       SELECT id, min(hop)::INT AS hop FROM (SELECT 's:1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) GROUP BY id""",
    "edges",
)
def neighborhood_2hop(w):
    seeds = w.spark.createDataFrame([("s:1",)], "id string")
    return paths.hop_closure(written(w.edges(), "edges"), seeds, 2)


@query(
    """RECURSIVE , near AS (SELECT from_id AS id, to_id AS other, 1 - confidence AS c FROM edges WHERE NOT quarantined UNION ALL SELECT to_id, from_id, 1 - confidence FROM edges WHERE NOT quarantined),
       best AS (SELECT id, other, min(c) AS c FROM near GROUP BY ALL),
       walk AS (SELECT 's:1' AS id, 0 AS hop, 0.0::DOUBLE AS cost UNION ALL
                SELECT id, hop, min(cost) FROM (SELECT b.other AS id, w.hop + 1 AS hop, w.cost + b.c AS cost FROM walk w JOIN best b ON b.id = w.id WHERE w.hop < 8 AND w.id <> 's:2') GROUP BY ALL)
       SELECT hop::INT AS hops, round(min(cost), 6) AS cost FROM walk WHERE id = 's:2' AND hop = (SELECT min(hop) FROM walk WHERE id = 's:2') GROUP BY hop""",
    "edges",
)
def shortest_path(w):
    """Hops and cost of the path between two suppliers."""
    steps = paths.shortest_path(written(w.edges(), "edges"), "s:1", "s:2")
    rows = [(len(steps), round(steps[-1]["cost"], 6))] if steps else []
    return w.spark.createDataFrame(rows, "hops int, cost double")


@query()
def centrality(w):
    """Sixteen power iterations; held against a dense computation in the tests."""
    return paths.centrality(written(w.edges(), "edges")).select("id", F.round("centrality", 6).alias("centrality"))


@query(
    """SELECT id FROM assets WHERE parent_id IN (SELECT id FROM nodes WHERE parent_id = 'r:1')""",
    "assets",
    "nodes",
)
def scope_assets(w):
    """The assets that a continent stands for."""
    return graph.scope_assets(w.nodes(), "r:1")


@query(
    """SELECT id FROM edges WHERE asset_id = 'o:7' OR (from_id IN ('s:1', 's:2', 's:3') AND to_id IN ('p:1', 'p:2', 'p:3', 'p:4', 'p:5', 'p:6', 'p:7', 'p:8', 'p:9'))""",
    "edges",
)
def constellation_edges(w):
    """Edges of one order, and those among some suppliers and parts."""
    nodes = w.spark.createDataFrame([(f"s:{i}",) for i in range(1, 4)] + [(f"p:{i}",) for i in range(1, 10)], "id string")
    return graph.constellation(w.edges(), w.edges().where("asset_id = 'o:7'"), nodes).select("id")


@query(
    """, m AS (SELECT part AS e, id AS passage, seq, parent_id FROM passages UNION ALL SELECT supplier, id, seq, parent_id FROM passages),
       x AS (SELECT a.supplier || '>' || a.part AS id, arg_min(b.id, (b.seq, b.id)) AS passage_id FROM
             (SELECT supplier, part, min(id) AS main FROM passages GROUP BY ALL) a JOIN passages b ON b.supplier = a.supplier AND b.part = a.part AND b.id <> a.main GROUP BY 1)
       SELECT * FROM x""",
    "passages",
)
def corroborating_evidence(w):
    """For each supplier and part the first passage with both besides the least id."""
    p = w.settled().passages()
    pairs = p.groupBy(F.col("supplier").alias("from_id"), F.col("part").alias("to_id")).agg(F.min("id").alias("primary")).withColumn("id", F.concat("from_id", F.lit(">"), "to_id"))
    mentions = p.select(F.col("part").alias("id"), F.col("id").alias("passage_id"), "seq").unionByName(p.select(F.col("supplier").alias("id"), F.col("id").alias("passage_id"), "seq"))
    return graph.corroborated(pairs, mentions)


@query(
    """SELECT segment_id, coalesce(sum(length(text) + 2) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start,
         'sha256:' || substr(sha256(text), 1, 32) AS span_hash FROM segments WHERE seq > 0""",
    "segments",
)
def passage_offsets(w):
    rows = w.segments().where("seq > 0").select(F.col("segment_id").alias("id"), F.col("source_id").alias("parent_id"), "seq", "text")
    return graph.passage_offsets(rows).select(F.col("id").alias("segment_id"), "char_start", "span_hash")


@query("SELECT parent_id AS from_id, arg_min(part, (seq, part)) AS to_id, '_covers_period' AS family FROM passages GROUP BY parent_id", "passages")
def first_periods(w):
    return graph.first_periods(w.passages().select("parent_id", F.col("part").alias("id"), "seq"))


@query(
    """vocabulary AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(p_name, '[0-9A-Za-zÀ-ɏ]+')) AS w FROM part UNION ALL SELECT unnest(regexp_extract_all(text, '[0-9A-Za-zÀ-ɏ]+')) FROM benchmark))
       SELECT id, w AS label FROM (SELECT DISTINCT doc_id::VARCHAR AS id, unnest(regexp_extract_all(text, '[0-9A-Za-zÀ-ɏ]+')) AS w FROM documents) SEMI JOIN vocabulary USING (w)"""
)
def detected_mentions(w):
    """Words of part names and of the benchmark in whole documents."""
    words = lambda t, c: w.table(t).select(F.explode(F.regexp_extract_all(F.col(c), F.lit("[0-9A-Za-zÀ-ɏ]+"), F.lit(0))).alias("label"))
    labels = words("part", "p_name").unionByName(words("benchmark", "text"))
    return detection.detected_mentions(w.table("documents").select(F.col("doc_id").cast("string").alias("id"), "text"), labels)


# -- rendering --------------------------------------------------------------------------------

QUESTION = "Which antique or burnished steel parts does the supplier of plated brass deliver?"


@query(
    f"""SELECT list_distinct(list_filter(string_split_regex(lower('{QUESTION}'), '{T.TERM_BREAK}'),
         lambda t: length(t) >= 3 AND NOT list_contains({T.STOPWORDS!r}, t))) AS found, unnest(list_sort(found)) AS term"""
    .replace("SELECT list_distinct", "SELECT term FROM (SELECT list_distinct")
    + ")"
)
def question_terms(w):
    one = w.spark.range(1).select(F.explode(T.content_terms(F.lit(QUESTION))).alias("term"))
    return one


@query(
    f"""SELECT id, label, score FROM (SELECT id, label, list_sum(list_transform(list_filter(string_split_regex(lower(label), '[^a-z0-9]+'),
         lambda t: length(t) > 2 AND contains(lower('{QUESTION}'), t)), lambda t: length(t)))::DOUBLE + 0.5 AS score FROM nodes WHERE id LIKE 'p:%') WHERE score IS NOT NULL""",
    "nodes",
)
def entity_match(w):
    return render.entity_matches(QUESTION, w.nodes().where("id LIKE 'p:%'").withColumn("centrality", F.lit(0.5)))


@query(
    """, q AS (SELECT doc_id // 20 AS question, doc_id, greatest(1, floor(length(text) / 4.0 + 0.5))::BIGINT + 128 AS cost FROM documents),
       r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY doc_id) AS n, sum(cost) OVER (PARTITION BY question ORDER BY doc_id) AS spent FROM q)
       SELECT question, doc_id, cost, spent::BIGINT AS spent FROM r WHERE n <= 5 AND spent <= 3000""".replace(", q", "q", 1)
)
def cited_passages(w):
    """Citations of questions under a budget, up to the first that overflows."""
    rows = w.table("documents").select(F.expr("doc_id div 20").alias("question"), "doc_id", render.citation_cost(F.col("text")).alias("cost"))
    return render.budgeted(rows, ["doc_id"], 3000, 5, ["question"]).select("question", "doc_id", "cost", "spent")


def candidates(w: World) -> DataFrame:
    """Each order's parts as candidates of a question, in reading order."""
    rows = w.passages().select(F.col("parent_id").alias("question"), F.col("seq").alias("place"), F.col("id"), (F.col("seq") == 0).alias("on_path"))
    return rows.select("*", F.lit(2).alias("mentions"), (F.length("id") % 5).cast("int").alias("assets"))


_FOLD = """RECURSIVE , c AS (SELECT parent_id AS question, seq, id, seq = 0 AS on_path, length(id)::INT % 5 AS a FROM passages),
    f AS (SELECT question, seq, id, CASE WHEN fits THEN cost ELSE 0 END AS spent, fits::INT AS n, CASE WHEN fits THEN 1 ELSE 0 END AS lod, CASE WHEN fits THEN cost ELSE 0 END AS cost
            FROM (SELECT *, 128 + 24 + 24 * a AS cost, 128 + 24 + 24 * a <= 500 AS fits FROM c WHERE seq = 0)
          UNION ALL
          SELECT question, seq, id, spent + CASE WHEN spent + cost <= 500 THEN cost ELSE 0 END, n + (spent + cost <= 500)::INT,
                 CASE WHEN spent + cost > 500 THEN 0 WHEN summary THEN 1 ELSE 2 END, CASE WHEN spent + cost <= 500 THEN cost ELSE 0 END
            FROM (SELECT c.question, c.seq, c.id, f.spent, f.n, f.n < 2 AS summary, CASE WHEN f.n < 2 THEN 128 + 24 + 24 * c.a ELSE 32 + c.a END AS cost FROM f JOIN c ON c.question = f.question AND c.seq = f.seq + 1)) """


@query(_FOLD + "SELECT question, id, lod::INT AS lod, cost::BIGINT AS cost FROM f", "passages")
def admission_fold(w):
    """Greedy admission of each order's passages under a budget, overflowing ones skipped."""
    return render.admission(candidates(w), 500, slots=2)


@query(
    _FOLD
    + """SELECT question, count(*) FILTER (lod = 1) AS summaries, count(*) FILTER (lod = 2) AS pointers, count(*) FILTER (lod = 0) AS evicted, sum(cost)::BIGINT AS tokens,
           (count(*) * 400)::BIGINT AS counterfactual, round(100.0::DOUBLE * (1 - sum(cost) / (count(*) * 400)::DOUBLE), 1) AS saved_pct FROM f GROUP BY question""",
    "passages",
)
def render_stats(w):
    whole = w.passages().groupBy(F.col("parent_id").alias("question")).agg((F.count("*") * 400).alias("counterfactual"))
    return render.render_stats(render.admission(candidates(w), 500, slots=2), whole)


@query("SELECT sigma AS family, count(*) AS edges FROM edges WHERE NOT quarantined GROUP BY sigma", "edges")
def families_used(w):
    return render.families_used(w.edges().withColumn("family", F.col("sigma")))


@query(
    """SELECT parent_id AS question, round((0.4 * 0.5 + 0.1 * least(count(*), 4) / 4.0 + 0.25)::DOUBLE / 0.75, 2) AS composite FROM passages GROUP BY 1""",
    "passages",
)
def composite_confidence(w):
    """The weighted mean of three signals; the fourth is missing and its weight is shared."""
    signals = w.passages().groupBy(F.col("parent_id").alias("question")).agg((F.least(F.count("*"), F.lit(4)) / 4.0).alias("temporal"))
    return render.composite(signals.select("question", F.lit(0.5).alias("semantic"), F.lit(None).cast("double").alias("topology"), "temporal", F.lit(1.0).alias("authorial")))


# -- layout -----------------------------------------------------------------------------------


@query("SELECT community AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM positions GROUP BY community", "positions")
def spine_centroids(w):
    return layout.spine_centroids(w.positions(), w.positions().select("id", F.col("community").alias("parent_id")))


@query("SELECT round(min(x - r), 6) AS min_x, round(max(x + r), 6) AS max_x, round(min(y - r), 6) AS min_y, round(max(y + r), 6) AS max_y FROM positions", "positions")
def bounds(w):
    return layout.bounds(w.positions())


@query(
    """SELECT a.id AS point, b.id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM positions a JOIN positions b
       ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25 WHERE substr(a.id, 3)::BIGINT % 100 = 1""",
    "positions",
)
def radius_query(w):
    points = w.positions().where("CAST(substring(id, 3) AS LONG) % 100 = 1").select(F.col("id").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"))
    return layout.within_radius(w.positions(), points, 25.0).withColumn("distance", F.round("distance", 6))


@query("SELECT id FROM positions WHERE x BETWEEN 100 AND 220 AND y BETWEEN 300 AND 480", "positions")
def rect_query(w):
    return layout.within_rect(w.positions(), 100, 300, 220, 480).select("id")


@query("SELECT id FROM positions WHERE (x - 500) ** 2 + (y - 500) ** 2 <= (r + 40) ** 2 ORDER BY r, (x - 500) ** 2 + (y - 500) ** 2, id LIMIT 1", "positions")
def pick_at(w):
    return layout.picked(w.positions(), 500, 500, slop=40)


@query("SELECT community, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(sqrt(var_pop(x) + var_pop(y)), 6) AS spread FROM positions GROUP BY community", "positions")
def community_spread(w):
    return layout.community_spread(w.positions())


@query("SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM positions", "positions")
def anchored_rebake(w):
    """Turned, scaled and moved positions, taken back to the frame of the old ones."""
    old = w.positions()
    new = old.withColumn("__x", F.col("x") * 0.6 - F.col("y") * 0.8 + 12).withColumn("y", F.col("x") * 0.8 + F.col("y") * 0.6 - 7).withColumn("x", F.col("__x")).drop("__x")
    fit = layout.similarity(old, new, old.select("id", F.lit(1.0).alias("w")))
    return layout.rebaked(new, fit).select("id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"))


@query(
    """, q AS (SELECT quantile_cont(x, 0.005) AS x0, quantile_cont(x, 0.995) AS x1, quantile_cont(y, 0.005) AS y0, quantile_cont(y, 0.995) AS y1 FROM positions)
       SELECT id, round((x - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0) * 1000, 6) AS x, round((y - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0) * 1000, 6) AS y FROM positions, q""",
    "positions",
)
def extent_fit(w):
    return layout.fitted(w.positions()).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    """, g AS (SELECT id, x, round(y / (20 * sqrt(3) / 2)) AS k FROM positions)
       SELECT id, round((x - abs(k % 2) * 10) / 20) * 20 + abs(k % 2) * 10 AS gx, round(k * 20 * sqrt(3) / 2, 6) AS gy FROM g""",
    "positions",
)
def latent_grid(w):
    return layout.snapped(w.positions(), 20.0).select("id", "gx", F.round("gy", 6).alias("gy"))


@query()
def principal_axes(w):
    """Two principal components of the relation vectors; held against a dense computation in the tests."""
    r = w.relations().select(F.col("relation").alias("id"), "v")
    return layout.principal_axes(r, r.agg(F.max(F.size("v"))).first()[0] or 1)


# -- answers ----------------------------------------------------------------------------------


@query(
    """SELECT sigma, count(*) AS total, count(*) FILTER (sigma IN ('factual', 'temporal') AND NOT quarantined) AS shown, count(*) FILTER (NOT (sigma IN ('factual', 'temporal') AND NOT quarantined)) AS withheld
       FROM edges GROUP BY sigma""",
    "edges",
)
def sigma_filter_counts(w):
    return A.sigma_counts(w.edges(), ("factual", "temporal"))


@query(
    """, f AS (SELECT a.n_nationkey AS key, unnest(['name', 'region']) AS facet, unnest([a.n_name, a.n_regionkey::VARCHAR]) AS l, unnest([b.n_name, CASE WHEN b.n_nationkey % 4 = 0 THEN NULL ELSE b.n_regionkey::VARCHAR END]) AS r
          FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25)
       SELECT key, facet, l AS "left", r AS "right", CASE WHEN l IS NULL OR r IS NULL THEN 'unknown' WHEN l = r THEN 'same' ELSE 'different' END AS verdict FROM f""".replace(", f", "f", 1)
)
def compare_facets(w):
    """Nations compared with others, facet by facet."""
    n = w.table("nation")
    left = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    right = n.select(F.expr("CAST((n_nationkey + 20) % 25 AS INT)").alias("key"), F.col("n_name").alias("name"), F.expr("CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END").alias("region"))
    return A.compared(left, right, ["key"], ["name", "region"])


@query(
    """SELECT id, CASE WHEN k % 7 = 0 THEN 'lod-0' WHEN k % 5 = 0 THEN 'lod-1' WHEN k % 3 = 0 THEN 'ghost' ELSE 'lod-2' END AS lod FROM (SELECT id, substr(id, 3)::BIGINT AS k FROM positions)""",
    "positions",
)
def lod_states(w):
    k = lambda n: w.positions().where(f"CAST(substring(id, 3) AS LONG) % {n} = 0").select("id")
    return A.lod_states(w.positions().select("id", F.lit(2).alias("hint")), k(3), k(5), k(7))


@query(
    """SELECT CASE WHEN from_id = 's:1' THEN to_id ELSE from_id END AS other, arg_min(id, (quarantined, id)) AS edge_id, bool_and(quarantined) AS quarantined FROM edges WHERE 's:1' IN (from_id, to_id) GROUP BY 1""", "edges"
)
def reach_map(w):
    return A.reach(w.edges(), "s:1").select("other", "edge_id", "quarantined")


@query(
    """SELECT CASE WHEN k % 7 = 0 THEN 'lod-0' WHEN k % 5 = 0 THEN 'lod-1' ELSE 'hole' END AS lod, count(*) AS nodes FROM (SELECT substr(id, 3)::BIGINT AS k FROM positions) GROUP BY 1""",
    "positions",
)
def lod_histogram(w):
    k = F.col("id").substr(3, 20).cast("long")
    lod = w.positions().select("id", F.when(k % 7 == 0, "lod-0").when(k % 5 == 0, "lod-1").alias("lod")).where("lod IS NOT NULL")
    return A.lod_histogram(w.positions(), lod)


@query(
    """SELECT 'families' AS "group", sigma AS key, count(*)::BIGINT AS n FROM edges WHERE NOT quarantined GROUP BY sigma UNION ALL SELECT 'omitted', reason, count(*) FROM edges WHERE quarantined GROUP BY reason""",
    "edges",
)
def receipt_groups(w):
    used = w.edges().where("NOT quarantined").groupBy("sigma").agg(F.count("*").alias("edges"))
    return A.receipt_groups(used, w.edges().where("quarantined"))


@query(
    """SELECT relation, CASE WHEN vec_id % 5 = 0 THEN 'mapped' WHEN vec_id % 5 = 1 THEN 'generic' WHEN vec_id % 5 = 2 THEN 'family' ELSE 'unknown' END AS kind,
         CASE WHEN vec_id % 5 = 0 THEN 'rel:' || (vec_id + 2) WHEN vec_id % 5 = 2 THEN relation END AS family FROM relations""",
    "relations",
)
def string_families(w):
    """A made mapping: every fifth relation goes to the one two further on, and so on."""
    r = w.relations()
    mapping = r.where("vec_id % 5 < 2").select("relation", F.expr("CASE WHEN vec_id % 5 = 0 THEN concat('rel:', vec_id + 2) END").alias("family"), F.expr("CASE WHEN vec_id % 5 = 1 THEN 'generic' END").alias("note"))
    return closure.string_families(r, mapping)


@query(
    """SELECT doc_id, (list_position(list_transform(list_zip(string_split(text, ''), string_split(upper(text), '')), lambda x: x[1] IS DISTINCT FROM x[2]), true) - 1)::INT AS "at"
       FROM documents WHERE text <> upper(text)"""
)
def first_difference(w):
    """Where whole texts and their capitals differ first."""
    found = w.table("documents").select("doc_id", A.first_difference(F.col("text"), F.upper("text")).alias("d"))
    return found.where("d IS NOT NULL").select("doc_id", "d.at")


# -- portability, hashes, signatures ----------------------------------------------------------


@query(
    """, u AS (SELECT id FROM passages WHERE substr(parent_id, 3)::BIGINT % 2 = 0)
       SELECT part AS id, CASE WHEN bool_and(id IN (SELECT id FROM u)) THEN 'derived' ELSE 'boundary' END AS scope FROM passages GROUP BY part HAVING bool_or(id IN (SELECT id FROM u))""",
    "passages",
)
def portable_closure(w):
    unit = w.passages().where("CAST(substring(parent_id, 3) AS LONG) % 2 = 0").select(F.col("id").alias("passage_id"))
    return portable.node_closure(w.passages().select(F.col("part").alias("id"), F.col("id").alias("passage_id")), unit)


@query("SELECT doc_id, sha256(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash FROM documents")
def eol_hash(w):
    """Hashes of texts with CRLF line ends, unified."""
    return w.table("documents").select("doc_id", T.line_hash(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("hash"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def digest_normalize(w):
    spelled = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise(F.concat(F.lit("SHA256:"), F.sha2("text", 256)))
    return w.table("documents").select("doc_id", T.qualified_digest(spelled).alias("digest"))


@query("""SELECT 'ans:' || event_id AS answer_id, 'sha256:' || sha256('{"answer":"ans:' || event_id || '","kind":"' || event_type || '","user":' || user_id || '}') AS payload_hash FROM events""")
def payload_hash(w):
    raw = F.concat(F.lit('{"user": '), "user_id", F.lit(', "kind": "'), "event_type", F.lit('", "answer": "ans:'), "event_id", F.lit('"}'))
    return w.table("events").select(F.concat(F.lit("ans:"), "event_id").alias("answer_id"), T.payload_hash(trust.canonical_json(raw)).alias("payload_hash"))


@query("SELECT vec_id, 'sha256:' || sha256('{\"id\":' || vec_id || ',\"label\":' || label || '}') AS payload_hash, true AS valid, 'ok' AS reason FROM embeddings ")
def sign_verify_roundtrip(w):
    """Every relation as a signed envelope, verified."""
    rows = w.table("embeddings").select("vec_id", F.to_json(F.struct("label", F.col("vec_id").alias("id"))).alias("payload"))
    out = trust.signed(rows, "portable_artifact", bytes(range(32)), "2024-01-01T00:00:00+00:00")
    return out.select("vec_id", F.get_json_object("envelope", "$.payload_hash").alias("payload_hash"), trust.verified("envelope").alias("v")).select("vec_id", "payload_hash", "v.valid", "v.reason")


# -- traces, verification, plans of answers -----------------------------------------------------


@query(
    """SELECT source_id, 'c' || (length(text) % 3) AS cluster_id, seq AS mention_idx, row_number() OVER (PARTITION BY source_id ORDER BY 'c' || (length(text) % 3), seq)::INT AS place
       FROM segments WHERE seq > 0""",
    "segments",
)
def mention_ledger(w):
    """Every line as a mention, clustered by its length, in ledger order."""
    mentions = w.segments().where("seq > 0").select("source_id", F.concat(F.lit("c"), F.length("text") % 3).alias("cluster_id"), F.col("seq").alias("mention_idx"))
    return P.mention_ledger(mentions, w.sources())


@query(
    """SELECT a.answer_id, CASE WHEN count(e.source_label) = 0 THEN 'none' WHEN count(e.source_label) = count(e.answer_id) THEN 'full' ELSE 'partial' END AS coverage,
         coalesce(bool_or(has_overlay AND seq > 0), false) AS disclosed,
         coalesce(string_agg(cite_order || '=' || segment_id || '=' || CASE WHEN has_overlay AND seq > 0 THEN 'resolved' ELSE 'verbatim' END, ';' ORDER BY cite_order), '') AS citations
       FROM answers a LEFT JOIN explained e ON e.answer_id = a.answer_id GROUP BY a.answer_id""",
    "explained",
    "answers",
)
def render_traces(w):
    said = F.transform("citations", lambda c: F.concat_ws("=", c["cite_order"].cast("string"), c["segment_id"], F.when(c["verbatim"], "verbatim").otherwise("resolved")))
    return P.render_traces(w.answers(), explained(w)).select("answer_id", "coverage", F.col("resolution_disclosure").isNotNull().alias("disclosed"), F.array_join(said, ";").alias("citations"))


@query(
    """, v AS (SELECT 'ans:' || doc_id * 13 AS answer_id FROM labels WHERE doc_id % 3 = 0)
       SELECT answer_id, claim_index, verdict, '' AS markers, (SELECT count(*) FROM evidence e WHERE e.answer_id = c.answer_id AND e.claim_index = c.claim_index) AS evidence
       FROM claims c WHERE answer_id NOT IN (SELECT answer_id FROM v)
       UNION ALL SELECT answer_id, k::INT, CASE k WHEN 0 THEN 'supported' ELSE 'contradicted' END, CASE k WHEN 0 THEN '1,2' ELSE '' END, 1 - k FROM v, (SELECT unnest([0, 1]) AS k)""",
    "claims",
    "evidence",
)
def recorded_claims(w):
    """Claims and how much evidence they have, once every third answer is verified anew."""
    nested = w.table("labels").where("doc_id % 3 = 0").selectExpr(
        "concat('ans:', doc_id * 13) AS answer_id",
        """array(named_struct('claim_index', 0, 'verdict', 'supported', 'confidence', 1D, 'markers', array('1', '2'),
                   'evidence', array(named_struct('rank', 1, 'segment_id', concat('seg:', doc_id, ':0'), 'score', 0.9D, 'role', 'candidate'))),
                 named_struct('claim_index', 1, 'verdict', 'contradicted', 'confidence', 0D, 'markers', array(), 'evidence', array())) AS claims""",
    )
    claims, evidence = P.recorded_claims(w.claims().withColumn("markers", F.lit("")), w.evidence(), nested)
    count = evidence.groupBy("answer_id", "claim_index").agg(F.count("*").alias("evidence"))
    return claims.join(count, ["answer_id", "claim_index"], "left").select("answer_id", "claim_index", "verdict", "markers", F.coalesce("evidence", F.lit(0)).alias("evidence"))


@query(
    """SELECT 'ans:' || doc_id * 13 AS answer_id, CASE WHEN doc_id % 3 = 0 THEN '{"beta": 0.25, "tau": ' || (1 + quality) / 2.0::DOUBLE || '}' ELSE '{}' END AS thresholds,
         CASE WHEN doc_id % 3 = 0 THEN '["cosine", "nli \\"b\\""]' ELSE '[]' END AS tiers_offered FROM labels"""
)
def recorded_runs(w):
    """Verification runs, every third replaced."""
    ids = w.table("labels").select("doc_id", "quality", F.concat(F.lit("ans:"), F.expr("doc_id * 13")).alias("answer_id"))
    old = ids.select("answer_id", F.lit("{}").alias("thresholds"), F.lit("[]").alias("tiers_offered"))
    new = ids.where("doc_id % 3 = 0").select("answer_id", F.expr("map('tau', (1 + quality) / 2D, 'beta', 0.25D)").alias("thresholds"), F.array(F.lit("cosine"), F.lit('nli "b"')).alias("tiers_offered"))
    return P.recorded_runs(old, new)


def entities(w: World) -> DataFrame:
    """Parts and suppliers, their centrality made of their numbers."""
    rows = w.nodes().where("id LIKE 'p:%' OR id LIKE 's:%'")
    return rows.withColumn("aliases", F.array("id")).withColumn("centrality", F.expr("(CAST(substring(id, 3) AS LONG) * 7) % 100 / 100D"))


_MATCH = f""", t AS (SELECT unnest(list_filter(string_split_regex(lower('{QUESTION}'), '{T.TERM_BREAK}'), lambda t: length(t) > 2)) AS t),
    m AS (SELECT id, label, sum(length(t))::DOUBLE + any_value((substr(id, 3)::BIGINT * 7) % 100 / 100.0::DOUBLE) AS score
          FROM nodes, t WHERE (id LIKE 'p:%' OR id LIKE 's:%') AND contains(lower(label || ' ' || id), t) GROUP BY id, label) """


@query(_MATCH + "SELECT id, label, round(score, 6) AS score FROM m", "nodes")
def lexical_matches(w):
    return render.lexical_matches(QUESTION, entities(w)).withColumn("score", F.round("score", 6))


@query(
    _MATCH
    + """, b AS (SELECT id, score FROM m ORDER BY score DESC, id LIMIT 1)
         SELECT (SELECT id FROM b) AS best, (SELECT round(score, 6) FROM b) AS score, (SELECT id FROM m WHERE id < (SELECT id FROM b) ORDER BY m.score DESC, id LIMIT 1) AS second,
           CASE WHEN NOT EXISTS (SELECT * FROM b) THEN 'QUERY_NO_MATCH' END AS error""",
    "nodes",
)
def best_match(w):
    """What a question names, the best before it, and the error without any."""
    return render.best_match(render.lexical_matches(QUESTION, entities(w))).withColumn("score", F.round("score", 6))


@query(
    """SELECT event_id AS question, CASE WHEN event_type = 'view' THEN 'pinned' WHEN event_id % 3 < 2 THEN 'staged' ELSE 'free' END AS route,
         CASE WHEN event_type = 'view' THEN 'q:view' WHEN event_id % 3 < 2 THEN 'Q:' || user_id END AS query_id FROM events"""
)
def dispatched(w):
    """Events as questions: one kind is pinned, others name a staged question by id or by text."""
    e = w.table("events")
    text = F.expr("CASE WHEN event_type = 'view' THEN ' View ' WHEN event_id % 3 = 0 THEN concat('q:', user_id) WHEN event_id % 3 = 1 THEN concat('What of ', user_id, '?') ELSE concat('free ', event_id) END")
    staged = e.select(F.concat(F.lit("Q:"), "user_id").alias("query_id"), F.concat(F.lit("what of "), "user_id", F.lit("?")).alias("text")).distinct()
    pinned = w.spark.createDataFrame([("view", "q:view")], "text string, query_id string")
    return render.dispatched(e.select(F.col("event_id").alias("question"), text.alias("text")), pinned, staged)


def staged(w: World) -> DataFrame:
    """A staged question for each order: its passages' chain, and its edges and nodes."""
    p = w.passages().select(F.col("parent_id").alias("query_id"), F.struct("seq", F.col("supplier").alias("subject"), F.lit("supplies").alias("family"), F.col("part").alias("object")).alias("c"), "id", F.expr("concat('x:', substring(parent_id, 3), '-', substring(part, 3), '-', substring(supplier, 3))").alias("e"))
    rows = p.groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("c"), F.collect_list("e").alias("gold_edge_ids"), F.collect_list("id").alias("ids"))
    chain = F.transform("c", lambda c: F.struct(c["subject"].alias("subject"), c["family"].alias("family"), c["object"].alias("object")))
    return rows.select("query_id", F.concat(F.lit("Order "), "query_id").alias("gold"), chain.alias("chain"), "gold_edge_ids", F.concat("ids", F.array("query_id")).alias("gold_node_ids"))


@query("SELECT parent_id AS query_id, 'Order ' || parent_id || '. ' || string_agg(supplier || ' delivers ' || part, '; ' ORDER BY seq) || '.' AS answer FROM passages GROUP BY parent_id", "passages")
def staged_answers(w):
    return render.staged_answers(staged(w), w.spark.createDataFrame([("supplies", "delivers")], "family string, label string"))


@query("SELECT DISTINCT parent_id AS query_id, unnest([supplier, part, parent_id]) AS id FROM passages", "passages")
def staged_seeds(w):
    return render.staged_seeds(staged(w), w.edges(), w.nodes())


@query(
    """, own AS (SELECT DISTINCT unnest([from_id, to_id]) AS id FROM edges WHERE asset_id = 'o:7'),
       ids AS (SELECT id FROM own UNION SELECT 's:1' UNION SELECT 'o:7' UNION SELECT to_id FROM edges WHERE NOT quarantined AND from_id IN (SELECT id FROM own)
               UNION SELECT from_id FROM edges WHERE NOT quarantined AND to_id IN (SELECT id FROM own))
       SELECT id, kind, id IN (SELECT id FROM own) AS on_path FROM ids JOIN nodes USING (id) WHERE kind = 'entity'""",
    "edges",
    "nodes",
)
def candidate_nodes(w):
    """What the answer of one order may admit; the order itself isn't on the path and is left out."""
    seeds = w.spark.createDataFrame([("s:1",), ("o:7",)], "id string")
    return render.candidate_nodes(w.edges().where("asset_id = 'o:7'"), seeds, w.edges(), w.nodes().withColumn("centrality", F.lit(0.5))).drop("centrality")


@query(
    """SELECT id AS passage_id, array_to_string(list_sort(list_filter([part, supplier], lambda x: substr(x, 3)::BIGINT % 3 = 0)), ',') AS entity_ids FROM passages""",
    "passages",
)
def mention_links(w):
    """The entities of each passage whose number three divides."""
    p = w.passages()
    mentions = p.select(F.col("id").alias("passage_id"), F.explode(F.array("part", "supplier")).alias("id"))
    admitted = w.nodes().where("kind = 'entity' AND CAST(substring(id, 3) AS LONG) % 3 = 0")
    return render.mention_links(p.select(F.col("id").alias("passage_id")), mentions, admitted).withColumn("entity_ids", F.array_join("entity_ids", ","))


@query("""SELECT count(*) FILTER (sigma <> 'structural') AS gated, round(count(*) FILTER (quarantined) / count(*) FILTER (sigma <> 'structural')::DOUBLE, 6) AS rate FROM edges""", "edges")
def truth_gated_rate(w):
    return graph.truth_gated_rate(w.edges()).withColumn("rate", F.round("rate", 6))


@query("SELECT DISTINCT supplier AS id FROM passages WHERE parent_id IN (SELECT id FROM assets WHERE parent_id = 'n:1')", "passages", "assets")
def entity_overlay(w):
    """Suppliers and parts are entities; suppliers have their orders as places."""
    places = w.passages().select(F.col("supplier").alias("id"), F.col("parent_id").alias("place_id"))
    return graph.entity_overlay(entities(w), places, w.assets().where("parent_id = 'n:1'")).select("id")


@query(
    """, near AS (SELECT 's:1' AS id UNION SELECT to_id FROM edges WHERE NOT quarantined AND from_id = 's:1')
       SELECT id FROM edges WHERE (from_id IN (SELECT id FROM near) OR to_id IN (SELECT id FROM near)) ORDER BY weight DESC, id LIMIT 512""",
    "edges",
)
def hover_edges(w):
    """The heaviest edges around one supplier, all nodes in view."""
    return graph.hover_edges(written(w.edges(), "edges"), w.nodes().select("id"), "s:1").select("id")


@query(
    """, o AS (SELECT id FROM assets WHERE parent_id = 'n:3'),
       ev AS (SELECT "at", id, 'boundary' AS event FROM assets WHERE parent_id = 'n:3'
              UNION ALL SELECT "at", id, family FROM edges WHERE sigma IN ('temporal', 'episodic') AND NOT quarantined AND asset_id IN (SELECT id FROM o)),
       f AS (SELECT * FROM ev WHERE "at" BETWEEN '1995-01-01' AND '1996-12-31')
       SELECT *, (SELECT greatest(count(*) - 50, 0) FROM f) AS truncated FROM f ORDER BY "at", id LIMIT 50""",
    "assets",
    "edges",
)
def scoped_timeline(w):
    """The first events of one island, and how many there are beyond."""
    owners = w.assets().select(F.concat(F.lit("l:"), F.expr("substring(id, 3)")).alias("id"), F.col("id").alias("asset_id"))
    return graph.scoped_timeline(w.assets(), w.edges(), owners, w.assets().where("parent_id = 'n:3'"), "1995-01-01", "1996-12-31", 50)


@query(
    """, d AS (SELECT b.id, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM positions a, positions b WHERE a.id = 'p:11' AND b.id <> 'p:11'),
       c AS (SELECT direction, id, d, (dx * ax + dy * ay) / d AS cos FROM d, (VALUES ('up', 0, 1), ('down', 0, -1), ('left', -1, 0), ('right', 1, 0)) v(direction, ax, ay) WHERE d > 0)
       SELECT direction, arg_min(id, (d / (cos * cos), id)) AS id FROM c WHERE cos > 0.5000000000000001 GROUP BY direction""",
    "positions",
)
def nearest_in_direction(w):
    return A.nearest_in_direction(w.positions(), "p:11").select("direction", "id")


@query("SELECT id FROM positions WHERE abs(x - 400) <= 300 / 2 * 0.88 AND abs(y - 300) <= 200 / 2 * 0.88", "positions")
def inside_frustum(w):
    return w.positions().where(A.inside_frustum(F.col("x"), F.col("y"), (400, 300, 300, 200))).select("id")


@query("SELECT id AS edge_id, len(evidence) AS attached, CASE WHEN substr(asset_id, 3)::BIGINT % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS admitted FROM edges", "edges")
def hop_evidence(w):
    """Every edge as a step; every third order's passage is cited."""
    cited = w.assets().where("CAST(substring(id, 3) AS LONG) % 3 = 0").select(F.concat(F.lit("l:"), F.expr("substring(id, 3)")).alias("passage_id"))
    return A.hop_evidence(w.edges().withColumnRenamed("id", "edge_id"), cited).withColumn("attached", F.col("attached").cast("long"))


@query(
    """SELECT evidence[1] AS passage_id, from_id FROM edges UNION ALL SELECT 'none:' || n_nationkey, 's:1' FROM nation WHERE n_nationkey % 2 = 0""",
    "edges",
)
def citation_edges(w):
    """Every order's passage on the subjects of its edges; some passages of no step on a bridge."""
    own = w.assets().select(F.concat(F.lit("l:"), F.expr("substring(id, 3)")).alias("passage_id"), F.lit(False).alias("bridged"))
    other = w.table("nation").select(F.concat(F.lit("none:"), "n_nationkey").alias("passage_id"), F.expr("n_nationkey % 2 = 0").alias("bridged"))
    return A.citation_edges(own.unionByName(other), w.edges(), "s:1")


from . import world_queries  # noqa: E402,F401  (registers its queries)

__all__ = ["ORACLES", "QUERIES"]
