"""Reads and upserts of the provenance store. All inputs and results are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explain_citations(citations: DataFrame, segments: DataFrame, sources: DataFrame, overlay: DataFrame) -> DataFrame:
    """Every citation with its segment and source; those of unknown segments keep nulls."""
    seg = segments.select("segment_id", "source_id", "seq", "text")
    src = sources.select("source_id", "source_label", "source_type", "content_hash")
    over = overlay.select("source_id", F.lit(True).alias("__o"))
    return (
        citations.join(seg, "segment_id", "left")
        .join(src, "source_id", "left")
        .join(over, "source_id", "left")
        .select("answer_id", "cite_order", "segment_id", "evidence_snippet", "source_id", "seq", "source_label", "source_type", "content_hash", F.coalesce("__o", F.lit(False)).alias("has_overlay"))
    )


def trace_coverage(answers: DataFrame, explained: DataFrame) -> DataFrame:
    """none, partial or full per answer, with counts of citations, sources found and verbatim segments."""
    found = F.col("source_label").isNotNull()
    verbatim = found & ~(F.col("has_overlay") & (F.col("seq") > 0))
    per = explained.groupBy("answer_id").agg(
        F.count("*").alias("n"), F.count(F.when(found, 1)).alias("known"), F.count(F.when(verbatim, 1)).alias("verbatim")
    )
    n, known = F.coalesce("n", F.lit(0)), F.coalesce("known", F.lit(0))
    coverage = F.when(known == 0, "none").when(known == n, "full").otherwise("partial")
    return answers.select("answer_id").join(per, "answer_id", "left").select("answer_id", n.alias("citations"), known.alias("known"), F.coalesce("verbatim", F.lit(0)).alias("verbatim"), coverage.alias("coverage"))


def verdicts_by_strategy(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """Claims per (strategy, verdict); missing strategies are 'unattributed', orphan claims don't count."""
    named = answers.select("answer_id", F.coalesce(F.nullif("render_strategy", F.lit("")), F.lit("unattributed")).alias("strategy"))
    return claims.join(named, "answer_id").groupBy("strategy", "verdict").agg(F.count("*").alias("claims"))


def claims_with_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with their evidence as an array in rank order (empty without any)."""
    lists = evidence.groupBy("answer_id", "claim_index").agg(F.sort_array(F.collect_list(F.struct("rank", "segment_id", "score", "role"))).alias("evidence"))
    none = F.array().cast("array<struct<rank:int,segment_id:string,score:double,role:string>>")
    return claims.join(lists, ["answer_id", "claim_index"], "left").withColumn("evidence", F.coalesce("evidence", none))


def segment_context(anchors: DataFrame, segments: DataFrame, window: int = 1) -> DataFrame:
    """Segments within ``window`` of each anchor by seq, in the anchor's primary source.

    The range condition is on seq, which may have gaps; rows meet by source, and each segment
    is put into the ``2 * window + 1`` places that it can serve, so the join is an equi-join.
    """
    own = anchors.select(F.col("segment_id").alias("anchor_id")).where("anchor_id <> ''").distinct()
    own = own.join(segments.select(F.col("segment_id").alias("anchor_id"), "source_id", F.col("seq").alias("at")), "anchor_id")
    near = segments.select("segment_id", "source_id", "seq", F.explode(F.sequence(F.col("seq") - window, F.col("seq") + window)).alias("at"))
    return own.join(near, ["source_id", "at"]).select("anchor_id", "segment_id", "source_id", "seq")


def heading_segment(headings: DataFrame, segments: DataFrame) -> DataFrame:
    """The segment of each (source_id, heading): bold, then '#', then bare; the last by seq."""
    like = lambda before, after: F.expr(f"lower(text) LIKE concat('%{before}', lower(heading), '{after}%')")
    rank = F.when(like("**", "**"), 1).when(like("# ", ""), 2).when(like("", ""), 3)
    hits = headings.join(segments.where("seq > 0"), "source_id").withColumn("pass", rank).where("pass IS NOT NULL")
    best = hits.groupBy("source_id", "heading").agg(F.min_by(F.struct("segment_id", "seq", "pass"), F.struct("pass", -F.col("seq"))).alias("b"))
    return best.select("source_id", "heading", "b.segment_id", "b.seq", "b.pass")


def owned_segments(ownership: DataFrame, segments: DataFrame, sources: DataFrame) -> DataFrame:
    """All segments of the given sources, through ownership."""
    return sources.select("source_id").join(ownership, "source_id").join(segments.drop("source_id"), "segment_id")


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: new rows win over old ones of their key, but columns in ``keep`` stay as first written."""
    a, b = old.withColumn("__old", F.lit(True)), new.withColumn("__new", F.lit(True))
    names = [c for c in old.columns if c not in keys]
    a = a.select(*keys, "__old", *[F.col(c).alias(f"__a_{c}") for c in names])
    b = b.select(*keys, "__new", *[F.col(c).alias(f"__b_{c}") for c in names])

    def pick(c: str) -> Column:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        return (F.coalesce(x, y) if c in keep else F.when(F.col("__new"), y).otherwise(x)).alias(c)

    return a.join(b, keys, "full").select(*keys, *[pick(c) for c in names]).select(*old.columns)


def upsert_segments(segments: DataFrame, ownership: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, ownership): the primary owner is replaced, and every owner is kept."""
    owners = ownership.unionByName(new.select("segment_id", "source_id")).distinct()
    return merged(segments, new, ["segment_id"]), owners


def replaced(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Whole-set replacement: rows of ``old`` whose scope ``new`` has go, and ``new`` comes."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new)


def appended(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert; a key that is there already raises."""
    twice = old.select(*keys).join(new.select(*keys), keys, "left_semi").limit(1).count()
    if twice or new.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"a row with the same {', '.join(keys)} exists")
    return old.unionByName(new)


def with_responses(answers: DataFrame, responses: DataFrame) -> DataFrame:
    """Late response texts (answer_id, response_text, response_recorded_at) attached to their answers."""
    late = responses.select("answer_id", F.col("response_text").alias("__t"), F.col("response_recorded_at").alias("__r"), F.lit(True).alias("__hit"))
    pick = lambda c, x: F.when(F.col("__hit"), F.col(x)).otherwise(F.col(c)).alias(c)
    new = {"response_text": "__t", "response_recorded_at": "__r"}
    return answers.join(late, "answer_id", "left").select(*[pick(c, new[c]) if c in new else F.col(c) for c in answers.columns])


def back_filled_ownership(segments: DataFrame, ownership: DataFrame) -> DataFrame:
    """Ownership with a row for every primary owner that lacks one."""
    primary = segments.where("source_id IS NOT NULL").select("segment_id", "source_id").distinct()
    return ownership.unionByName(primary.join(ownership, ["segment_id", "source_id"], "left_anti"))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (measure, rows): the size of each table."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("measure"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def mention_ledger(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Mentions of the given sources, with their place in (cluster_id, mention_idx) order from 1."""
    w = Window.partitionBy("source_id").orderBy("cluster_id", "mention_idx")
    return mentions.join(sources.select("source_id").distinct(), "source_id", "left_semi").withColumn("place", F.row_number().over(w))


#: What a trace says when a cited segment isn't the source's own text.
DISCLOSURE = "Some cited segments have references resolved. The first segment of each source is its own text, which content_hash covers; the overlay holds every substitution."


def render_traces(answers: DataFrame, explained: DataFrame, disclosure: str = DISCLOSURE) -> DataFrame:
    """Rows (answer_id, coverage, citations, resolution_disclosure), one for each answer.

    citations is an array in cite_order; the disclosure is null unless a citation isn't verbatim.
    A citation isn't verbatim if its source has an overlay and its segment isn't the first.
    """
    verbatim = ~F.coalesce(F.col("has_overlay") & (F.col("seq") > 0), F.lit(False))
    cited = explained.select("answer_id", F.struct("cite_order", "segment_id", "source_label", "evidence_snippet", verbatim.alias("verbatim"), "content_hash").alias("c"))
    lists = cited.groupBy("answer_id").agg(F.sort_array(F.collect_list("c")).alias("citations"))
    known = F.size(F.filter("citations", lambda c: c["source_label"].isNotNull()))
    coverage = F.when(F.coalesce(known, F.lit(0)) <= 0, "none").when(known == F.size("citations"), "full").otherwise("partial")
    disclosed = F.when(F.exists("citations", lambda c: ~c["verbatim"]), F.lit(disclosure))
    none = F.array().cast(lists.schema["citations"].dataType)
    return answers.select("answer_id").join(lists, "answer_id", "left").select("answer_id", coverage.alias("coverage"), F.coalesce("citations", none).alias("citations"), disclosed.alias("resolution_disclosure"))


def recorded_claims(claims: DataFrame, evidence: DataFrame, nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, evidence) after the answers in ``nested`` (answer_id, claims) are verified anew.

    All old claims and evidence of those answers go, of answers with an empty array too. An entry
    of claims has the fields of the claims table, markers as an array, and an array evidence.
    """
    flat = nested.select("answer_id", F.inline("claims"))
    new = flat.select(*[(F.array_join(c, ",") if c == "markers" else F.col(c)).alias(c) for c in claims.columns])
    cited = flat.select("answer_id", "claim_index", F.inline("evidence")).select(*evidence.columns)
    scope = nested.select("answer_id").distinct()
    keep = lambda t: t.join(scope, "answer_id", "left_anti").select(*t.columns)
    return keep(claims).unionByName(new), keep(evidence).unionByName(cited)


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), "(?s)^.(.*).$", 1)


def recorded_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Verification runs after an upsert by answer_id.

    new has thresholds as a map and tiers_offered as an array; they are stored as JSON text with
    sorted keys, a space after each colon and comma. Null maps and arrays are stored as empty.
    """
    entry = lambda e: F.concat(_quoted(e["key"]), F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("null")))
    bounds = F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("thresholds")), entry), ", "), F.lit("")), F.lit("}"))
    tiers = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("tiers_offered", _quoted), ", "), F.lit("")), F.lit("]"))
    return merged(runs, new.withColumn("thresholds", bounds).withColumn("tiers_offered", tiers).select(*runs.columns), ["answer_id"])
