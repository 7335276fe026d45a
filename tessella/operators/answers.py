"""Shapes of answers: filters, facets, levels of detail, search and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import incidence

SIGMAS = ("factual", "temporal", "causal", "episodic", "authorial", "structural")


def sigma_counts(edges: DataFrame, shown: tuple[str, ...] = SIGMAS, quarantined: bool = False) -> DataFrame:
    """Rows (sigma, total, shown, withheld) under a filter by sigma and quarantine."""
    passes = F.col("sigma").isin(*shown) & (F.lit(quarantined) | ~F.col("quarantined"))
    return edges.groupBy("sigma").agg(F.count("*").alias("total"), F.count(F.when(passes, 1)).alias("shown"), F.count(F.when(~passes, 1)).alias("withheld"))


def sigma_mix(edges: DataFrame, node: str) -> DataFrame:
    """Rows (sigma, edges, quarantined) of the edges at a node."""
    return edges.where((F.col("from_id") == node) | (F.col("to_id") == node)).groupBy("sigma").agg(F.count("*").alias("edges"), F.count(F.when(F.col("quarantined"), 1)).alias("quarantined"))


def facet(a: Column, b: Column) -> Column:
    """same, different, or unknown if one is null."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "same").otherwise("different")


def compared(left: DataFrame, right: DataFrame, on: list[str], facets: list[str]) -> DataFrame:
    """Rows (on..., facet, left, right, verdict): two sides compared facet by facet."""
    a = left.select(*on, F.posexplode(F.array(*[F.col(f).cast("string") for f in facets])).alias("k", "left"))
    b = right.select(*on, F.posexplode(F.array(*[F.col(f).cast("string") for f in facets])).alias("k", "right"))
    name = F.element_at(F.array(*[F.lit(f) for f in facets]), F.col("k") + 1)
    return a.join(b, [*on, "k"]).select(*on, name.alias("facet"), "left", "right", facet(F.col("left"), F.col("right")).alias("verdict"))


def lod_states(view: DataFrame, pointers: DataFrame, admitted: DataFrame, cited: DataFrame) -> DataFrame:
    """Rows (id, lod): the view's hint, then pointers, admitted and cited nodes in rising precedence."""
    mark = lambda t, name: t.select("id", F.lit(True).alias(name)).distinct()
    joined = view.select("id", "hint").join(mark(pointers, "p"), "id", "left").join(mark(admitted, "a"), "id", "left").join(mark(cited, "c"), "id", "left")
    return joined.select("id", F.when(F.col("c"), "lod-0").when(F.col("a"), "lod-1").when(F.col("p"), "ghost").otherwise(F.concat(F.lit("lod-"), F.col("hint").cast("string"))).alias("lod"))


#: Levels of detail, the sharpest first.
LODS = ("lod-0", "lod-1", "lod-2", "ghost", "latent")


def derived_lod(view: DataFrame, rung: str, selection: DataFrame, trace: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows (id, lod) of a view's nodes and of all that a receipt or the selection names.

    view: id, kind, hint (a level or null). At rest a node has its hint, and one of the view's
    rung is a label at least. With a receipt (trace: pointers (id, hop), admitted (id, lod),
    cited (id), path (id)) what it doesn't name is an outline; pointers within one hop are
    ghosts, admitted nodes have their level over that, citations are verbatim, nodes on the path
    summaries at least. What is selected (id) is verbatim, whatever else holds.
    """
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in LODS]), c).cast("int") - 1
    base = F.greatest(place(F.coalesce("hint", F.lit("latent"))), F.lit(0))
    floor = F.when(F.col("kind") == rung, F.least(base, F.lit(2))).otherwise(base) if trace is None else F.lit(4)
    named = lambda t, level, value: t.select("id", F.lit(level).alias("level"), value.cast("int").alias("value"))
    rows = named(view.withColumn("v", floor), 0, F.col("v")).unionByName(named(selection, 5, F.lit(0)))
    if trace is not None:
        rows = rows.unionByName(named(trace["pointers"], 1, F.when(F.col("hop") <= 1, 3).otherwise(4)))
        known = place(F.col("lod"))
        rows = rows.unionByName(named(trace["admitted"], 2, F.when(known >= 0, known).otherwise(2)))
        rows = rows.unionByName(named(trace["cited"], 3, F.lit(0))).unionByName(named(trace["path"], 4, F.lit(1)))
    of = lambda level: F.min(F.when(F.col("level") == level, F.col("value")))
    each = rows.groupBy("id").agg(*[of(i).alias(f"l{i}") for i in range(6)])
    told = F.coalesce("l3", "l2", "l1", "l0", F.lit(4))
    rank = F.when(F.col("l5").isNotNull(), 0).when(F.col("l4").isNotNull(), F.least(told, F.lit(1))).otherwise(told)
    return each.select("id", F.element_at(F.array(*[F.lit(x) for x in LODS]), rank + 1).alias("lod"))


def busiest(path: DataFrame, least: int = 2) -> DataFrame:
    """Rows (id, steps): the node that most steps of a path touch, ties by id."""
    ends = path.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("steps")).where(F.col("steps") >= least).orderBy(F.desc("steps"), "id").limit(1)


def forks(path: DataFrame) -> DataFrame:
    """Rows (object, subjects): objects that two subjects or more share."""
    return path.groupBy(F.col("to_id").alias("object")).agg(F.countDistinct("from_id").alias("subjects")).where("subjects >= 2")


def chain_ends(path: DataFrame) -> DataFrame:
    """Rows (id, role): the head and tail of a path whose steps make one chain, none otherwise."""
    out = path.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("o"))
    in_ = path.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("i"))
    both = out.join(in_, "id", "full").select("id", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    ok = both.agg(F.count(F.when((F.col("o") > 1) | (F.col("i") > 1), 1)).alias("bad"), F.count(F.when(F.col("i") == 0, 1)).alias("heads"))
    ends = both.where("o = 0 OR i = 0").crossJoin(F.broadcast(ok.where("bad = 0 AND heads = 1")))  # one row at most
    return ends.select("id", F.when(F.col("i") == 0, "head").otherwise("tail").alias("role"))


def search_index(views: DataFrame) -> DataFrame:
    """Nodes of several views once each (rows id, kind, label, degree, depth), the shallowest of each."""
    return views.groupBy("id").agg(F.min_by(F.struct("kind", "label", "degree", "depth"), "depth").alias("r")).select("id", "r.*")


def outline(nodes: DataFrame, path: DataFrame, cap: int = 200) -> DataFrame:
    """Nodes in answer order first (path: id, step), then by centrality, up to the cap."""
    return nodes.join(path.select("id", "step"), "id", "left").orderBy(F.col("step").asc_nulls_last(), F.desc("centrality"), "id").limit(cap)


def reach(edges: DataFrame, cursor: str) -> DataFrame:
    """Rows (other, edge_id, quarantined): neighbours of a node, by an admitted edge if there is one."""
    near = incidence(edges).where(F.col("id") == cursor)
    return near.groupBy("other").agg(F.min(F.struct("quarantined", "edge_id")).alias("e")).select("other", "e.edge_id", "e.quarantined")


def source_window(text: Column, first: Column, last: Column, around: int = 420) -> Column:
    """The span first..last of a text with its surroundings, '…' where it is cut."""
    a, b = F.greatest(first - around, F.lit(0)), F.least(last + around, F.length(text))
    return F.concat(F.when(a > 0, "…").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "…").otherwise(""))


def lod_histogram(view: DataFrame, lod: DataFrame) -> DataFrame:
    """Rows (lod, nodes) over a view; nodes without a state count as 'hole'."""
    joined = view.select("id").join(lod.select("id", "lod"), "id", "left")
    return joined.groupBy(F.coalesce("lod", F.lit("hole")).alias("lod")).agg(F.count("*").alias("nodes"))


def receipt_groups(families: DataFrame, omitted: DataFrame) -> DataFrame:
    """Rows (group, key, n): families by sigma, and omissions by reason."""
    a = families.groupBy(F.col("sigma").alias("key")).agg(F.sum("edges").alias("n")).select(F.lit("families").alias("group"), "key", "n")
    return a.unionByName(omitted.groupBy(F.col("reason").alias("key")).agg(F.count("*").alias("n")).select(F.lit("omitted").alias("group"), "key", "n"))


def ledger(passages: DataFrame) -> DataFrame:
    """Passages in reading order: by char_start, then seq, then id."""
    return passages.orderBy(F.col("char_start").asc_nulls_last(), "seq", "id")


def chronology(path: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows (place, id, at, days): the nodes of a chain in order, with days since the one before.

    No rows for a path that branches, has several heads or a cycle. path: from_id, to_id;
    dates: id, at. A path is an answer's (at most 24 steps), so its order is found on the driver;
    one of more than 1,024 steps raises ValueError.
    """
    steps = [(r.from_id, r.to_id) for r in path.select("from_id", "to_id").limit(1025).collect()]
    if len(steps) > 1024:
        raise ValueError("an answer's path has at most 1,024 steps")
    following, heads = dict(steps), {a for a, _ in steps} - {b for _, b in steps}
    order = []
    if len(following) == len(steps) == len(dict((b, a) for a, b in steps)) and len(heads) == 1:
        order = [heads.pop()]
        while order[-1] in following:
            order.append(following[order[-1]])
    placed = path.sparkSession.createDataFrame(list(enumerate(order)), "place int, id string")
    w = Window.partitionBy().orderBy("place")
    day = F.to_date(F.substring("at", 1, 10))
    return placed.join(dates.select("id", "at"), "id", "left").select("place", "id", "at", F.datediff(day, F.lag(day).over(w)).alias("days"))


def _halved(before: Column, after: Column, c: Column) -> Column:
    """The half of low..high in which two texts begin to differ, or high if they agree up to it."""
    middle = ((c["low"] + c["high"] + 1) / 2).cast("int")
    size = middle - c["low"]
    same = F.substring(before, c["low"] + 1, size) == F.substring(after, c["low"] + 1, size)
    return F.struct(F.when(same, middle).otherwise(c["low"]).alias("low"), F.when(same, c["high"]).otherwise(middle - 1).alias("high"))


def first_difference(before: Column, after: Column, around: int = 34) -> Column:
    """struct<at, before, after>: the first place where two texts differ, with what surrounds it; null if none."""
    n = F.least(F.length(before), F.length(after))
    # halves of what may still differ: 31 comparisons of prefixes, whatever the length
    step = lambda c, _: F.when(c["low"] >= c["high"], c).otherwise(_halved(before, after, c))
    start = F.struct(F.lit(0).alias("low"), n.cast("int").alias("high"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step)["low"]
    cut = lambda t: F.substring(t, F.greatest(at - around, F.lit(0)) + 1, F.lit(2 * around))
    return F.when(before != after, F.struct(at.alias("at"), cut(before).alias("before"), cut(after).alias("after")))


#: Directions, and the cosine of a cone's half angle of 60 degrees.
DIRECTIONS = {"up": (0, 1), "down": (0, -1), "left": (-1, 0), "right": (1, 0)}
CONE = 0.5000000000000001


def nearest_in_direction(positions: DataFrame, start: str) -> DataFrame:
    """Rows (direction, id, cost): the nearest node in each direction's cone; none for an empty cone.

    The cost is the distance over the squared cosine of the angle off the axis, ties by id.
    """
    at = positions.where(F.col("id") == start).select(F.col("x").alias("__x"), F.col("y").alias("__y")).limit(1)
    dx, dy = F.col("x") - F.col("__x"), F.col("y") - F.col("__y")
    far = positions.where(F.col("id") != start).crossJoin(F.broadcast(at)).select("id", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("d")).where("d > 0")  # one row
    axes = F.explode(F.array(*[F.struct(F.lit(k).alias("direction"), F.lit(a).alias("ax"), F.lit(b).alias("ay")) for k, (a, b) in DIRECTIONS.items()]))
    each = far.select("id", "dx", "dy", "d", axes.alias("a")).withColumn("cos", (F.col("dx") * F.col("a.ax") + F.col("dy") * F.col("a.ay")) / F.col("d"))
    costs = each.where(F.col("cos") > CONE).select("a.direction", F.struct((F.col("d") / (F.col("cos") * F.col("cos"))).alias("cost"), "id").alias("c"))
    return costs.groupBy("direction").agg(F.min("c").alias("c")).select("direction", "c.id", "c.cost")


def inside_frustum(x: Column, y: Column, frame: tuple[float, float, float, float], margin: float = 0.12) -> Column:
    """Whether a point is in the frame (centre x, centre y, width, height), less a margin."""
    cx, cy, w, h = frame
    return (F.abs(x - cx) <= w / 2 * (1 - margin)) & (F.abs(y - cy) <= h / 2 * (1 - margin))


def hop_evidence(path: DataFrame, cited: DataFrame) -> DataFrame:
    """Rows (edge_id, attached, admitted): passages of each step (edge_id, evidence), and citations
    (passage_id) of them."""
    wanted = path.select("edge_id", F.explode(F.array_distinct("evidence")).alias("passage_id"))
    times = cited.groupBy("passage_id").agg(F.count("*").alias("n"))
    got = wanted.join(times, "passage_id").groupBy("edge_id").agg(F.sum("n").alias("admitted"))
    return path.select("edge_id", F.greatest(F.size("evidence"), F.lit(0)).alias("attached")).join(got, "edge_id", "left").select("edge_id", "attached", F.coalesce("admitted", F.lit(0)).alias("admitted"))


def citation_edges(cited: DataFrame, path: DataFrame, bridge: str | None = None) -> DataFrame:
    """Rows (passage_id, from_id): from the subject of each step whose evidence a citation is.

    cited: passage_id, bridged. A bridged citation of no step hangs on the ``bridge``, if given.
    """
    steps = path.select("from_id", F.explode(F.array_distinct("evidence")).alias("passage_id"))
    rows = cited.select("passage_id", "bridged").distinct().join(steps, "passage_id", "left")
    other = F.when(F.col("bridged"), F.lit(bridge).cast("string"))
    return rows.select("passage_id", F.coalesce("from_id", other).alias("from_id")).where("from_id IS NOT NULL")
