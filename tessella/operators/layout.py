"""Positions on a plane: centroids, bounds, spatial lookups and anchored re-bakes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(positions: DataFrame) -> DataFrame:
    """One row: the rectangle of all discs; zeros without any."""
    ends = {"min_x": F.min(F.col("x") - F.col("r")), "max_x": F.max(F.col("x") + F.col("r")), "min_y": F.min(F.col("y") - F.col("r")), "max_y": F.max(F.col("y") + F.col("r"))}
    return positions.agg(*[F.round(F.coalesce(v, F.lit(0.0)), 6).alias(k) for k, v in ends.items()])


def spine_centroids(positions: DataFrame, parent_of: DataFrame) -> DataFrame:
    """Rows (id, x, y): each parent at the centroid of its children; parent_of: id, parent_id."""
    return positions.join(parent_of, "id").groupBy(F.col("parent_id").alias("id")).agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


def pulled(positions: DataFrame, centres: DataFrame, pull: float) -> DataFrame:
    """Positions moved towards their centres (id, cx, cy) by a share of the way."""
    moved = positions.join(centres, "id", "left")
    to = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) * (1 - pull) + F.col(b) * pull).alias(a)
    return moved.select(*[to(c, f"c{c}") if c in ("x", "y") else F.col(c) for c in positions.columns])


def cells(positions: DataFrame, size: float) -> DataFrame:
    """Adds the square cell (cell_x, cell_y) of each centre."""
    return positions.withColumn("cell_x", F.floor(F.col("x") / size)).withColumn("cell_y", F.floor(F.col("y") / size))


def within_radius(positions: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Rows (point, id, distance): centres within ``radius`` of points (point, px, py).

    Both sides meet by cells of the radius's size; a point looks into the nine around it.
    """
    near = F.sequence(F.lit(-1), F.lit(1))
    asked = points.select("*", F.explode(near).alias("dx")).select("*", F.explode(near).alias("dy"))
    asked = asked.withColumn("cell_x", F.floor(F.col("px") / radius) + F.col("dx")).withColumn("cell_y", F.floor(F.col("py") / radius) + F.col("dy"))
    far = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    return cells(positions, radius).join(asked, ["cell_x", "cell_y"]).withColumn("distance", far).where(F.col("distance") <= radius).select("point", "id", "distance")


def within_rect(positions: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return positions.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def picked(positions: DataFrame, x: float, y: float, slop: float = 0.0) -> DataFrame:
    """The smallest disc over a point, then the nearest; no row if none."""
    d2 = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2
    over = positions.where(d2 <= (F.col("r") + slop) ** 2)
    return over.groupBy().agg(F.min_by("id", F.struct("r", d2.alias("d"), "id")).alias("id")).where("id IS NOT NULL")


def levelled(positions: DataFrame, base: float, slop: float = 0.0) -> DataFrame:
    """Rows (level, cell_x, cell_y, id, x, y, r): each disc in the cells that it touches at its level.

    A level's cells are ``base`` times a power of two wide, and a disc's level is the least whose
    cells are as wide as the disc, so that it touches four at most, whatever its size.
    """
    wide = 2 * (F.col("r") + slop)
    level = F.greatest(F.ceil(F.log2(F.greatest(wide, F.lit(base)) / base)), F.lit(0)).cast("int")
    cell = F.col("level").cast("double")
    size = F.lit(float(base)) * F.pow(F.lit(2.0), cell)
    reach = F.col("r") + slop
    touched = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    rows = positions.select("id", "x", "y", "r").withColumn("level", level)
    return rows.withColumn("cell_x", touched("x")).withColumn("cell_y", touched("y"))


def picked_many(positions: DataFrame, points: DataFrame, base: float, slop: float = 0.0) -> DataFrame:
    """Rows (point, id): for each of (point, px, py) the smallest disc over it, then the nearest, then by id.

    A point looks into its one cell of each level there is; so picks are an equality join.
    """
    discs = levelled(positions, base, slop)
    levels = discs.select("level").distinct()  # a few dozen: each doubles the width
    at = points.crossJoin(F.broadcast(levels))
    size = F.lit(float(base)) * F.pow(F.lit(2.0), F.col("level").cast("double"))
    at = at.withColumn("cell_x", F.floor(F.col("px") / size)).withColumn("cell_y", F.floor(F.col("py") / size))
    d2 = (F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2
    over = at.join(discs, ["level", "cell_x", "cell_y"]).where(d2 <= (F.col("r") + slop) ** 2)
    return over.groupBy("point").agg(F.min_by("id", F.struct("r", d2.alias("d"), "id")).alias("id"))


def separation(positions: DataFrame, draws: int = 4, seed: int = 0) -> DataFrame:
    """Rows (stratum, pairs, distance): the mean distance of pairs within and across communities.

    Each node draws ``draws`` partners of its own community and as many of others, by hashes, so
    that reruns agree; a partner is a rank, so pairs meet by equality. A draw weighs as many
    pairs as it stands for: the means are those of all pairs, up to the sample.
    """
    from ..sources.scratch import written
    from .topology import indexed

    ranked = written(indexed(positions.where("community IS NOT NULL").select("community", "id", "x", "y"), "community", "id"), "ranked")
    homes = ranked.groupBy("community").agg(F.min("index").alias("first"), F.count("*").alias("size"))
    n = ranked.count()
    rows = ranked.join(homes, "community").select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = lambda name: F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), F.lit(name), "id", F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    own = F.col("first") + F.pmod(F.col("index") - F.col("first") + 1 + F.pmod(drawn("intra"), F.greatest(F.col("size") - 1, F.lit(1))), F.col("size"))
    other = F.pmod(F.col("first") + F.col("size") + F.pmod(drawn("inter"), F.greatest(F.lit(n) - F.col("size"), F.lit(1))), F.lit(max(n, 1)))
    pairs = rows.where("size > 1").select(F.lit("intra").alias("stratum"), own.alias("partner"), "x", "y", (F.col("size") - 1).alias("w")).unionByName(
        rows.where(F.col("size") < n).select(F.lit("inter").alias("stratum"), other.alias("partner"), "x", "y", (F.lit(n) - F.col("size")).alias("w"))
    )
    met = pairs.join(ranked.select(F.col("index").alias("partner"), F.col("x").alias("u"), F.col("y").alias("v")), "partner")
    far = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)
    return met.groupBy("stratum").agg(F.count("*").alias("pairs"), F.round(F.sum(far * F.col("w")) / F.sum("w"), 6).alias("distance"))


def lod_hint(kind: Column, central: Column, bridge: Column) -> Column:
    """The level of detail by kind; central nodes and bridges are one level up."""
    base = F.when(kind.isin("continent", "island"), 0).when(kind.isin("asset", "entity"), 1).otherwise(2)
    return F.greatest(F.lit(0), base - ((central >= 0.8) | bridge).cast("int"))


def similarity(old: DataFrame, new: DataFrame, weights: DataFrame) -> DataFrame:
    """One row (a, b, tx, ty): the weighted least-squares rotation and scale that takes new to old.

    x' = a x - b y + tx and y' = b x + a y + ty, in closed form from one aggregation.
    """
    both = new.select("id", "x", "y").join(old.select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id").join(weights, "id")
    w = F.col("w")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    cov = lambda p, q: F.sum(w * F.col(p) * F.col(q)) / F.sum(w)
    m = both.agg(*[mean(c).alias(f"m{c}") for c in "xyuv"], *[cov(p, q).alias(f"{p}{q}") for p, q in ("xu", "yv", "xv", "yu", "xx", "yy")])
    spread = F.col("xx") - F.col("mx") ** 2 + F.col("yy") - F.col("my") ** 2
    a = ((F.col("xu") - F.col("mx") * F.col("mu")) + (F.col("yv") - F.col("my") * F.col("mv"))) / spread
    b = ((F.col("xv") - F.col("mx") * F.col("mv")) - (F.col("yu") - F.col("my") * F.col("mu"))) / spread
    solved = m.select("*", a.alias("a"), b.alias("b"))
    return solved.select("a", "b", (F.col("mu") - F.col("a") * F.col("mx") + F.col("b") * F.col("my")).alias("tx"), (F.col("mv") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")).alias("ty"))


def rebaked(new: DataFrame, fit: DataFrame) -> DataFrame:
    """New positions in the old frame; ``fit`` is the one row of ``similarity``."""
    both = new.crossJoin(F.broadcast(fit))
    moved = {"x": F.col("a") * F.col("x") - F.col("b") * F.col("y") + F.col("tx"), "y": F.col("b") * F.col("x") + F.col("a") * F.col("y") + F.col("ty")}
    return both.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in new.columns])


def alignment(old: DataFrame, new: DataFrame, weights: DataFrame, mirror: bool = True) -> DataFrame:
    """One row (rotation, scale, tx, ty, mirror, mean_drift, drift_pct): how new positions lie best on old ones.

    The weighted least squares over nodes that both have, in closed form from one aggregation;
    new positions are mirrored (y to -y) where that leaves less than 0.999 of the error. Drift is
    the mean distance that is left, also as a share of the old rectangle's diagonal. Fewer than
    two common nodes give the identity and no drift.
    """
    both = new.select("id", "x", "y").join(old.select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id").join(weights.select("id", "w"), "id")
    w = F.col("w")
    m = both.agg(F.count("*").alias("k"), F.sum("w").alias("w"), *[F.sum(w * F.col(a)).alias(a) for a in "xyuv"], *[F.sum(w * F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "yy", "uu", "vv", "xu", "yv", "xv", "yu")])
    central = lambda a, b: F.col(a + b) - F.col(a) * F.col(b) / F.col("w")
    q, p = central("x", "x") + central("y", "y"), central("u", "u") + central("v", "v")
    fits = {s: (central("x", "u") + s * central("y", "v"), central("x", "v") - s * central("y", "u")) for s in (1, -1)}
    error = {s: p - F.when(q > 1e-12, (d * d + c * c) / q).otherwise(0.0) for s, (d, c) in fits.items()}
    turned = F.lit(mirror) & (error[-1] < error[1] * 0.999)
    pick = lambda i: F.when(turned, fits[-1][i]).otherwise(fits[1][i])
    known = F.col("k") >= 2
    solved = m.select(
        "k", "w", "x", "y", "u", "v", F.coalesce(known & turned, F.lit(False)).alias("mirror"),
        F.when(known, F.atan2(pick(1), pick(0))).otherwise(0.0).alias("rotation"),
        F.when(known & (q > 1e-12), F.sqrt(pick(0) * pick(0) + pick(1) * pick(1)) / q).otherwise(1.0).alias("scale"),
    )
    sign = F.when(F.col("mirror"), -1.0).otherwise(1.0)
    qx, qy = F.col("x") / F.col("w"), sign * F.col("y") / F.col("w")
    cos, sin = F.cos("rotation"), F.sin("rotation")
    shift = lambda at, turn: F.when(F.col("k") >= 2, F.col(at) / F.col("w") - F.col("scale") * turn).otherwise(0.0)
    fit = solved.select("rotation", "scale", shift("u", cos * qx - sin * qy).alias("tx"), shift("v", sin * qx + cos * qy).alias("ty"), "mirror", "k")
    moved = both.crossJoin(F.broadcast(fit))  # one row
    my = sign * F.col("y")
    dx = F.col("scale") * (cos * F.col("x") - sin * my) + F.col("tx") - F.col("u")
    dy = F.col("scale") * (sin * F.col("x") + cos * my) + F.col("ty") - F.col("v")
    drift = moved.where("k >= 2").agg(F.coalesce(F.avg(F.sqrt(dx * dx + dy * dy)), F.lit(0.0)).alias("mean_drift"))
    ends = old.agg(F.sqrt((F.max(F.col("x") + F.col("r")) - F.min(F.col("x") - F.col("r"))) ** 2 + (F.max(F.col("y") + F.col("r")) - F.min(F.col("y") - F.col("r"))) ** 2).alias("diagonal"))
    share = F.when(F.col("diagonal") >= 1e-9, F.col("mean_drift") / F.col("diagonal") * 100).otherwise(0.0)
    return fit.drop("k").crossJoin(F.broadcast(drift)).crossJoin(F.broadcast(ends)).select("rotation", "scale", "tx", "ty", "mirror", "mean_drift", share.alias("drift_pct"))  # one row each


def community_spread(positions: DataFrame) -> DataFrame:
    """Rows (community, n, x, y, spread): centroid and root-mean-square distance from it."""
    return positions.groupBy("community").agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.round(F.sqrt(F.var_pop("x") + F.var_pop("y")), 6).alias("spread")
    )


def content_hash(lines: DataFrame, column: str = "line") -> DataFrame:
    """One row: a hash of all lines whatever their order, for telling states apart.

    The hash is additive: the four 64-bit words of the lines' SHA-256 are summed, which every
    task does for its own lines, and the sums and the number of lines are hashed.
    """
    h = F.sha2(F.col(column), 256)
    words = [F.sum(F.conv(F.substring(h, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    sums = lines.agg(F.concat_ws(",", F.count(column).cast("string"), *[F.coalesce(w, F.lit(0)).cast("string") for w in words]).alias("s"))
    return sums.select(F.substring(F.sha2("s", 256), 1, 16).alias("bake_id"))


def purity(positions: DataFrame, radius: float) -> DataFrame:
    """One row: the share of neighbours within ``radius`` that are of a node's own community."""
    points = positions.select(F.col("id").alias("point"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = within_radius(positions, points, radius).where("point <> id")
    own = positions.select(F.col("id").alias("point"), F.col("community").alias("a"))
    other = positions.select("id", F.col("community").alias("b"))
    return near.join(own, "point").join(other, "id").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("purity"))


def fitted(positions: DataFrame, extent: float = 1000.0, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Positions scaled so that the middle 99 % span the extent, by exact percentiles, one scale for both axes."""
    q = positions.agg(*[F.expr(f"percentile({c}, {p})").alias(f"{c}{i}") for c in "xy" for i, p in enumerate((low, high))])
    both = positions.crossJoin(F.broadcast(q))  # one row
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    at = lambda c: ((F.col(c) - (F.col(f"{c}0") + F.col(f"{c}1")) / 2) / span * extent).alias(c)
    return both.select(*[at(c) if c in ("x", "y") else F.col(c) for c in positions.columns])


def snapped(positions: DataFrame, spacing: float) -> DataFrame:
    """Adds the nearest point (gx, gy) of a hexagonal grid: odd rows are half a step to the right."""
    height = spacing * 3**0.5 / 2
    row = F.round(F.col("y") / height)
    shift = F.pmod(row, F.lit(2)) * spacing / 2
    return positions.withColumn("gx", F.round((F.col("x") - shift) / spacing) * spacing + shift).withColumn("gy", row * height)


def principal_axes(features: DataFrame, dims: int) -> DataFrame:
    """Rows (id, px, py): the first two principal components of vectors ``v`` of ``dims`` numbers.

    Each task sums its rows and their products in one matrix product; only a ``dims`` by ``dims``
    matrix reaches the driver. A component's largest loading is positive. Vectors that are null
    or of another length take no part.
    """
    import numpy as np
    import pandas as pd

    def sums(batches):
        total = np.zeros(1 + dims + dims * dims)
        for b in batches:
            if len(b):
                v = np.array(b["v"].tolist(), np.float64).reshape(len(b), dims)
                total += np.concatenate([[len(b)], v.sum(axis=0), (v.T @ v).ravel()])
        yield pd.DataFrame({"x": [total]})

    features = features.where(F.size("v") == dims)
    parts = features.select("v").mapInPandas(sums, "x array<double>").select(F.posexplode("x").alias("at", "x"))
    total = np.zeros(1 + dims + dims * dims)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[r["at"]] = r["x"]
    n = total[0] or 1
    mean = total[1 : dims + 1] / n
    cov = total[dims + 1 :].reshape(dims, dims) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    project = lambda k: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in axes[:, k]]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x) - float(mean @ axes[:, k])
    return features.select("id", project(0).alias("px"), project(1).alias("py"))


def radii(nodes: DataFrame, extent: float = 1000.0) -> DataFrame:
    """Adds r: by kind, growing with the square root of the content (column content)."""
    base = F.when(F.col("kind") == "continent", 0.06).when(F.col("kind") == "island", 0.03).when(F.col("kind") == "asset", 0.008).otherwise(0.003)
    return nodes.withColumn("r", base * extent * (1 + F.least(F.sqrt(F.coalesce("content", F.lit(0))) / 10, F.lit(1.0))))
