"""Mixing sources to target weights with fixed-length blocks, in DataFrame operations only.

1.  A source's texts are packed, chunk after chunk, into a stream of tokens that is cut into
    blocks of ``block`` tokens. A chunk is a hashed part of a source, so that positions come
    from many small windows and a source of any size is spread.
2.  Targets share the total by weight, capped at ``most`` times a source's own size.
3.  Slots of the output are dealt shard by shard: each slot draws a source from the target
    shares, so that a shard's counts are multinomial. Draws beyond a source's quota go, and
    what they leave short is dealt in closing shards.
4.  A source's slots are numbered through; slot i takes block permute(i mod blocks) in pass
    i div blocks. The permutation is a keyed swap-or-not shuffle, so that the blocks of a pass
    differ. Blocks are joined by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: A word: fixed pattern of what counts as a token here.
WORD = r"[^\x20\x09-\x0D]+"
#: Slots of an output shard.
SHARD = 4096
#: Rows of a source that share a chunk, about.
CHUNK = 2_000
_ROUNDS = 12


def _ranked(table: DataFrame, column: str) -> DataFrame:
    """Adds ``place``: the row's number from 0 by ``column`` (code points, null last).

    Rows are range-sorted; the number within a partition and the sizes of those before give the
    rank, so that no window holds all rows.
    """
    ordered = written(
        table.orderBy(F.col(column).asc_nulls_last()).select("*", F.monotonically_increasing_id().alias("__row")), "ranked"
    )
    part = F.shiftright("__row", 33)
    sizes = ordered.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row for each partition
    before, offset = {}, 0
    for r in sizes:
        before[r["p"]] = offset
        offset += r["count"]
    if not before:
        return ordered.select("*", F.lit(0).cast("long").alias("place")).drop("__row")
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    return ordered.select("*", (F.element_at(start, part) + F.expr("__row & 8589934591")).cast("long").alias("place")).drop("__row")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Rows (place, source, size, n, target) from rows (source, size, n).

    Weights repeat over sources by code point, null last. A source whose share of the total
    passes ``most`` times its size keeps that much; the excess is reshared by weight.
    """
    table = _ranked(sizes, "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(table.select("*", pick.alias("weight")), "sources")
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    level = None
    while True:  # each round caps another source or ends
        capped = F.lit(False) if level is None else (F.col("size") * most < F.col("weight") * level)
        r = table.agg(
            F.sum(F.when(capped, F.col("size") * most).otherwise(0.0)).alias("full"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if not r["open"] or not total:
            level = level or 0.0
            break
        now = (total - r["full"]) / r["open"]
        if level is not None and now <= level * (1 + 1e-12):
            break
        level = now
    target = F.when(F.col("size") * most < F.col("weight") * level, F.col("size") * most).otherwise(F.col("weight") * level)
    return table.select("place", "source", "size", "n", target.cast("double").alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = _ROUNDS) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0..n-1 that ``key`` chooses."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(x, other), F.lit(1)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, step)


def slot_counts(sources: DataFrame, seed: int) -> DataFrame:
    """Rows (shard, place, n, first): slots of a source in a shard, and those in shards before."""
    spark = sources.sparkSession
    facts = sources.agg(F.sum("quota").alias("slots"), F.count("*").alias("m"), F.max("place").alias("last")).first()
    slots, m = facts["slots"] or 0, facts["m"]
    before = _prefix(sources.where("quota > 0").select("place", "quota"), "place", "quota")
    # the share of each source as an interval of [0, 1), cut at a grid of m cells so that slots find theirs by cell
    grid = before.select("place", (F.col("start") / slots).alias("lo"), ((F.col("start") + F.col("quota")) / slots).alias("hi")) if slots else before.select("place", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    cells = grid.select("place", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * m), F.least(F.floor(F.col("hi") * m), F.lit(m - 1)))).alias("cell")) if m else grid.select("place", "lo", "hi", F.lit(0).cast("long").alias("cell"))
    draw = F.expr("(xxhash64(id, %d) & 9007199254740991) / 9007199254740992D" % seed)
    drawn = (
        spark.range(slots)
        .select(F.floor(F.col("id") / SHARD).alias("shard"), draw.alias("u"))
        .select("shard", "u", F.floor(F.col("u") * m).alias("cell"))
        .join(cells, "cell")
        .where("u >= lo AND u < hi")
        .groupBy("place", "shard")
        .agg(F.count("*").alias("n"))
    )
    dealt = (
        _prefix(drawn, "shard", "n", "place")
        .join(sources.select("place", "quota"), "place")
        .select("place", "shard", "quota", "n", F.col("start").alias("first"))
        .select("place", "shard", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("first"))).alias("n"), "first")
        .where("n > 0")
    )
    dealt = written(dealt, "dealt")
    short = (
        sources.join(dealt.groupBy("place").agg(F.sum("n").alias("got")), "place", "left")
        .select("place", F.coalesce("got", F.lit(0)).alias("first"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("n"))
        .where("n > 0")
        .select("place", (F.lit(slots // SHARD + 1) + F.floor(F.col("place") % (m or 1) / 64)).alias("shard"), "n", "first")
    )
    return dealt.unionByName(short)


def _prefix(table: DataFrame, order: str, amount: str, *by: str) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over rows before, of equal ``by``, in two steps by thousands of places.

    A task sums a thousand places, or one sum for each thousand; so a source of very many shards
    or chunks is no task's alone.
    """
    thousand = F.floor(F.col(order) / 1000)
    inner = Window.partitionBy(*by, "__t").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by, "__m").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy(*by, thousand.alias("__t")).agg(F.sum(amount).alias("__s")).withColumn("__m", F.lit(0))
    offsets = sums.select(*by, "__t", F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__o"))
    return (
        table.withColumn("__t", thousand)
        .withColumn("__i", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(offsets, [*by, "__t"])
        .withColumn("start", F.col("__o") + F.col("__i"))
        .drop("__t", "__o", "__i")
    )


def mix(
    docs: DataFrame,
    block: int = 64,
    weights: tuple[float, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): how much of each row the mix takes, and which of its words in which slot.

    rows: doc_id, key, source, size, source_size, target, taken, one for each row of ``docs``;
    key tells rows apart that share an id but not a text. pieces: doc_id, key, place (of the
    source), shard, slot (number among the source's), at (first word taken), words.

    Defined cases: a null or empty text has size 0 and is never taken; null sources are one
    source, ordered last; rows with equal id and text are packed one after the other, and take
    each their own words; an empty table gives empty tables; other columns are left unread.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.col(id_col).cast("long"), text).alias("key"),
        ),
        "sized",
    )
    whole = targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, most)
    blocks = F.greatest(F.ceil(F.col("size") / block), F.lit(1))
    quota = F.when(F.col("size") > 0, F.least(F.round(F.col("target") * blocks / F.col("size")), most * blocks)).otherwise(0)
    sources = written(
        whole.select("*", blocks.cast("long").alias("blocks"), quota.cast("long").alias("quota")), "targets"
    )
    named = sources.select(F.col("source").alias("__source"), "place", F.col("size").alias("source_size"), "target", "n")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    chunked = placed.where("size > 0").select("*", F.pmod(F.xxhash64("key", F.lit(3)), F.ceil(F.col("n") / CHUNK)).alias("chunk"))
    offsets = chunked.groupBy("place", "chunk").agg(F.sum("size").alias("words"))
    offsets = _prefix(offsets, "chunk", "words", "place").select("place", "chunk", F.col("start").alias("offset"))
    inner = Window.partitionBy("place", "chunk").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    packed = written(
        chunked.select("*", F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("within"))
        .join(offsets, ["place", "chunk"])
        .select("doc_id", "key", "source", "place", "size", "source_size", "target", (F.col("offset") + F.col("within")).alias("start")),
        "packed",
    )
    slots = (
        slot_counts(sources, seed)
        .join(sources.select("place", "blocks"), "place")
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "shard")  # few rows that become many
        .select("place", "shard", "blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
        .select(
            "place",
            "shard",
            "slot",
            F.expr("slot div blocks").alias("pass"),
            permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "place", F.expr("slot div blocks"))).alias("index"),
        )
    )
    held = packed.select(
        "doc_id", "key", "place", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("index")
    ).select(
        "doc_id",
        "key",
        "place",
        "start",
        "index",
        F.greatest(F.lit(0), F.col("index") * block - F.col("start")).alias("at"),
        (F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block) - F.greatest("start", F.col("index") * block)).alias("words"),
    )
    # a table with exploded rows counts as large as before them, and would be broadcast by that
    held, slots = held.hint("merge"), slots.hint("merge")
    pieces = held.join(slots, ["place", "index"])
    times = slots.groupBy("place", "index").agg(F.count("*").alias("times"))
    taken = held.join(times, ["place", "index"]).groupBy("place", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = (
        packed.join(taken, ["place", "start"], "left")
        .select("doc_id", "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
        .unionByName(placed.where("size = 0").select("doc_id", "key", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    )
    return rows, pieces.select("doc_id", "key", "start", "place", "shard", "slot", "pass", "index", "at", "words")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: for each pass over its source, a row with the words taken of it.

    A text taken whole stays as it is; of another the words taken are joined by one space. Rows
    that aren't taken go. Columns stay; ``length_col`` is counted again. Options are ``mix``'s.
    """
    _, pieces = mix(docs, id_col=id_col, text_col=text_col, **options)
    taken = pieces.groupBy("key", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("ranges"))
    taken = taken.groupBy("key", "start").agg(F.collect_list("ranges").alias("passes"))
    copy = lambda *order: F.row_number().over(Window.partitionBy("key").orderBy(*order)).alias("copy")
    taken = taken.select("key", "passes", copy("start"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row.alias("row"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"))
    rows = rows.select("row", "key", copy(F.xxhash64("row")))
    both = rows.join(taken, ["key", "copy"]).select("row", F.explode("passes").alias("ranges"))
    both = both.select("row", "ranges", F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(WORD), F.lit(0)).alias("words"))
    size = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["words"])
    part = F.flatten(F.transform("ranges", lambda r: F.slice("words", (r["at"] + 1).cast("int"), r["words"].cast("int"))))
    made = both.select("row", F.when(size == F.size("words"), F.col(f"row.`{text_col}`")).otherwise(F.array_join(part, " ")).alias("made"))
    changed = {text_col: F.col("made"), length_col: F.length("made").cast("long")}
    return made.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
