"""The driver's tables seen as a provenance store and as a graph, and the same views as SQL.

Each view is a DataFrame function here and a common table expression in ``CTES``, built by the
same rules, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

IMPORTED = "2024-01-01T00:00:00+00:00"


class World:
    """Views over the tables in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._lines: DataFrame | None = None
        self._texts: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- provenance ---------------------------------------------------------------------------

    def sources(self) -> DataFrame:
        return self.table("documents").select(
            F.concat(F.lit("doc:"), "doc_id").alias("source_id"),
            F.col("source").alias("source_label"),
            F.lit("").alias("source_uri"),
            F.col("lang").alias("source_type"),
            F.lit(IMPORTED).alias("imported_at"),
            F.sha2("text", 256).alias("content_hash"),
            F.octet_length("text").cast("long").alias("byte_size"),
        )

    def segments(self) -> DataFrame:
        parts = F.concat(F.array("text"), F.split("text", "\n"))
        rows = self.table("documents").select("doc_id", F.posexplode(parts).alias("seq", "text"))
        return rows.select(F.concat_ws(":", F.lit("seg"), "doc_id", "seq").alias("segment_id"), F.concat(F.lit("doc:"), "doc_id").alias("source_id"), "seq", "text")

    def ownership(self) -> DataFrame:
        """The primary owners; and of whole texts that documents share, each of those."""
        whole = self.table("documents").select("doc_id", F.md5("text").alias("h"))
        first = whole.groupBy("h").agg(F.min("doc_id").alias("first"))
        shared = whole.join(first, "h").where("doc_id <> first").select(F.concat(F.lit("seg:"), "first", F.lit(":0")).alias("segment_id"), F.concat(F.lit("doc:"), "doc_id").alias("source_id"))
        return self.segments().select("segment_id", "source_id").unionByName(shared)

    def overlay(self) -> DataFrame:
        return self.table("documents").where("doc_id % 5 = 0").select(F.concat(F.lit("doc:"), "doc_id").alias("source_id"), F.lit("{}").alias("resolution_map"), F.lit(IMPORTED).alias("created_at"))

    def answers(self) -> DataFrame:
        strategy = F.expr("CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' ELSE event_type END")
        return self.table("events").select(
            F.concat(F.lit("ans:"), "event_id").alias("answer_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("answered_at"), F.col("user_id").cast("string").alias("user_id"), strategy.alias("render_strategy")
        )

    def citations(self) -> DataFrame:
        n = self.table("documents").agg(F.count("*").alias("n"))  # one row
        events = self.table("events").where("event_id % 50 <> 7").select("event_id").crossJoin(F.broadcast(n))
        one = events.select("event_id", F.expr("event_id % (n * 11 div 10)").alias("doc_id"), F.lit(1).alias("cite_order"), F.expr("CAST(event_id % 4 = 1 AS INT)").alias("seq"))
        two = events.where("event_id % 3 = 0").select("event_id", F.expr("(event_id * 7) % n").alias("doc_id"), F.lit(2).alias("cite_order"), F.lit(0).alias("seq"))
        rows = one.unionByName(two).join(self.table("documents").select("doc_id", F.substring("text", 1, 60).alias("head")), "doc_id", "left")
        snippet = F.expr(
            "CASE WHEN head IS NULL THEN '' WHEN event_id % 11 = 0 THEN 'not in the text' WHEN event_id % 13 = 0 THEN replace(head, ' ', '  ') ELSE head END"
        )
        return rows.select(F.concat(F.lit("ans:"), "event_id").alias("answer_id"), F.concat_ws(":", F.lit("seg"), "doc_id", "seq").alias("segment_id"), "cite_order", snippet.alias("evidence_snippet"))

    def claims(self) -> DataFrame:
        verdict = F.expr("CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END")
        return self.table("labels").select(F.concat(F.lit("ans:"), F.expr("doc_id * 13")).alias("answer_id"), F.lit(0).alias("claim_index"), verdict.alias("verdict"), F.expr("(1 + quality) / 2D").alias("confidence"))

    def evidence(self) -> DataFrame:
        rows = self.table("labels").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
        return rows.select(F.concat(F.lit("ans:"), F.expr("doc_id * 13")).alias("answer_id"), F.lit(0).alias("claim_index"), "rank", F.concat_ws(":", F.lit("seg"), "doc_id", F.expr("rank - 1")).alias("segment_id"), F.expr("1D / rank").alias("score"), F.lit("candidate").alias("role"))

    # -- graph --------------------------------------------------------------------------------

    def settled(self) -> World:
        """This world with its lines written: for queries that read edges or passages more than once."""
        from pyspark.sql import Window

        if self._lines is None:
            # one shuffle by order serves the groups and the numbers
            grain = self._grain(self.table("lineitem").repartition("l_orderkey"))
            seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("n", "l_partkey", "l_suppkey")) - 1
            self._lines = written(grain.withColumn("seq", seq), "lines")
        return self

    def _grain(self, lineitem: DataFrame) -> DataFrame:
        return lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(
            F.max("l_discount").alias("d"), F.sum("l_quantity").alias("q"), F.min("l_linenumber").alias("n"), F.max("l_returnflag").alias("f"), F.min("l_shipdate").alias("at")
        )

    def edges(self) -> DataFrame:
        """supplies edges, one for each (order, part, supplier)."""
        return self._edges(self._lines if self._lines is not None else self._grain(self.table("lineitem")))

    def _edges(self, grain: DataFrame, *carry: Column | str) -> DataFrame:
        pct = F.expr("CAST(round(d * 100) AS INT)")
        reason = F.expr(f"CASE WHEN {'CAST(round(d * 100) AS INT)'} > 9 THEN 'confidence_below_floor' WHEN f = 'R' AND n = 7 THEN 'duplicate_assertion_divergent_object' END")
        return grain.select(
            F.concat(F.lit("x:"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")).alias("id"),
            F.concat(F.lit("s:"), "l_suppkey").alias("from_id"),
            F.concat(F.lit("p:"), "l_partkey").alias("to_id"),
            F.concat(F.lit("o:"), "l_orderkey").alias("asset_id"),
            F.lit("supplies").alias("family"),
            F.expr("CASE f WHEN 'A' THEN 'factual' WHEN 'N' THEN 'temporal' ELSE 'episodic' END").alias("sigma"),
            F.expr("least(greatest(CAST(q AS DOUBLE) / 50, 0), 1)").alias("weight"),
            ((100 - 5 * pct) / F.lit(100.0)).alias("confidence"),
            F.array(F.concat(F.lit("l:"), "l_orderkey")).alias("evidence"),
            reason.isNotNull().alias("quarantined"),
            reason.alias("reason"),
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
            *carry,
        )

    def assets(self) -> DataFrame:
        home = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n:"), "c_nationkey").alias("parent_id"))
        return self.table("orders").join(home, "o_custkey").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), "parent_id", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.expr("CAST(o_totalprice AS DOUBLE)").alias("price"))

    def nodes(self) -> DataFrame:
        part = lambda t, kind, id_, parent, label: t.select(F.expr(id_).alias("id"), F.lit(kind).alias("kind"), F.expr(parent).alias("parent_id"), F.expr(label).alias("label"))
        rows = [
            part(self.table("region"), "continent", "concat('r:', r_regionkey)", "CAST(NULL AS STRING)", "r_name"),
            part(self.table("nation"), "island", "concat('n:', n_nationkey)", "concat('r:', n_regionkey)", "n_name"),
            part(self.assets(), "asset", "id", "parent_id", "id"),
            part(self.table("customer"), "entity", "concat('c:', c_custkey)", "concat('n:', c_nationkey)", "c_name"),
            part(self.table("supplier"), "entity", "concat('s:', s_suppkey)", "concat('n:', s_nationkey)", "s_name"),
            part(self.table("part"), "entity", "concat('p:', p_partkey)", "CAST(NULL AS STRING)", "p_name"),
        ]
        return reduce(DataFrame.unionByName, rows)

    def region_of(self, rung: str = "island") -> DataFrame:
        """Rows (id, region) of suppliers, and of parts: the region that a part's number falls into."""
        nations = self.table("nation").select("n_nationkey", F.concat(F.lit("n:"), "n_nationkey").alias("island"), F.concat(F.lit("r:"), "n_regionkey").alias("continent"))
        s = self.table("supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("n_nationkey"))
        p = self.table("part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.expr("CAST(p_partkey % 25 AS INT)").alias("n_nationkey"))
        return s.unionByName(p).join(nations, "n_nationkey").select("id", F.col(rung).alias("region"))

    def passages(self) -> DataFrame:
        rows = self._lines
        if rows is None:
            from pyspark.sql import Window

            grain = self.table("lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
            seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("n", "l_partkey", "l_suppkey")) - 1
            rows = grain.select("*", seq.alias("seq"))
        return rows.select(F.concat(F.lit("l:"), F.concat_ws(".", "l_orderkey", "seq")).alias("id"), F.concat(F.lit("o:"), "l_orderkey").alias("parent_id"), "seq", F.concat(F.lit("p:"), "l_partkey").alias("part"), F.concat(F.lit("s:"), "l_suppkey").alias("supplier"))

    def relations(self) -> DataFrame:
        """Relations with vectors, as unit doubles, and their registers and frequencies."""
        v = F.transform("embedding", lambda x: x.cast("double"))
        return self.table("embeddings").select(F.concat(F.lit("rel:"), "vec_id").alias("relation"), v.alias("v"), "label", "vec_id")

    def triples(self) -> DataFrame:
        rows = self.table("embeddings").select("vec_id", F.explode(F.expr("sequence(0, CAST(vec_id % 4 AS INT))")).alias("k"))
        return rows.select(F.expr("concat('reg', (vec_id + k) % 6)").alias("register"), F.lit("h").alias("head"), F.expr("concat(' Rel:', vec_id, ' ')").alias("relation"), F.lit("t").alias("tail"))

    def families(self) -> DataFrame:
        """The relation of smallest id of each label stands for a family."""
        return self.relations().groupBy("label").agg(F.min_by(F.struct("v", "vec_id"), "vec_id").alias("x")).select(F.concat(F.lit("fam:"), "label").alias("family"), F.col("label").alias("place"), "x.v", F.col("x.vec_id").alias("vec_id"))

    def positions(self) -> DataFrame:
        """A disc for each part: two components of arithmetic on its number, a radius by its size."""
        return self.table("part").select(
            F.concat(F.lit("p:"), "p_partkey").alias("id"),
            F.expr("CAST((p_partkey * 37) % 1000 AS DOUBLE)").alias("x"),
            F.expr("CAST((p_partkey * 91) % 1000 AS DOUBLE)").alias("y"),
            F.expr("p_size / 5D").alias("r"),
            F.expr("concat('n:', p_partkey % 25)").alias("community"),
        )

    def trade_edges(self) -> DataFrame:
        """supplies edges, and bought edges from the parts of an order to its customer."""
        lines = self.table("lineitem") if self._lines is None else self._lines
        bought = lines.select("l_orderkey", "l_partkey").distinct().join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        bought = bought.select(
            F.concat(F.lit("b:"), F.concat_ws("-", "l_orderkey", "l_partkey")).alias("id"),
            F.concat(F.lit("p:"), "l_partkey").alias("from_id"),
            F.concat(F.lit("c:"), "o_custkey").alias("to_id"),
            F.lit("bought").alias("family"),
            F.expr("(100 - (l_orderkey * 7 + l_partkey) % 60) / 100.0D").alias("confidence"),
            F.expr("CASE WHEN l_orderkey % 4 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(concat('l:', l_orderkey)) END").alias("evidence"),
            F.expr("l_orderkey % 9 = 0").alias("quarantined"),
        )
        return self.edges().select(*bought.columns).unionByName(bought)

    def answer_paths(self) -> DataFrame:
        """A path for each order: from the supplier of its first line to the customer, or part of that.

        Every fifth order lists its steps backwards, every fifth has those of its first two
        lines' suppliers instead, and every fifth ends at the part.
        """
        orders = self.table("orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("parent_id"), F.col("o_orderkey").alias("k"), F.concat(F.lit("c:"), "o_custkey").alias("customer"))
        rows = self.passages().where("seq <= 1").join(orders, "parent_id")
        supply = F.struct(F.col("seq").alias("step"), F.expr("concat('x:', k, '-', substring(part, 3), '-', substring(supplier, 3))").alias("edge_id"), F.col("supplier").alias("from_id"), F.col("part").alias("to_id"))
        buy = F.struct(F.expr("CASE WHEN k % 5 = 2 THEN -1 ELSE 1 END").alias("step"), F.expr("concat('b:', k, '-', substring(part, 3))").alias("edge_id"), F.col("part").alias("from_id"), F.col("customer").alias("to_id"))
        steps = F.when(F.expr("k % 5 = 3"), F.array(supply)).when(F.expr("seq > 0"), F.array().cast("array<struct<step:int,edge_id:string,from_id:string,to_id:string>>")).when(F.expr("k % 5 = 4"), F.array(supply)).otherwise(F.array(supply, buy))
        return rows.select(F.col("parent_id").alias("path_id"), F.inline(steps))

    def layout_nodes(self) -> DataFrame:
        """Nodes of all kinds with their place among siblings; only islands have a community of their own.

        Passages are held by orders, orders and entities by islands, sources and parts by nothing.
        """
        n = self.nodes().select("id", "kind", "parent_id", F.when(F.col("kind") == "island", F.col("id")).alias("community"), F.expr("CASE WHEN kind IN ('asset', 'entity') THEN CAST(substring(id, 3) AS INT) ELSE 0 END").alias("place"))
        p = self.passages().select("id", F.lit("passage").alias("kind"), "parent_id", F.lit(None).cast("string").alias("community"), F.col("seq").alias("place"))
        s = self.assets().select(F.expr("concat('src:', substring(id, 3))").alias("id"), F.lit("source").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("community"), F.lit(0).alias("place"))
        return n.unionByName(p).unionByName(s).withColumn("centrality", F.expr("CASE WHEN place % 10 = 9 THEN 1.5D ELSE place % 10 / 10D END"))

    def layout_links(self) -> tuple[DataFrame, DataFrame]:
        """(mentions, attachments): passages of parts and suppliers; orders of suppliers and of their own sources."""
        p = self.passages()
        mentions = p.select(F.explode(F.array("part", "supplier")).alias("id"), F.col("id").alias("passage_id"))
        held = p.select(F.col("supplier").alias("id"), F.col("parent_id").alias("asset_id")).distinct()
        if self._lines is not None:  # by number, before ids are texts
            own = self._lines.select("l_suppkey", "l_orderkey").distinct()
            held = own.select(F.concat(F.lit("s:"), "l_suppkey").alias("id"), F.concat(F.lit("o:"), "l_orderkey").alias("asset_id"))
        return mentions, held.unionByName(self.assets().select(F.expr("concat('src:', substring(id, 3))").alias("id"), F.col("id").alias("asset_id")))

    # -- questions ------------------------------------------------------------------------------

    def asked(self) -> DataFrame:
        """A question (question, text) for each order: about the part of its first line, or its
        customer, or nothing that there is."""
        first = self.line_texts().where("seq = 0").join(self.table("part").select(F.concat(F.lit("p:"), "p_partkey").alias("part"), "p_name"), "part")
        who = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o:"), "o_orderkey").alias("parent_id"), "c_name")
        text = "CASE WHEN k % 13 = 0 THEN 'Why, though?' WHEN k % 17 = 0 THEN concat('What did ', c_name, ' buy?') ELSE concat('Which supplier delivers the ', p_name, '?') END"
        return first.join(who, "parent_id").select(F.col("parent_id").alias("question"), F.expr(text).alias("text"))

    def rendering(self) -> dict[str, DataFrame]:
        """entities, edges, passages, facts and assets that questions are answered from."""
        lines, edges = self.line_texts(), self.edges()
        degree = edges.where("NOT quarantined").select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        top = degree.agg(F.max("d").alias("top"))
        central = self.nodes().where("kind = 'entity'").select("id", "label").join(degree, "id", "left").crossJoin(F.broadcast(top))  # one row
        central = central.select("id", "label", F.round(F.coalesce("d", F.lit(0)) / F.col("top"), 6).alias("centrality"))
        said = lines.select(F.explode(F.array("part", "supplier")).alias("id"), "parent_id").groupBy("id").agg(F.count("*").alias("mentions"), F.countDistinct("parent_id").alias("assets"))
        passages = lines.select("id", F.col("v").alias("text"), F.expr("concat('src:', k)").alias("source_id"), F.col("parent_id").alias("asset_id"), F.expr("seq % 5 <> 4").alias("verbatim"))
        own = lines.select(F.expr("concat('x:', k, '-', substring(part, 3), '-', substring(supplier, 3))").alias("id"), F.array("id").alias("passage"))
        if self._lines is None:
            held = edges.drop("evidence").join(own, "id").withColumnRenamed("passage", "evidence")
        else:  # an edge and its passage are of one line
            held = self._edges(self._told(), F.array("id").alias("passage")).drop("evidence").withColumnRenamed("passage", "evidence")
        return {
            "entities": central,
            "edges": held,
            "passages": passages,
            "facts": central.join(said, "id").select("id", "centrality", "mentions", "assets"),
            "assets": self.assets().select("id", F.col("parent_id").alias("island")),
        }

    # -- units that travel ----------------------------------------------------------------------

    def shelf(self, where: str) -> dict[str, DataFrame]:
        """A store of the passages for which ``where`` (SQL over p, s and k, their numbers) holds.

        Every part and supplier that they mention is a node, but for those of a number that leaves
        5 modulo 97; its edges and evidence are theirs too.
        """
        rows = self.passages().select("*", F.expr("CAST(substring(part, 3) AS LONG)").alias("p"), F.expr("CAST(substring(supplier, 3) AS LONG)").alias("s"), F.expr("CAST(substring(parent_id, 3) AS LONG)").alias("k")).where(where)
        mentions = rows.select(F.explode(F.array("part", "supplier")).alias("id"), F.col("id").alias("passage_id"), F.col("parent_id").alias("asset_id"))
        known = self.nodes().where("kind = 'entity' AND CAST(substring(id, 3) AS LONG) % 97 <> 5").join(mentions.select("id").distinct(), "id", "left_semi")
        provenance = rows.select(F.col("supplier").alias("from_id"), F.col("part").alias("to_id"), F.lit("supplies").alias("relation"), F.col("id").alias("passage_id"), F.expr("(k % 10) / 10D").alias("confidence"))
        return {
            "nodes": known.select("id", F.lit("entity").alias("category"), "label", F.concat(F.lit("about "), "label").alias("body")),
            "edges": provenance.select("from_id", "to_id", "relation").distinct(),
            "mentions": mentions,
            "provenance": provenance,
        }

    def destination(self) -> dict[str, DataFrame]:
        """A store of every seventh order's passages, which has every third node as a stub."""
        store = self.shelf("k % 7 = 1")
        third = F.expr("CAST(substring(id, 3) AS LONG) % 3 = 0")
        nodes = store["nodes"].select("id", F.when(third, "extraction_stub").otherwise("own").alias("category"), "label", F.when(third, "").otherwise("known here").alias("body"))
        return {**store, "nodes": nodes}

    # -- a world with faults --------------------------------------------------------------------

    def line_texts(self) -> DataFrame:
        """Passages with the number of their order and a sentence of their own."""
        if self._lines is not None:
            return self._told().select("id", "parent_id", "seq", "part", "supplier", "k", "v")
        s = self.table("supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("supplier"), "s_name")
        p = self.table("part").select(F.concat(F.lit("p:"), "p_partkey").alias("part"), "p_name")
        rows = self.passages().join(s, "supplier").join(p, "part")
        return rows.select("id", "parent_id", "seq", "part", "supplier", F.expr("CAST(substring(parent_id, 3) AS LONG)").alias("k"), F.concat("s_name", F.lit(" supplies "), "p_name", F.lit(".")).alias("v"))

    def _told(self) -> DataFrame:
        """Written lines as passages, with what edges are made of; names meet by number, before ids are texts."""
        if self._texts is None:
            s = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
            p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
            self._texts = written(self._lines.join(s, "l_suppkey").join(p, "l_partkey"), "texts")
        return self._texts.select(
            F.concat(F.lit("l:"), F.concat_ws(".", "l_orderkey", "seq")).alias("id"), F.concat(F.lit("o:"), "l_orderkey").alias("parent_id"), "seq",
            F.concat(F.lit("p:"), "l_partkey").alias("part"), F.concat(F.lit("s:"), "l_suppkey").alias("supplier"), F.col("l_orderkey").cast("long").alias("k"),
            F.concat("s_name", F.lit(" supplies "), "p_name", F.lit(".")).alias("v"), "l_orderkey", "l_partkey", "l_suppkey", "d", "q", "n", "f", "at",
        )

    def faulty(self) -> dict[str, DataFrame]:
        """Orders as sources, assets and passages; a few of them break an invariant each."""
        from pyspark.sql import Window

        lines = self.line_texts()
        either = lambda when, bad, good: F.expr(f"CASE WHEN {when} THEN {bad} ELSE {good} END")
        digest = lambda c: f"concat('sha256:', substring(sha2({c}, 256), 1, 32))"
        texts = lines.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]), "\n").alias("text"))
        sources = texts.select(
            F.expr("concat('src:', k)").alias("id"), "text", either("k % 397 = 1", "'sha256:bad'", digest("text")).alias("content_hash"), either("k % 409 = 3", "1", "0").alias("seq"), either("k % 401 = 2", "'summary'", "'verbatim'").alias("kind")
        )
        before = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        placed = lines.withColumn("char_start", F.coalesce(F.sum(F.length("v") + 1).over(before), F.lit(0)).cast("long"))
        told = "CASE WHEN seq % 5 <> 4 AND k % 439 = 8 THEN concat(v, '!') WHEN seq % 5 = 4 AND k % 41 <> 9 THEN replace(v, 'supplies', 'ships') ELSE v END"
        passages = placed.select(
            "id",
            either("k % 419 = 4", "'o:gone'", "parent_id").alias("parent_id"),
            either("k % 421 = 5", "'src:gone'", "concat('src:', k)").alias("source_id"),
            F.expr(told).alias("text"),
            either("seq % 5 = 4", "'resolved'", "'verbatim'").alias("resolution"),
            "char_start",
            either("k % 431 = 6 AND seq = 0", "char_start", "char_start + length(v)").alias("char_end"),
            either("k % 433 = 7", "'sha256:bad'", digest("v")).alias("content_hash"),
        )
        owners = self.assets().select("id", "parent_id", F.expr("CAST(substring(id, 3) AS LONG)").alias("k"))
        assets = owners.join(lines.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi").select("id", either("k % 449 = 10", "'n:gone'", "parent_id").alias("parent_id"), either("k % 457 = 11", "'src:gone'", "concat('src:', k)").alias("source_id"))
        islands = self.table("nation").select(F.expr("concat('n:', n_nationkey)").alias("id"), either("n_nationkey = 24", "'r:gone'", "concat('r:', n_regionkey)").alias("parent_id"))
        mentions = lines.select(F.explode(F.array("part", "supplier")).alias("id"), F.col("id").alias("passage_id"), F.col("parent_id").alias("asset_id"))
        homes = mentions.join(owners.select(F.col("id").alias("asset_id"), F.col("parent_id").alias("island")), "asset_id").groupBy("id").agg(F.collect_set("island").alias("islands"))
        named = self.nodes().where("kind = 'entity' AND (id NOT LIKE 'c:%' OR id LIKE 'c:%77')").select("id", "label", F.expr("CAST(substring(id, 3) AS LONG)").alias("k"))
        entities = named.join(homes, "id", "left").select("id", "label", F.coalesce("islands", F.array().cast("array<string>")).alias("islands"), "k")
        entities = entities.select("id", "label", "islands", F.expr("(size(islands) > 1) <> (k % 97 = 3)").alias("is_bridge"))
        if self._lines is not None:  # an edge and its passage are of one line
            sources, entities = written(sources, "sources"), written(entities, "entities")
            gated = self._edges(self._told(), "k", "seq", "part", "supplier", F.col("id").alias("passage"))
        else:
            gated = self.edges().select("id", "quarantined", "reason").join(lines.select(F.expr("concat('x:', k, '-', substring(part, 3), '-', substring(supplier, 3))").alias("id"), "k", "seq", "part", "supplier", F.col("id").alias("passage")), "id")
        claims = gated.select(
            "id",
            either("k % 461 = 12", "'s:gone'", "supplier").alias("from_id"),
            F.col("part").alias("to_id"),
            F.lit("supplies").alias("family"),
            either("k % 463 = 13", "'episodic'", "'factual'").alias("sigma"),
            either("k % 467 = 14", "'supplies'", "'supplied_by'").alias("inverse_family"),
            "quarantined",
            F.expr("CASE WHEN NOT quarantined THEN CASE WHEN k % 487 = 16 THEN 'inverse_conflict' END WHEN k % 59 = 15 THEN NULL WHEN k % 61 = 20 THEN 'other' ELSE reason END").alias("reason"),
            F.expr("CASE WHEN k % 491 = 17 THEN CAST(array() AS ARRAY<STRING>) WHEN k % 499 = 18 THEN array(concat('l:', k + 1, '.0')) ELSE array(passage) END").alias("evidence"),
        )
        after = lines.where("seq > 0").select("k", "seq", F.col("id").alias("from_id"), F.expr("concat('l:', k, '.', seq - 1)").alias("to_id"))
        fiber = after.select(
            F.concat(F.lit("f:"), "from_id").alias("id"), "from_id", "to_id", F.lit("_follows").alias("family"), F.lit("structural").alias("sigma"), F.lit("_precedes").alias("inverse_family"),
            F.expr("k % 503 = 19").alias("quarantined"), F.expr("CASE WHEN k % 503 = 19 THEN 'inverse_conflict' END").alias("reason"), F.array("from_id").alias("evidence"),
        )
        first = lines.where("seq = 0 AND k % 50 = 0")
        staged = first.select(
            F.expr("concat('q:', k)").alias("id"),
            F.expr("CASE WHEN k % 250 = 0 THEN array(part, supplier, concat('gone:', k)) ELSE array(part, supplier) END").alias("node_ids"),
            F.expr("array(CASE WHEN k % 350 = 0 THEN 'x:gone' ELSE concat('x:', k, '-', substring(part, 3), '-', substring(supplier, 3)) END)").alias("edge_ids"),
        )
        families = self.spark.createDataFrame(
            [("supplies", "factual", "supplied_by"), ("supplied_by", "factual", "supplies"), ("_follows", "structural", "_precedes"), ("_precedes", "structural", "_follows")], "family string, sigma string, inverse string"
        )
        continents = self.table("region").select(F.expr("concat('r:', r_regionkey)").alias("id"))
        return {
            "continents": continents, "islands": islands, "assets": assets, "sources": sources, "passages": passages, "entities": entities, "mentions": mentions.select("id", "passage_id"),
            "edges": claims.unionByName(fiber), "families": families, "staged": staged,
        }


CTES = {
    "sources": """SELECT 'doc:' || doc_id AS source_id, source AS source_label, '' AS source_uri, lang AS source_type,
        '2024-01-01T00:00:00+00:00' AS imported_at, sha256(text) AS content_hash, strlen(text) AS byte_size FROM documents""",
    "segments": """SELECT 'seg:' || doc_id || ':' || seq AS segment_id, 'doc:' || doc_id AS source_id, seq, text FROM (
        SELECT doc_id, 0::INT AS seq, text FROM documents UNION ALL
        SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT, unnest(string_split(text, chr(10))) FROM documents)""",
    "ownership": """SELECT segment_id, source_id FROM segments UNION ALL
        SELECT 'seg:' || f || ':0', 'doc:' || doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS f FROM documents) WHERE doc_id <> f""",
    "overlay": "SELECT 'doc:' || doc_id AS source_id, '{}' AS resolution_map FROM documents WHERE doc_id % 5 = 0",
    "answers": """SELECT 'ans:' || event_id AS answer_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS answered_at, user_id::VARCHAR AS user_id,
        CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' ELSE event_type END AS render_strategy FROM events""",
    "citations": """SELECT 'ans:' || event_id AS answer_id, 'seg:' || c.doc_id || ':' || seq AS segment_id, cite_order,
        CASE WHEN d.text IS NULL THEN '' WHEN event_id % 11 = 0 THEN 'not in the text' WHEN event_id % 13 = 0 THEN replace(substr(d.text, 1, 60), ' ', '  ')
             ELSE substr(d.text, 1, 60) END AS evidence_snippet
        FROM (SELECT event_id, event_id % (n * 11 // 10) AS doc_id, 1::INT AS cite_order, (event_id % 4 = 1)::INT AS seq FROM events, (SELECT count(*) AS n FROM documents) WHERE event_id % 50 <> 7
              UNION ALL SELECT event_id, (event_id * 7) % n, 2, 0 FROM events, (SELECT count(*) AS n FROM documents) WHERE event_id % 50 <> 7 AND event_id % 3 = 0) c
        LEFT JOIN documents d ON d.doc_id = c.doc_id""",
    "claims": """SELECT 'ans:' || doc_id * 13 AS answer_id, 0::INT AS claim_index,
        CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END AS verdict, (1 + quality) / 2.0::DOUBLE AS confidence FROM labels""",
    "evidence": """SELECT 'ans:' || doc_id * 13 AS answer_id, 0::INT AS claim_index, rank, 'seg:' || doc_id || ':' || (rank - 1) AS segment_id, 1::DOUBLE / rank AS score
        FROM labels, (SELECT unnest([1, 2])::INT AS rank)""",
    "explained": """SELECT c.answer_id, c.cite_order, c.segment_id, c.evidence_snippet, s.source_id, s.seq, r.source_label, r.source_type, r.content_hash, o.source_id IS NOT NULL AS has_overlay
        FROM citations c LEFT JOIN segments s ON s.segment_id = c.segment_id LEFT JOIN sources r ON r.source_id = s.source_id LEFT JOIN overlay o ON o.source_id = s.source_id""",
    "edges": """SELECT 'x:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey AS id, 's:' || l_suppkey AS from_id, 'p:' || l_partkey AS to_id, 'o:' || l_orderkey AS asset_id,
        'supplies' AS family, CASE f WHEN 'A' THEN 'factual' WHEN 'N' THEN 'temporal' ELSE 'episodic' END AS sigma,
        least(greatest(q::DOUBLE / 50, 0), 1) AS weight, (100 - 5 * pct) / 100.0::DOUBLE AS confidence, ['l:' || l_orderkey] AS evidence,
        (pct > 9 OR (f = 'R' AND n = 7)) AS quarantined,
        CASE WHEN pct > 9 THEN 'confidence_below_floor' WHEN f = 'R' AND n = 7 THEN 'duplicate_assertion_divergent_object' END AS reason,
        strftime("at", '%Y-%m-%dT%H:%M:%S') AS "at"
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, round(max(l_discount) * 100)::INT AS pct, sum(l_quantity) AS q, min(l_linenumber) AS n, max(l_returnflag) AS f, min(l_shipdate) AS "at"
              FROM lineitem GROUP BY ALL)""",
    "assets": """SELECT 'o:' || o_orderkey AS id, 'n:' || c_nationkey AS parent_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS "at", o_totalprice::DOUBLE AS price
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "nodes": """SELECT 'r:' || r_regionkey AS id, 'continent' AS kind, NULL AS parent_id, r_name AS label FROM region UNION ALL
        SELECT 'n:' || n_nationkey, 'island', 'r:' || n_regionkey, n_name FROM nation UNION ALL SELECT id, 'asset', parent_id, id FROM assets UNION ALL
        SELECT 'c:' || c_custkey, 'entity', 'n:' || c_nationkey, c_name FROM customer UNION ALL SELECT 's:' || s_suppkey, 'entity', 'n:' || s_nationkey, s_name FROM supplier UNION ALL
        SELECT 'p:' || p_partkey, 'entity', NULL, p_name FROM part""",
    "region_of": """SELECT id, 'n:' || k AS island, 'r:' || n_regionkey AS continent FROM (SELECT 's:' || s_suppkey AS id, s_nationkey AS k FROM supplier UNION ALL
        SELECT 'p:' || p_partkey, (p_partkey % 25)::INT FROM part) JOIN nation ON n_nationkey = k""",
    "passages": """SELECT 'l:' || l_orderkey || '.' || seq AS id, 'o:' || l_orderkey AS parent_id, seq, 'p:' || l_partkey AS part, 's:' || l_suppkey AS supplier FROM (
        SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey, l_suppkey) - 1)::INT AS seq FROM (SELECT l_orderkey, l_partkey, l_suppkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL))""",
    "trade_edges": """SELECT id, from_id, to_id, family, confidence, evidence, quarantined FROM edges UNION ALL
        SELECT 'b:' || l_orderkey || '-' || l_partkey, 'p:' || l_partkey, 'c:' || o_custkey, 'bought', (100 - (l_orderkey * 7 + l_partkey) % 60) / 100.0::DOUBLE,
        CASE WHEN l_orderkey % 4 = 0 THEN [] ELSE ['l:' || l_orderkey] END, l_orderkey % 9 = 0
        FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey""",
    "answer_paths": """SELECT parent_id AS path_id, step, edge_id, from_id, to_id FROM (
            SELECT *, seq AS step, 'x:' || k || '-' || substr(part, 3) || '-' || substr(supplier, 3) AS edge_id, supplier AS from_id, part AS to_id FROM path_lines WHERE k % 5 = 3 OR seq = 0 UNION ALL
            SELECT *, CASE WHEN k % 5 = 2 THEN -1 ELSE 1 END, 'b:' || k || '-' || substr(part, 3), part, 'c:' || o_custkey FROM path_lines WHERE k % 5 < 3 AND seq = 0)""",
    "path_lines": "SELECT p.*, o_orderkey AS k, o_custkey FROM passages p JOIN orders ON parent_id = 'o:' || o_orderkey WHERE seq <= 1",
    "line_texts": """SELECT id, parent_id, seq, part, supplier, substr(parent_id, 3)::BIGINT AS k, s_name || ' supplies ' || p_name || '.' AS v
        FROM passages JOIN supplier ON supplier = 's:' || s_suppkey JOIN part ON part = 'p:' || p_partkey""",
    "f_sources": """SELECT 'src:' || k AS id, text, CASE WHEN k % 397 = 1 THEN 'sha256:bad' ELSE 'sha256:' || sha256(text)[:32] END AS content_hash, (k % 409 = 3)::INT AS seq,
        CASE WHEN k % 401 = 2 THEN 'summary' ELSE 'verbatim' END AS kind FROM (SELECT k, string_agg(v, chr(10) ORDER BY seq) AS text FROM line_texts GROUP BY k)""",
    "f_passages": """SELECT id, CASE WHEN k % 419 = 4 THEN 'o:gone' ELSE parent_id END AS parent_id, CASE WHEN k % 421 = 5 THEN 'src:gone' ELSE 'src:' || k END AS source_id,
        CASE WHEN seq % 5 <> 4 AND k % 439 = 8 THEN v || '!' WHEN seq % 5 = 4 AND k % 41 <> 9 THEN replace(v, 'supplies', 'ships') ELSE v END AS text,
        CASE WHEN seq % 5 = 4 THEN 'resolved' ELSE 'verbatim' END AS resolution, a AS char_start, a + CASE WHEN k % 431 = 6 AND seq = 0 THEN 0 ELSE length(v) END AS char_end,
        CASE WHEN k % 433 = 7 THEN 'sha256:bad' ELSE 'sha256:' || sha256(v)[:32] END AS content_hash
        FROM (SELECT *, coalesce(sum(length(v) + 1) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM line_texts)""",
    "f_assets": """SELECT id, CASE WHEN k % 449 = 10 THEN 'n:gone' ELSE parent_id END AS parent_id, CASE WHEN k % 457 = 11 THEN 'src:gone' ELSE 'src:' || k END AS source_id
        FROM (SELECT id, parent_id, substr(id, 3)::BIGINT AS k FROM assets WHERE id IN (SELECT parent_id FROM line_texts))""",
    "f_islands": "SELECT 'n:' || n_nationkey AS id, CASE WHEN n_nationkey = 24 THEN 'r:gone' ELSE 'r:' || n_regionkey END AS parent_id FROM nation",
    "f_mentions": "SELECT part AS id, id AS passage_id, parent_id AS asset_id FROM line_texts UNION ALL SELECT supplier, id, parent_id FROM line_texts",
    "f_entities": """SELECT id, label, coalesce(n, 0) AS islands, (coalesce(n, 0) > 1) <> (substr(id, 3)::BIGINT % 97 = 3) AS is_bridge FROM nodes
        LEFT JOIN (SELECT m.id, count(DISTINCT a.parent_id) AS n FROM f_mentions m JOIN assets a ON a.id = asset_id GROUP BY ALL) USING (id) WHERE kind = 'entity' AND (id NOT LIKE 'c:%' OR id LIKE 'c:%77')""",
    "f_edges": """SELECT e.id, CASE WHEN k % 461 = 12 THEN 's:gone' ELSE supplier END AS from_id, part AS to_id, 'supplies' AS family, CASE WHEN k % 463 = 13 THEN 'episodic' ELSE 'factual' END AS sigma,
        CASE WHEN k % 467 = 14 THEN 'supplies' ELSE 'supplied_by' END AS inverse_family, quarantined,
        CASE WHEN NOT quarantined THEN CASE WHEN k % 487 = 16 THEN 'inverse_conflict' END WHEN k % 59 = 15 THEN NULL WHEN k % 61 = 20 THEN 'other' ELSE reason END AS reason,
        CASE WHEN k % 491 = 17 THEN [] WHEN k % 499 = 18 THEN ['l:' || (k + 1) || '.0'] ELSE [l.id] END AS evidence
        FROM edges e JOIN line_texts l ON e.id = 'x:' || k || '-' || substr(part, 3) || '-' || substr(supplier, 3) UNION ALL
        SELECT 'f:' || id, id, 'l:' || k || '.' || (seq - 1), '_follows', 'structural', '_precedes', k % 503 = 19, CASE WHEN k % 503 = 19 THEN 'inverse_conflict' END, [id] FROM line_texts WHERE seq > 0""",
    "f_staged": """SELECT 'q:' || k AS id, CASE WHEN k % 250 = 0 THEN [part, supplier, 'gone:' || k] ELSE [part, supplier] END AS node_ids,
        [CASE WHEN k % 350 = 0 THEN 'x:gone' ELSE 'x:' || k || '-' || substr(part, 3) || '-' || substr(supplier, 3) END] AS edge_ids FROM line_texts WHERE seq = 0 AND k % 50 = 0""",
    "layout_nodes": """SELECT *, CASE WHEN place % 10 = 9 THEN 1.5 ELSE place % 10 / 10.0 END::DOUBLE AS centrality FROM (
        SELECT id, kind, parent_id, CASE WHEN kind = 'island' THEN id END AS community, CASE WHEN kind IN ('asset', 'entity') THEN substr(id, 3)::INT ELSE 0 END AS place FROM nodes UNION ALL
        SELECT id, 'passage', parent_id, NULL, seq FROM passages UNION ALL SELECT 'src:' || substr(id, 3), 'source', NULL, NULL, 0 FROM assets)""",
    "layout_links": """SELECT 'edge' AS link, from_id AS a, to_id AS b, greatest(0.02, least(1.0, weight)) * CASE WHEN quarantined THEN 0.35 ELSE 1.0 END::DOUBLE * CASE WHEN sigma = 'structural' THEN 1.15 ELSE 1.0 END::DOUBLE AS weight
        FROM edges WHERE from_id IN (SELECT id FROM layout_nodes) AND to_id IN (SELECT id FROM layout_nodes) UNION ALL
        SELECT 'spine', parent_id, id, 1.0::DOUBLE FROM layout_nodes WHERE parent_id IN (SELECT id FROM layout_nodes) UNION ALL
        SELECT 'sibling', id, n, 0.9::DOUBLE FROM (SELECT id, lead(id) OVER (PARTITION BY parent_id ORDER BY place, id) AS n FROM layout_nodes WHERE parent_id IN (SELECT id FROM layout_nodes)) WHERE n IS NOT NULL UNION ALL
        SELECT 'mention', unnest([part, supplier]), id, 0.75::DOUBLE FROM passages UNION ALL
        SELECT 'attach', id, asset_id, 0.55::DOUBLE FROM (SELECT DISTINCT supplier AS id, parent_id AS asset_id FROM passages) WHERE asset_id IN (SELECT id FROM layout_nodes) UNION ALL
        SELECT 'attach', 'src:' || substr(id, 3), id, 0.55::DOUBLE FROM assets""",
    "said": """SELECT id AS passage_id, parent_id AS asset_id, part, supplier, p % 5 = 0 OR s % 10 = 0 OR k % 11 = 0 AS unit, k % 7 = 1 AS dest, k FROM (
        SELECT *, substr(part, 3)::BIGINT AS p, substr(supplier, 3)::BIGINT AS s, substr(parent_id, 3)::BIGINT AS k FROM passages)""",
    "told": "SELECT part AS id, passage_id, asset_id, unit, dest FROM said UNION ALL SELECT supplier, passage_id, asset_id, unit, dest FROM said",
    "scopes": """SELECT id, label, CASE WHEN bool_and(unit) THEN 'derived' ELSE 'boundary' END AS scope FROM told JOIN nodes USING (id) WHERE kind = 'entity' AND substr(id, 3)::BIGINT % 97 <> 5 GROUP BY ALL HAVING bool_or(unit)""",
    "sent_edges": """SELECT from_id, to_id, CASE coalesce((a.scope = 'derived')::INT, 0) + coalesce((b.scope = 'derived')::INT, 0) WHEN 2 THEN 'internal' WHEN 1 THEN 'boundary' ELSE 'shared' END AS scope
        FROM (SELECT DISTINCT supplier AS from_id, part AS to_id FROM said WHERE unit) LEFT JOIN scopes a ON a.id = from_id LEFT JOIN scopes b ON b.id = to_id WHERE a.id IS NOT NULL OR b.id IS NOT NULL""",
    "dest_nodes": """SELECT id, CASE WHEN substr(id, 3)::BIGINT % 3 = 0 THEN 'extraction_stub' ELSE 'own' END AS category, label, CASE WHEN substr(id, 3)::BIGINT % 3 = 0 THEN '' ELSE 'known here' END AS body
        FROM nodes WHERE kind = 'entity' AND substr(id, 3)::BIGINT % 97 <> 5 AND id IN (SELECT id FROM told WHERE dest)""",
    "landed_edges": "SELECT from_id, to_id, 'supplies' AS relation FROM sent_edges UNION SELECT supplier, part, 'supplies' FROM said WHERE dest",
    "landed_nodes": """SELECT * FROM (SELECT id, CASE WHEN s.scope = 'derived' THEN 'entity' WHEN d.category = 'own' THEN 'own' ELSE 'extraction_stub' END AS category, coalesce(s.label, d.label) AS label,
            CASE WHEN s.scope = 'derived' THEN 'about ' || s.label WHEN d.category = 'own' THEN d.body ELSE '' END AS body FROM scopes s FULL JOIN dest_nodes d USING (id))
        UNION ALL SELECT DISTINCT id, 'extraction_stub', id, '' FROM (SELECT unnest([from_id, to_id]) AS id FROM landed_edges) WHERE id NOT IN (SELECT id FROM scopes UNION SELECT id FROM dest_nodes)""",
    "relations": "SELECT 'rel:' || vec_id AS relation, list_transform(embedding, lambda x: x::DOUBLE) AS v, label, vec_id FROM embeddings",
    "triples": "SELECT 'reg' || (vec_id + k) % 6 AS register, 'rel:' || vec_id AS relation FROM (SELECT vec_id, unnest(range(0, (vec_id % 4)::INT + 1)) AS k FROM embeddings)",
    "families": "SELECT 'fam:' || label AS family, label AS place, v FROM relations QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1",
    "stats": "SELECT relation, count(*) AS freq FROM triples GROUP BY relation",
    "nearest": """SELECT r.relation, f.family, round(list_inner_product(r.v, f.v), 6) AS best FROM relations r, families f
        QUALIFY row_number() OVER (PARTITION BY r.relation ORDER BY list_inner_product(r.v, f.v) DESC, f.place) = 1""",
    "positions": """SELECT 'p:' || p_partkey AS id, ((p_partkey * 37) % 1000)::DOUBLE AS x, ((p_partkey * 91) % 1000)::DOUBLE AS y, p_size / 5.0::DOUBLE AS r, 'n:' || p_partkey % 25 AS community FROM part""",
}

#: The views that each view is made of.
NEEDS = {
    "ownership": ["segments"],
    "trade_edges": ["edges"],
    "line_texts": ["passages"],
    "said": ["passages"],
    "told": ["said"],
    "scopes": ["told", "nodes"],
    "sent_edges": ["said", "scopes"],
    "dest_nodes": ["nodes", "told"],
    "landed_edges": ["sent_edges", "said"],
    "landed_nodes": ["scopes", "dest_nodes", "landed_edges"],
    "layout_nodes": ["nodes", "assets", "passages"],
    "layout_links": ["edges", "layout_nodes", "passages", "assets"],
    "f_sources": ["line_texts"],
    "f_passages": ["line_texts"],
    "f_assets": ["assets", "line_texts"],
    "f_mentions": ["line_texts"],
    "f_entities": ["nodes", "f_mentions", "assets"],
    "f_edges": ["edges", "line_texts"],
    "f_staged": ["line_texts"],
    "path_lines": ["passages"],
    "answer_paths": ["path_lines"],
    "explained": ["segments", "sources", "overlay", "citations"],
    "nodes": ["assets"],
    "families": ["relations"],
    "stats": ["triples"],
    "nearest": ["relations", "families"],
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the common table expressions of the named views and what they are made of."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    start = "WITH RECURSIVE" if sql.lstrip().startswith("RECURSIVE ") else "WITH"
    sql = sql.lstrip().removeprefix("RECURSIVE ")
    views = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    if not order:
        return sql if sql.startswith("SELECT") else f"{start} {sql}"
    return f"{start} {views}{', ' if sql.startswith(',') else ' '}{sql.removeprefix(',')}"
