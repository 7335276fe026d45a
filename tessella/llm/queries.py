"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .fmindex import remove_repeated_words
from .kdtree import top_inner_products
from .minhash import near_duplicates
from .mixing import mix
from .negatives import hard_negatives
from .quantize import product_codes
from .rules import judge
from .secrets import find_secrets, joined
from .sharding import shard_rows
from .suffixes import remove_repeated_bytes
from .tables import new_folder
from .toxicity import toxicity
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on 3-word shingles at a similarity of 85 in 100 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads the archives back."""
    folder = new_folder(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), folder)
    read = read_warc(spark, folder, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents, and the verdict of the rules learned from labels."""
    judged = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in whole texts: the base kinds, and tokens of the randomness battery."""
    found = find_secrets(_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("found", lambda c: c["k"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda c: c["k"] != "random")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), of("random")
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    rows, _ = mix(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and what the ids decode to."""
    import public_tokenizers as public

    path, pattern = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
    ids = encode(_table(spark, sf_dir, "documents"), path, pattern)
    facts = ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "ids",
    )
    out = decode(facts, path, pattern, carry=("n_tokens", "ids_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    rows = shard_rows(_table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    found = top_inner_products(_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside windows of 35 words that occur anywhere else."""
    kept = remove_repeated_words(_table(spark, sf_dir, "documents"), length=35, gram=12, texts=False)
    return kept.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes outside strings of 50 bytes that a document with a smaller id has."""
    kept = remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=50, gram=20, texts=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents: the noisy-or of sentence scores learned from document labels."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by four codebooks of 256 entries after four rounds."""
    coded = product_codes(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024.0)
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every hundredth vector; labels of every seventh are moved by one."""
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), "vec_id % 100 = 0")


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_warc": op2_warc,
    "op3_rules": op3_rules,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_topk": op8_topk,
    "op9_fmindex": op9_fmindex,
    "op10_suffixes": op10_suffixes,
    "op11_toxicity": op11_toxicity,
    "op12_codes": op12_codes,
    "op13_negatives": op13_negatives,
}

_DISTANCE = "list_sum(list_transform(list_zip(x.y, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one after the other, each a join of all parts with all entries."""

    def nearest(k: int) -> str:
        return f"""n{k} AS MATERIALIZED (
            SELECT x.vec_id, x.p, x.y, arg_min(b.j, ({_DISTANCE}, b.j)) AS j, min({_DISTANCE}) AS dist
            FROM x JOIN b{k} b ON x.p = b.p GROUP BY ALL
        )"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (
            SELECT b.p, b.j, coalesce(m.y, b.y) AS y
            FROM b{k} b LEFT JOIN (
                SELECT p, j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS y
                FROM (SELECT p, j, i, count(*)::HUGEINT AS n, sum(c)::HUGEINT AS s
                      FROM (SELECT p, j, unnest(y) AS c, generate_subscripts(y, 1) AS i FROM n{k}) GROUP BY ALL)
                GROUP BY p, j
            ) m ON b.p = m.p AND b.j = m.j
        )"""

    steps = ", ".join([f"{nearest(k)}, {moved(k)}" for k in range(rounds)] + [nearest(rounds)])
    return f"""
        WITH v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS MATERIALIZED (
            SELECT vec_id, p::INT AS p, q[p * len(q) // 4 + 1 : (p + 1) * len(q) // 4] AS y FROM v, range(4) t(p)
        ), b0 AS MATERIALIZED (
            SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS j, y FROM x QUALIFY j < 256
        ), {steps}, c AS (
            SELECT v.vec_id, v.label, string_agg(printf('%02x', n.j), '' ORDER BY n.p) AS code, sum(n.dist)::BIGINT AS error
            FROM v JOIN n{rounds} n ON v.vec_id = n.vec_id GROUP BY ALL
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, j)) FROM b{rounds}) AS codebooks_sha256
        FROM c
    """


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT *, translate(
                lpad(to_base(('0x' || h[1:5])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[6:10])::BIGINT, 32), 4, '0')
                || lpad(to_base(('0x' || h[11:15])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[16:20])::BIGINT, 32), 4, '0')
                || lpad(to_base(('0x' || h[21:25])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[26:30])::BIGINT, 32), 4, '0')
                || lpad(to_base(('0x' || h[31:35])::BIGINT, 32), 4, '0') || lpad(to_base(('0x' || h[36:40])::BIGINT, 32), 4, '0'),
                '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
                max(page_id) OVER (PARTITION BY h) AS top
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM d
    """,
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_codes": _codes_sql(),
    "op13_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b, a.y = b.y AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
        ), n AS (
            SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank
            FROM p JOIN s ON p.a = s.a AND NOT s.same
            WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
}
