"""The corpus pipeline: stages that each apply one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, minhash, mixing, rules, secrets
from tessella.llm.tables import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules learned from ``labels`` reject go.

    A null text has no words and is judged as an empty one; rows without an id and rows that
    share one are judged each by itself; labels without an id or a quality teach nothing, and
    without labels only the repeat rule holds. Other columns pass through under any name.
    """
    return rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays.

    Null, empty and wordless texts are linked with nothing and stay, each row. Groups are of
    texts, so different texts under one id stay and rows without an id take part; of rows that
    are equal in id and text one stays. Other columns pass through under any name.
    """
    return minhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in their texts, and their length is counted again.

    A null text stays null; every row is kept, whatever its id; other columns pass through
    under any name.
    """
    return secrets.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them: whole, in part, or more than once.

    Documents without words give no row, as no word of theirs can be taken. The null source is
    a source of its own, ordered last. Other columns pass through under any name.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, source, n_tokens, ids, decoded_sha256) of the mixed texts.

    A null text is encoded as an empty one, without ids; ids of documents may be null or
    repeated; other columns are left unread.
    """
    import public_tokenizers as public

    path, pattern = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
    out = bpe.round_trip(docs, path, pattern, carry=("source",))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: Learned rules and seeded draws are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn to ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
