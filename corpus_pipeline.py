"""A corpus pipeline: each stage applies one training-data operator to what the stage before it kept.

Every stage but the last returns the columns of documents. Between stages the rows are written as Parquet to the shared
folder and read again, so a stage reads its input as often as it needs without repeating the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe_codec, quality_crf, secret_scan, simhash_dedup, source_mix
from turnlake.llm.shared import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-chain classifier does not reject.

    Null and empty texts are scored as one empty line and stay or go together; rows with a null id stay in play like any
    other; repeated rows share a score; an empty table gives an empty one. Extra columns pass through, whatever their names.
    """
    field = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select(F.struct(*[F.col(x) for x in docs.columns]).alias("kept"), F.col("text").alias("text"))
    return quality_crf.score(packed, field).where(F.col("score") >= quality_crf.THRESHOLD).select("kept.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least id, of each group of near duplicates; null ids count as the largest.

    Repeated rows leave one of them. Null texts and texts without words are one group. Extra columns pass through.
    """
    return simhash_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets replaced by a mark; n_chars is the new text's length.

    Null texts stay null and keep their n_chars; null ids and repeated rows stay; an empty table gives an empty one. Extra
    columns pass through, whatever their names.
    """
    clean = secret_scan.redact(docs, secret_scan.scan(docs))
    length = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes, as documents; a document taken twice gives two rows.

    A null source is a source of its own; null and wordless texts give no words and so no rows; repeated rows are mixed
    each on its own; an empty table gives an empty one. Extra columns pass through.
    """
    return source_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit integers), their number and the digest of what they decode to.

    A null text has no ids, a null id stays null, repeated rows give repeated rows, an empty table an empty one. Columns
    other than doc_id and text are not read.
    """
    import public_tokenizers

    tokens = bpe_codec.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL cannot express the field, the permutations or the encoding; tests/llm compares the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
