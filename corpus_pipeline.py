"""From ``documents`` to token ids: quality rules, near-duplicates, secrets, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Stages share the executors' Python processes, so each bounds its batches of texts by bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import bpe, mixing, near_dup, quality, secrets
from tomeweave.llm.common import bound_batches, documents, shared_path
from tomeweave.llm.queries_bpe import TOKENIZER


#: Pieces that a task remembers here: less than alone, as its process has run the other stages before.
REMEMBERED = 50_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy."""
    bound_batches(spark)
    return quality.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of near-duplicates."""
    bound_batches(spark)
    return near_dup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; ``n_chars`` follows the text."""
    bound_batches(spark)
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids (packed, little-endian, 32 bits), their number, and the digest of the text decoded from them."""
    bound_batches(spark)
    rows, ids, decoded = bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), remembered=REMEMBERED)
    tokens = (F.octet_length(ids) / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", "lang", "source", tokens, F.col(ids).alias("ids"), F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe_round_trip", bpe_round_trip),
]

#: SQL cannot express BPE; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
