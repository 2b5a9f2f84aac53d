"""op1: every whole text of ``documents`` encoded and decoded again."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import bpe
from tomeweave.llm.common import documents

TOKENIZER = "word_bpe_49k.json"


def digests(rows: DataFrame, ids: str, decoded: str) -> DataFrame:
    return rows.select(
        "doc_id",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return digests(*bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), path))
