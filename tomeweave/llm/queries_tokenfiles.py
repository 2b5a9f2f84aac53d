"""op3: all ``documents`` as a token-id file, and what is read back from it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tomeweave.llm import tokenfiles
from tomeweave.llm.common import documents, shared_path
from tomeweave.llm.queries_bpe import TOKENIZER


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    tokenfiles.write(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return tokenfiles.checksum(tokenfiles.read(spark, path))
