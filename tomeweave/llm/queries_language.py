"""op6: the language of every ``documents`` text, learned from three folds of four."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import language
from tomeweave.llm.common import documents


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    samples = language.sample(docs.filter(~language.held_out(F.col("doc_id"))).select("text", "lang"))
    rows, at = language.predict(docs.select("doc_id", "text"), samples)
    return rows.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), F.col(at)["lang"].alias("lang_pred"), F.col(at)["score"].alias("score"))
