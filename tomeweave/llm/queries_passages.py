"""op4: passages of ``documents`` that repeat, removed but for their first occurrence."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import passages
from tomeweave.llm.common import documents


def op4_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kept, removed = passages.drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.transform(F.col(removed), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    chars = F.aggregate(F.col(removed), F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return rows.select("doc_id", F.array_join(spans, ",").alias("removed"), chars.alias("n_removed"), F.sha2(F.coalesce(F.col(kept), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
