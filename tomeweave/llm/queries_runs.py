"""op12: periodic runs of words in ``documents``, a tenth of which are made periodic first."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import runs
from tomeweave.llm.common import WORD, documents


def made_periodic(docs: DataFrame) -> DataFrame:
    """Texts of each tenth document (by the crc32 of its id) repeat a stretch of their own words; a null id stands for the empty string."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = docs.withColumns({"g": F.floor(h / 10).cast("long"), "w": F.when(h % 10 == 0, words)}).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    period = F.lit(1) + F.call_function("div", F.col("n") - a, F.lit(3) + F.col("g") % 8)
    moved = F.transform("w", lambda word, i: F.when(i < F.col("a"), word).otherwise(F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    some = F.col("n") > 0
    made = chosen.withColumns({"a": F.when(some, a), "p": F.when(some, period)})
    return made.select("doc_id", F.when(some, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found, collapsed = runs.periodic_runs(made_periodic(documents(spark, sf_dir).select("doc_id", "text")))
    lines = F.array_join(F.transform(found, lambda x: F.concat(F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    # The longest; of these the one with the smallest start, then period: the first, as they come in that order.
    rows = rows.withColumns({"lines": lines, "most": F.array_max(F.transform(found, lambda x: x["length"]))})
    rows = rows.withColumn("longest", F.get(F.filter(found, lambda x: x["length"] == F.col("most")), F.lit(0)))
    return rows.select(
        "doc_id", F.size(found).cast("long").alias("n_runs"), F.col("longest.start").alias("start"), F.col("longest.length").alias("length"), F.col("longest.period").alias("period"),
        F.call_function("div", F.col("longest.length") * 1000, F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.coalesce(F.col(collapsed), F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )
