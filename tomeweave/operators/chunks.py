"""Overlapping chunks of chapters; map-only until the chunks are dealt anew."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions.text import strip
from tomeweave.sources.files import read_tables, write_tables


@dataclass(frozen=True)
class RetrievalConfig:
    """The values that retrieval and chunking use by default."""

    chunk_size: int = 500
    overlap: int = 100
    top_k: int = 5
    analyzer: str = "char_2_5"
    tfidf_weight: float = 0.48
    bm25_weight: float = 0.27
    phrase_weight: float = 0.25
    phrase_rerank: bool = True
    min_score: float = 0.005

    @property
    def weights(self) -> tuple[float, float, float]:
        """Of TF-IDF, BM25 and phrases, with the sum 1; no phrase weight without the rerank."""
        phrase = self.phrase_weight if self.phrase_rerank else 0.0
        total = self.tfidf_weight + self.bm25_weight + phrase
        return (self.tfidf_weight, self.bm25_weight, phrase) if total <= 0 else (self.tfidf_weight / total, self.bm25_weight / total, phrase / total)


def _windows(size: int, step: int):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        cut = lambda x: [x[k : k + size] for k in range(0, max(len(x) - size + step, 1), step)] if x else []
        return pd.Series([None if x is None else cut(x) for x in texts], dtype=object)

    return run


def split_text(c: Column, size: int, overlap: int) -> Column:
    """Array of windows of ``size`` characters, each beginning ``overlap`` before the last one's end; the last ends with the text.

    Blanks are trimmed by built-in functions; the windows are slices made in one pass over a text, in Arrow batches.
    """
    if not 0 <= overlap < size:
        raise ValueError("an overlap must be smaller than its chunk")
    return _windows(size, size - overlap)(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")))


def build_chunks(chapters: DataFrame, config: RetrievalConfig) -> DataFrame:
    """book_id, chapter_id, title, page_start, content to numbered chunks."""
    each = chapters.select("book_id", "chapter_id", F.col("title").alias("chapter"), F.col("page_start").alias("page"), F.posexplode(split_text(F.col("content"), config.chunk_size, config.overlap)).alias("i", "text"))
    name = F.format_string("%s_%s_%04d", "book_id", "chapter_id", F.col("i") + 1)
    return each.select(name.alias("chunk_id"), "book_id", "chapter_id", "chapter", "page", "text", F.length("text").cast("long").alias("char_count"), (F.col("i") + 1).cast("long").alias("chunk_ord"))


def write_index(chunks: DataFrame, path: str, at: Column | None = None) -> None:
    """Writes the chunks as the new state at ``path``, with the time at which they were indexed (now). The time is a table of the same state, so it also stands where there is no chunk."""
    spark = chunks.sparkSession
    write_tables({"chunks": chunks, "indexed": spark.range(1).select((F.current_timestamp() if at is None else at).alias("indexed_at"))}, path)


def index_status(spark: SparkSession, path: str) -> DataFrame:
    """One row of book_count, chunk_count, indexed_at; the last is null where nothing was indexed."""
    state = read_tables(spark, path, ["chunks", "indexed"], {"chunks": {"book_id": ("string", None)}, "indexed": {"indexed_at": ("timestamp", None)}})
    counts = state["chunks"].agg(F.countDistinct("book_id").alias("book_count"), F.count(F.lit(1)).alias("chunk_count"))
    one = lambda row: row.withColumn("one", F.lit(1))
    return one(counts).join(one(state["indexed"].agg(F.max("indexed_at").alias("indexed_at"))), "one").drop("one")
