"""Documents that arrive later are parsed and chunked as they come.

Chapters that are ready are chunked by a stateless query. Documents are parsed inside the stream: each micro-batch is a table of whole
documents, which the jobs for tables split into sections and chunks; its rows go to a folder named by the
batch, written as a whole, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tomeweave.operators.chapters import split_sections
from tomeweave.operators.chunks import RetrievalConfig, build_chunks
from tomeweave.sources.files import completed, isolate_failures


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Chapter rows from Parquet files that appear at ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_chunks(chapters: DataFrame, target: str, checkpoint: str, config: RetrievalConfig) -> StreamingQuery:
    """Appends the chunks of all chapters that have arrived, once each, and ends. Stateless: no watermark is needed."""
    return build_chunks(chapters, config).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def append_documents(documents: DataFrame, target: str, quarantined: str, checkpoint: str, config: RetrievalConfig, markdown: bool = True) -> StreamingQuery:
    """Chunks of all documents (book_id, title, text) that have arrived, to ``target``/batch=n; those without text to ``quarantined``/batch=n. Ends when all are read."""

    def parse(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, target, quarantined, config, markdown)

    return documents.writeStream.foreachBatch(parse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, number: int, target: str, quarantined: str, config: RetrievalConfig, markdown: bool) -> None:
    """One micro-batch; running it again changes nothing."""
    books = isolate_failures(batch, "text")
    books.filter("status = 'failed'").drop("text").write.mode("overwrite").parquet(f"{quarantined}/batch={number}")
    chunks = build_chunks(split_sections(completed(books), markdown), config)
    chunks.write.mode("overwrite").parquet(f"{target}/batch={number}")
