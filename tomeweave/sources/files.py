"""Files to books and tables to files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomeweave.functions import text as T

MARKDOWN, PLAIN = (".md", ".markdown"), (".txt",)
#: Formats whose bytes are parsed elsewhere; their text arrives as pages.
BY_PAGES = (".pdf", ".docx")


def flag_unsupported(files: DataFrame, filename: str = "filename") -> DataFrame:
    """``files`` with suffix, status and error: a format that nothing reads is ``failed`` and goes no further."""
    kind = T.suffix(F.col(filename))
    known = kind.isin(*MARKDOWN, *PLAIN, *BY_PAGES)
    return files.withColumns(
        {"suffix": kind, "status": F.when(known, "pending").otherwise("failed"), "error": F.when(~known, F.concat(F.lit("Unsupported file type: "), kind))}
    )


def isolate_failures(books: DataFrame, content: str = "content") -> DataFrame:
    """``books`` with status and error: a book without content fails alone; later jobs take the completed ones."""
    empty = F.coalesce(T.strip(F.col(content)), F.lit("")) == ""
    return books.withColumns({"status": F.when(empty, "failed").otherwise("completed"), "error": F.when(empty, "no text")})


def parsed(rows: DataFrame, parser: Callable[[str], str | None], content: str = "content", value: str = "value") -> DataFrame:
    """``rows`` with ``value``, status and error: what ``parser`` makes of each content. Where it raises, only that row fails, with its message.

    A parser that returns nothing, or only blanks, has found no text.
    """

    @F.pandas_udf("struct<value: string, error: string>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for text in batch:
                try:
                    out.append((parser(text) if text is not None else None, None))
                except Exception as error:  # noqa: BLE001 - whatever a parser raises is the row's own failure
                    out.append((None, str(error) or type(error).__name__))
            yield pd.DataFrame(out, columns=["value", "error"], dtype=object)

    read = rows.withColumn("_read", run(F.col(content)))
    error = F.coalesce(F.col("_read.error"), F.when(F.coalesce(T.strip(F.col("_read.value")), F.lit("")) == "", "no text"))
    return read.withColumns({value: F.when(error.isNull(), F.col("_read.value")), "error": error, "status": F.when(error.isNull(), "completed").otherwise("failed")}).drop("_read")


def quarantine(rows: DataFrame, path: str) -> DataFrame:
    """Writes the failed rows to the table at ``path``, each with its error, and returns the completed ones."""
    rows.filter("status = 'failed'").write.mode("append").parquet(path)
    return completed(rows)


def completed(books: DataFrame) -> DataFrame:
    return books.filter("status = 'completed'")


def _decoded(content: Column) -> Column:
    """Bytes as text without those that are no UTF-8. A U+FFFD of the text's own is written otherwise while they are dropped, so it stays."""
    own = F.replace(F.replace(content, F.lit("\0"), F.lit("\0a")), F.lit("\ufffd"), F.lit("\0b"))
    kept = F.replace(F.make_valid_utf8(own), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(kept, F.lit("\0b"), F.lit("\ufffd")), F.lit("\0a"), F.lit("\0"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """book_id, filename, title, suffix, text of every text and Markdown file; bytes that are no UTF-8 are dropped.

    Raises where a file of another kind lies at the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    flagged = flag_unsupported(files.select("path", "filename", "content"))
    wrong = flagged.filter(~F.col("suffix").isin(*MARKDOWN, *PLAIN)).select("filename").limit(5).collect()
    if wrong:
        raise ValueError(f"unsupported files: {[r.filename for r in wrong]}")
    text = _decoded(F.col("content").cast("string"))
    return flagged.select(F.sha1("path").substr(1, 10).alias("book_id"), "filename", T.infer_title(F.col("filename")).alias("title"), "suffix", text.alias("text"))


def read_lines(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """path, book_id, filename, title, suffix, pos, line of text and Markdown files of any size: no file is one value.

    A split of a file reads its lines in order. Each line knows its file, the split's start and its place among the
    rows of its task; places in the file are the line's number in its split and the sum of the splits before it. Bytes that are no
    UTF-8 are dropped. An empty file has no line. ``end`` is what ends a line; where none is named, each of LF, CR and CR LF.
    A byte order mark at a file's start is no text.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path, lineSep=end).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    kind = T.suffix(F.element_at(F.split("path", "/"), -1))
    wrong = rows.filter(~kind.isin(*MARKDOWN, *PLAIN)).select("path").limit(1).collect()
    if wrong:
        raise ValueError(f"unsupported files: {[r['path'].rsplit('/', 1)[-1] for r in wrong]}")
    # A task may read several splits, whose rows stand one after the other in it.
    splits = rows.groupBy("path", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    line = _decoded(F.col("value"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.join(splits, ["path", "block"]).select(
        "path", F.sha1("path").substr(1, 10).alias("book_id"), name.alias("filename"), T.infer_title(name).alias("title"), T.suffix(name).alias("suffix"), (F.col("row") + F.col("shift")).alias("pos"), line.alias("line")
    )


def write_tables(tables: dict[str, DataFrame], path: str) -> str:
    """Each table as Parquet in a new snapshot below ``path``, by book where it has one; returns the snapshot's name.

    Readers go by the manifest of the highest version, a single file that is written last: until then, and if
    a write dies on its way, the old state is what they see.
    """
    name, spark = uuid.uuid4().hex, next(iter(tables.values())).sparkSession
    for table_name, table in tables.items():
        writer = table.write
        (writer.partitionBy("book_id") if "book_id" in table.columns else writer).parquet(f"{path}/snapshots/{name}/{table_name}")
    last = _manifest(spark, path)
    row = (last["version"] + 1 if last else 1, name, sorted(tables), {t: table.schema.json() for t, table in tables.items()})
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return name


#: The schemas keep the types of partition columns, and the columns of tables without rows.
_MANIFEST = "version long, snapshot string, tables array<string>, schemas map<string,string>"


def _manifest(spark: SparkSession, path: str) -> Row | None:
    """The newest state, if there is any; of two writers of one version the one whose snapshot's name is last."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{path}/manifests").orderBy(F.desc("version"), F.desc("snapshot")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_tables(spark: SparkSession, path: str, names: list[str], defaults: dict[str, dict[str, tuple[str, object]]] | None = None) -> dict[str, DataFrame]:
    """The tables of the newest state. ``defaults`` gives a table's columns with type and value: a column that the state lacks has that value, a table that it lacks is empty."""
    state, out = _manifest(spark, path), {}
    for name in names:
        columns = (defaults or {}).get(name, {})
        if state and name in state["tables"]:
            schema = (state["schemas"] or {}).get(name)
            reader = spark.read.schema(StructType.fromJson(json.loads(schema))) if schema else spark.read
            table = reader.parquet(f"{path}/snapshots/{state['snapshot']}/{name}")
            out[name] = table.withColumns({c: F.lit(value).cast(kind) for c, (kind, value) in columns.items() if c not in table.columns})
        elif columns:
            out[name] = spark.createDataFrame([], ", ".join(f"`{c}` {kind}" for c, (kind, _) in columns.items()))
        else:
            raise ValueError(f"no table {name} at {path}, and no defaults for it")
    return out


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def remove_book(tables: dict[str, DataFrame], book_id: str) -> dict[str, DataFrame]:
    """The tables without a book: its rows, and the edges of its ``nodes``. What was integrated from it is integrated again from these (``run_integration``)."""
    left = {name: table.filter(F.col("book_id") != book_id) if "book_id" in table.columns else table for name, table in tables.items()}
    if "nodes" in left and "edges" in left and "book_id" not in left["edges"].columns:
        ids = left["nodes"].select("node_id")
        for end in ("source", "target"):
            left["edges"] = left["edges"].join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return left
