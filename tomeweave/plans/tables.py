"""The given tables in the roles of the library's own: books, chapters, questions, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.functions.text import CJK, join_cjk
from tomeweave.operators.retrieval import spread

#: Latin letter groups and the Chinese terms that stand for them, in this order, so that jobs on Chinese text have input.
PROJECTION = (
    ("tion", "系统"), ("and", "和"), ("the", "红细胞"), ("that", "白细胞"), ("with", "由"), ("ing", "激素"), ("ent", "受体"),
    ("for", "包括"), ("is", "是"), ("ere", "参与"), ("er", "神经"), ("on", "动脉"), ("or", "通道"), ("re", "肾"), ("th", "肝"),
    ("nd", "心"), ("st", "腺"), ("sh", "胞"), ("ea", "血"), ("in", "内"), (".", "。"), (",", "，"),
)


def projected(c: Column) -> Column:
    c = F.lower(c)
    for a, b in PROJECTION:
        c = F.replace(c, F.lit(a), F.lit(b))
    return join_cjk(F.regexp_replace(c, "[a-z]", ""))


def projected_sql(c: str) -> str:
    c = f"lower({c})"
    for a, b in PROJECTION:
        c = f"replace({c}, '{a}', '{b}')"
    return cjk_sql(f"regexp_replace({c}, '[a-z]', '', 'g')")


def cjk_sql(c: str) -> str:
    """Blanks between CJK characters deleted; twice, as matches of this dialect cannot overlap."""
    one = rf"regexp_replace(%s, '([{CJK}])\s+([{CJK}])', '\1\2', 'g')"
    return one % (one % c)


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str, chinese: bool = False) -> DataFrame:
    """A source is a book, a document is one of its chapters."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    if chinese:  # a small file is one task, and letters are replaced in many passes
        docs = spread(docs, "doc_id")
    return docs.select(
        F.col("source").alias("book_id"),
        F.concat(F.lit("ch_"), F.col("doc_id").cast("string")).alias("chapter_id"),
        F.col("doc_id").alias("chapter_ord"),
        F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")).alias("title"),
        (F.col("doc_id") % 60 + 1).alias("page_start"),
        (F.col("doc_id") % 60 + 2).alias("page_end"),
        (projected(text) if chinese else text).alias("content"),
    )


def chapters_sql(chinese: bool = False) -> str:
    text = "coalesce(text, '')"
    return f"""SELECT source AS book_id, 'ch_' || doc_id AS chapter_id, doc_id AS chapter_ord, 'Chapter ' || doc_id AS title,
  doc_id % 60 + 1 AS page_start, doc_id % 60 + 2 AS page_end, {projected_sql(text) if chinese else text} AS content FROM documents"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the raw pages, numbered."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line_no", "line"))


LINES_SQL = "SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(len(string_split(html, chr(10)))))::INTEGER AS line_no FROM pages"
