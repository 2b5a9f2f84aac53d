"""Chapters to the nodes and edges of each book's graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.functions.text import normalize_graph_text, normalize_name
from tomeweave.operators import relations as R
from tomeweave.operators import terms as K
from tomeweave.operators.integrate import first_edges, surviving_edges
from tomeweave.operators.retrieval import spread


def with_graph_text(chapters: DataFrame) -> DataFrame:
    return spread(chapters, "chapter_id").withColumn("graph_text", normalize_graph_text(F.col("content")))


def chapter_nodes(chapters: DataFrame) -> DataFrame:
    """The ten best candidates of each chapter (book_id, chapter_id, chapter_ord, title, page_start, content) as nodes."""
    return nodes_of(K.chapter_candidates(with_graph_text(chapters)), chapters)


def nodes_of(found: DataFrame, chapters: DataFrame) -> DataFrame:
    """Candidates to nodes: each name of a chapter once, the ten best of them."""
    best = K.rank_candidates(K.dedupe_candidates(found))
    joined = best.join(chapters.select("book_id", "chapter_id", "chapter_ord", "title", "page_start"), ["book_id", "chapter_id"])
    stock = F.concat("name", F.lit(" 是 "), "title", F.lit(" 中反复出现的核心知识点。"))
    text = F.substring("source_text", 1, 220)
    return joined.select(
        F.concat(F.lit("node_"), F.substring(F.sha1(F.concat_ws(":", "book_id", "chapter_id", "name")), 1, 10)).alias("node_id"), "book_id", "chapter_id", "name",
        F.when(text == "", stock).otherwise(text).alias("definition"), F.lit("核心概念").alias("category"), F.col("title").alias("chapter"), F.col("page_start").alias("page"),
        F.substring("source_text", 1, 260).alias("source_text"), F.col("quality").alias("quality_score"), F.col("method").alias("extraction_method"), "warnings",
        (F.col("chapter_ord") * 16 + F.col("rank")).alias("node_ord"),
    )


def book_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each name in a book."""
    nth = F.row_number().over(Window.partitionBy("book_id", normalize_name(F.col("name"))).orderBy("node_ord"))
    return nodes.withColumn("nth", nth).filter("nth = 1").drop("nth")


def book_edges(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Relations within chapters whose ends were kept, each once, and more of other types for books that lack them."""
    inside = surviving_edges(R.chapter_edges(nodes), kept)
    return first_edges(R.enrich_relations(kept, first_edges(inside).select("book_id", "source", "target", "relation_type", "description", "edge_ord")))
