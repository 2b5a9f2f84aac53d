"""Measures of node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORE = "核心"
RELATIONS = ("prerequisite", "contains", "applies_to", "parallel")


def graph_quality(nodes: DataFrame) -> DataFrame:
    """Per book the mean quality, the warnings, and the nodes by extraction method as rows' map."""
    by_method = nodes.groupBy("book_id", "extraction_method").agg(F.count(F.lit(1)).alias("n"), F.sum("quality_score").alias("q"), F.sum(F.size("warnings")).alias("w"))
    return by_method.groupBy("book_id").agg(
        F.round(F.sum("q") / F.sum("n"), 3).alias("avg_quality"), F.sum("w").alias("warning_count"), F.sort_array(F.collect_list(F.concat_ws("=", "extraction_method", F.col("n").cast("string")))).alias("methods")
    )


def node_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def node_importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree, score, normalized and size (12 to 60).

    The range of the scores is one aggregate row; ranks are only made where all scores are equal.
    """
    depth = lambda c, most: F.least(F.lit(float(most)), F.log2(F.length(c) + 8))
    joined = nodes.join(node_degree(edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    quality = F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.coalesce("quality_score", F.lit(1.0))))
    core = F.when(F.col("category").contains(CORE), 3.0).otherwise(0.0)
    raw = F.col("degree") * 10 + F.log2(F.greatest(F.lit(1), F.coalesce("frequency", F.lit(1))) + 1) * 14 + depth("definition", 8) * 2.2 + depth("source_text", 6) + core
    scored = joined.select("node_id", "node_ord", "degree", (raw * quality - F.size("warnings") * 5).alias("score"))
    low, high, n = scored.agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    if not n:
        normalized = F.lit(0.5)
    elif high - low > 0.001:
        normalized = (F.col("score") - F.lit(low)) / F.lit(high - low)
    elif n == 1:
        normalized = F.lit(0.5)
    else:
        normalized = (F.row_number().over(Window.orderBy("score", "node_ord")) - 1) / F.lit(n - 1)
    return scored.withColumn("normalized", normalized).select(
        "node_id", "degree", "score", "normalized", F.floor(F.lit(12) + F.pow("normalized", F.lit(0.72)) * 48 + 0.5).cast("long").alias("size")
    )


def containment_groups(edges: DataFrame, groups: int = 10, children: int = 18) -> DataFrame:
    """The parents with the most children (two at least), each with its first children by edge order."""
    inside = edges.filter("relation_type = 'contains'")
    parents = inside.groupBy("source").agg(F.count(F.lit(1)).alias("n_children"), F.min("edge_ord").alias("first")).filter("n_children >= 2")
    top = parents.orderBy(F.desc("n_children"), "first", "source").limit(groups)
    mine = inside.join(top, "source")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("edge_ord", "target"))
    return mine.withColumn("nth", nth).filter(F.col("nth") <= children).select(F.col("source").alias("parent"), "n_children", F.col("nth").cast("long").alias("nth"), F.col("target").alias("child"))


def relation_distribution(edges: DataFrame) -> DataFrame:
    position = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation_type"))
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n")).filter(position > 0).select("relation_type", "n", position.alias("position"))


def average_quality(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"))
