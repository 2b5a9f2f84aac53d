"""The integration report as tables and as Markdown lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave.operators.graph_stats import RELATIONS

EXAMPLES, AFFECTED_SHOWN = 5, 4


def overview(stats: DataFrame, books: int, graphs: int, target: float = 0.3) -> DataFrame:
    return stats.select(
        F.lit(books).cast("long").alias("book_count"), F.lit(graphs).cast("long").alias("graph_count"), "original_chars", "integrated_chars", "compression_ratio", (F.col("compression_ratio") <= target).alias("target_met")
    )


def by_book(books: DataFrame, chapters: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per book its chapters, pages and characters, and its nodes and edges (null without a graph)."""
    counted = nodes.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    linked = nodes.select("book_id", F.col("node_id").alias("source")).join(edges.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source").groupBy("book_id").agg(F.sum("n").alias("n_edges"))
    summed = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.max("page_end").alias("n_pages"), F.sum("char_count").alias("n_chars"))
    graph = counted.join(linked, "book_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return books.select("book_id").distinct().join(summed, "book_id", "left").join(graph, "book_id", "left")


def decision_summary(decided: DataFrame) -> DataFrame:
    return decided.groupBy("action", "status").agg(F.count(F.lit(1)).alias("n"))


def _shown(prefix: str) -> Column:
    part = lambda c: F.col(prefix + c).cast("string")
    return F.concat(part("name"), F.lit("（"), part("book_title"), F.lit("，"), part("chapter"), F.lit("，第 "), part("page"), F.lit(" 页）"))


def example_decisions(decided: DataFrame, mapping: DataFrame, original: DataFrame, integrated: DataFrame) -> DataFrame:
    """The first merges (else the first decisions), with up to four affected nodes and the result in words."""
    merges = decided.filter("action = 'merge'").orderBy("decision_ord").limit(EXAMPLES)
    first = merges if not merges.isEmpty() else decided.orderBy("decision_ord").limit(EXAMPLES)
    first = first.select("decision_id", "decision_ord", "action", "result_node", "confidence")
    named = ["node_id", "name", "book_title", "chapter", "page"]
    affected = mapping.join(F.broadcast(first), F.col("integrated_id") == F.col("result_node")).select("decision_id", "node_id")  # five rows
    affected = affected.join(original.select(*named, "node_ord"), "node_id", "left")
    nth = F.row_number().over(Window.partitionBy("decision_id").orderBy("node_ord"))
    shown = affected.withColumn("nth", nth).filter(F.col("nth") <= AFFECTED_SHOWN).withColumn("text", F.coalesce(_shown(""), "node_id"))
    texts = shown.groupBy("decision_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "；").alias("affected"))
    results = integrated.select(F.col("node_id").alias("result_node"), _shown("").alias("result"))
    return first.join(texts, "decision_id", "left").join(results, "result_node", "left").select(
        "decision_id", "action", "affected", F.coalesce("result", "result_node", F.lit("-")).alias("result"), "confidence"
    )


def render(one: DataFrame, summary: DataFrame, relations: DataFrame, quality: DataFrame, examples: DataFrame) -> DataFrame:
    """The report's Markdown lines (line_no, line), each made from the one row of its table; examples follow by decision."""

    def placed(rows: DataFrame, lines: dict[int, Column]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(k).alias("line_no"), line.alias("line")) for k, line in lines.items()))
        return rows.select(F.inline(each))

    said = lambda words, value, end="": F.concat(F.lit(words), value.cast("string"), F.lit(end))
    fixed = {0: "# 教材知识整合报告", 1: "", 2: "## 整合概览", 3: "", 10: "", 11: "## 整合决策摘要", 12: "", 18: "", 19: "## 知识图谱统计", 20: "", 23: "", 24: "## 重点整合案例", 25: ""}
    head = placed(one, {
        **{k: F.lit(line) for k, line in fixed.items()},
        4: said("- 原始教材数量：", F.col("book_count")), 5: said("- 已构建图谱教材数：", F.col("graph_count")), 6: said("- 原始总字数：", F.col("original_chars")), 7: said("- 整合后字数：", F.col("integrated_chars")),
        8: F.format_string("- 压缩比：%.2f%%", F.col("compression_ratio") * 100), 9: F.concat(F.lit("- 压缩目标：不超过 30%，当前"), F.when(F.col("target_met"), "满足").otherwise("未满足"), F.lit("目标")),
    })
    of = lambda c, value: F.coalesce(F.sum(F.when(F.col(c) == value, F.col("n"))), F.lit(0)).alias(value)
    counted = summary.agg(*(of("action", x) for x in ("merge", "keep", "remove")), *(of("status", x) for x in ("active", "overridden")))
    words = {13: ("合并", "merge"), 14: ("保留", "keep"), 15: ("删除", "remove"), 16: ("有效决策", "active"), 17: ("教师覆盖", "overridden")}
    decided = placed(counted, {k: said(f"- {word}：", F.col(c), " 项") for k, (word, c) in words.items()})
    place = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation_type"))
    kinds = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.concat_ws(" ", "relation_type", F.col("n").cast("string")).alias("x"))))
    linked = relations.filter(place > 0).agg(F.array_join(F.transform(kinds, lambda k: k["x"]), "，").alias("x"))
    shares = placed(linked, {22: F.concat(F.lit("- 关系类型分布："), F.when(F.col("x") == "", "无").otherwise(F.col("x")))})
    graded = placed(quality, {21: F.format_string("- 平均节点质量分：%.3f", "avg_quality")})
    number = F.row_number().over(Window.orderBy("decision_id"))  # five rows
    shown = examples.withColumn("k", number).select((F.col("k") + 25).alias("line_no"), F.format_string("%d. **%s** `%s`：%s → %s，置信度 %.2f", "k", "action", "decision_id", "affected", "result", "confidence").alias("line"))
    return head.unionByName(decided).unionByName(graded).unionByName(shares).unionByName(shown)
