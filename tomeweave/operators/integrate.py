"""Nodes of all books to one set: groups, merged nodes, decisions, remapped edges, statistics, trimming.

A group is a key on its nodes, never an array of all its members: a name that every book uses may
hold a large share of all nodes. Members are rows of the node map, and group texts are chosen by max_by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave import lexicon
from tomeweave.functions.text import merge_key
from tomeweave.operators.dictionary import dictionary_join
from tomeweave.operators.lineage import cut
from tomeweave.operators.simjoin import clusters

TARGET_RATIO = 0.3
CHARS_PER_KEPT = 40
SOURCES_NAMED = 4


def exact_name_groups(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``group_key`` (of the name) and ``group_size``. Counts are aggregated before they are joined back."""
    keyed = nodes.withColumn("group_key", merge_key(F.col("name")))
    return keyed.join(keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("group_size")), "group_key")


def with_clusters(grouped: DataFrame, leaders: DataFrame) -> DataFrame:
    """Singletons take their leader's key (node_id, leader_id); groups by name stay."""
    key = leaders.select("node_id", F.concat(F.lit("leader:"), "leader_id").alias("cluster"))
    joined = grouped.drop("group_size").join(key, "node_id", "left").withColumn("group_key", F.coalesce("cluster", "group_key")).drop("cluster")
    return joined.join(joined.groupBy("group_key").agg(F.count(F.lit(1)).alias("group_size")), "group_key")


def similar_groups(nodes: DataFrame) -> DataFrame:
    """Groups by exact name; the singletons left are clustered by similar name and definition. The rows are kept, as all that follows reads them more than once."""
    grouped = cut(exact_name_groups(nodes))
    single = grouped.filter("group_size = 1").drop("group_key", "group_size")
    return grouped if single.isEmpty() else cut(with_clusters(grouped, clusters(single)))


def _first_longest(value: str, length: Column) -> Column:
    return F.max_by(value, F.struct(length, -F.col("node_ord")))


def result_id(group_key: Column) -> Column:
    return F.concat(F.lit("merged_"), F.substring(F.sha1(group_key), 1, 10))


def merge_nodes(grouped: DataFrame) -> DataFrame:
    """One node per group: of several, the one with the longest texts, the longest definition and its sources."""
    size, own = F.length("definition"), F.length("definition") + F.length("source_text")
    best = [_first_longest(c, own).alias(c) for c in ("name", "source_text", "book_id", "book_title", "chapter", "page", "category", "quality_score")]
    merged = grouped.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("frequency"), F.min("node_ord").alias("node_ord"), F.min_by("node_id", "node_ord").alias("first_id"), _first_longest("definition", size).alias("definition"), *best
    )
    titles = grouped.select("group_key", "book_title").distinct()
    titles = titles.withColumn("n", F.row_number().over(Window.partitionBy("group_key").orderBy("book_title"))).filter(F.col("n") <= SOURCES_NAMED)
    named = titles.groupBy("group_key").agg(F.array_join(F.array_sort(F.collect_list("book_title")), "；").alias("sources"))
    several = F.col("frequency") > 1
    text = F.concat("definition", F.lit("（整合来源："), "sources", F.lit("）"))
    return merged.join(named, "group_key").select(
        F.when(several, result_id(F.col("group_key"))).otherwise(F.col("first_id")).alias("node_id"), "group_key", "node_ord", "frequency", "name",
        F.when(several, text).otherwise(F.col("definition")).alias("definition"), *[c for c in ("source_text", "book_id", "book_title", "chapter", "page", "category", "quality_score")],
    )


def decisions(merged: DataFrame) -> DataFrame:
    """One decision per group; ``n_affected`` counts its rows in the node map. Groups by name come before clusters."""
    several = F.col("frequency") > 1
    reason = F.when(
        several, F.concat(F.col("frequency").cast("string"), F.lit(" 本/处教材知识点语义相近，保留“"), "book_title", F.lit("”中更完整的表述。"))
    ).otherwise(F.concat(F.lit("“"), "name", F.lit("”未发现高置信重复知识点，保留以维持教学完整性。")))
    action = F.when(several, "merge").otherwise("keep")
    return merged.select(
        F.concat(action, F.lit("_"), F.substring(F.sha1("group_key"), 1, 8)).alias("decision_id"), action.alias("action"), F.col("node_id").alias("result_node"),
        F.col("frequency").alias("n_affected"), reason.alias("reason"),
        F.when(several, F.least(F.lit(0.96), F.lit(0.72) + F.lit(0.04) * F.col("frequency"))).otherwise(F.lit(0.7)).alias("confidence"),
        F.lit("active").alias("status"), F.col("node_ord").alias("decision_ord"),
    )


def node_map(grouped: DataFrame) -> DataFrame:
    """Original node_id to integrated_id."""
    return grouped.select("node_id", F.when(F.col("group_size") > 1, result_id(F.col("group_key"))).otherwise(F.col("node_id")).alias("integrated_id"))


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each source, target and relation type."""
    rest = [c for c in edges.columns if c not in ("source", "target", "relation_type", "edge_ord")]
    return edges.groupBy("source", "target", "relation_type").agg(F.min("edge_ord").alias("edge_ord"), *(F.min_by(c, "edge_ord").alias(c) for c in rest))


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between integrated nodes; ends without a node, loops and repeated edges go.

    Each edge is dealt out once for either end and aggregated where it then lies. Few edges share both ends before
    they are mapped, so making these one first would deal out all of them once more.
    """
    at = lambda end: mapping.select(F.col("node_id").alias(end), F.col("integrated_id").alias("new_" + end))
    joined = edges.join(at("source"), "source").join(at("target"), "target").filter("new_source <> new_target")
    return first_edges(joined.drop("source", "target").withColumnsRenamed({"new_source": "source", "new_target": "target"}))


def surviving_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("node_id"))
    return edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")


def stats(original_nodes: DataFrame, original_edges: DataFrame, nodes: DataFrame, edges: DataFrame, decided: DataFrame, original_chars: int) -> DataFrame:
    """One row of totals. Each part is one aggregate row."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    active = lambda action: F.count(F.when((F.col("action") == action) & (F.col("status") == "active"), 1)).alias(f"{action}_count")
    parts = [
        nodes.agg(F.count(F.lit(1)).alias("integrated_nodes"), F.coalesce(F.sum(F.length("definition").cast("long")), F.lit(0)).alias("integrated_chars")),
        count(original_nodes, "original_nodes"), count(original_edges, "original_edges"), count(edges, "integrated_edges"),
        decided.agg(*map(active, ("merge", "keep", "remove"))),
    ]
    one = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        one = one.join(part.withColumn("one", F.lit(1)), "one")
    ratio = F.round(F.col("integrated_chars") / F.lit(original_chars), 4) if original_chars else F.lit(0.0)
    return one.drop("one").withColumns({"original_chars": F.lit(original_chars).cast("long"), "compression_ratio": ratio})


def running_chars(nodes: DataFrame, parts: int = 1024) -> DataFrame:
    """``nodes`` with ``place`` (from 0) and ``before`` (characters of all nodes before) in the order of frequency and definition length.

    The order is total over all nodes. It is cut into ranges by its leading value and a hash-free rank: range totals
    are summed first, then running sums inside a range complete them.
    """
    size = F.length("definition").cast("long")
    keyed = nodes.withColumns({"len": size, "range": F.concat_ws(":", F.lpad(F.col("frequency").cast("string"), 19, "0"), F.lpad(size.cast("string"), 10, "0"), F.lpad(F.floor(F.col("node_ord") / parts).cast("string"), 19, "0"))})
    ranges = keyed.groupBy("range").agg(F.count(F.lit(1)).alias("range_n"), F.sum("len").alias("range_len"))
    # Coarse ranges (frequency and length) are few; the fine ones are summed within each of them.
    coarse = ranges.withColumn("coarse", F.substring_index("range", ":", 2))
    before = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    tops = coarse.groupBy("coarse").agg(F.sum("range_n").alias("n"), F.sum("range_len").alias("l"))
    tops = tops.select("coarse", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("top_n"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("top_l"))
    fine = Window.partitionBy("coarse").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.join(tops, "coarse").select(
        "range", (F.col("top_n") + F.coalesce(F.sum("range_n").over(fine), F.lit(0))).alias("offset_n"), (F.col("top_l") + F.coalesce(F.sum("range_len").over(fine), F.lit(0))).alias("offset_l")
    )
    inner = Window.partitionBy("range").orderBy("node_ord", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(offsets, "range")
    return joined.withColumns(
        {"place": F.col("offset_n") + F.count(F.lit(1)).over(inner), "before": F.col("offset_l") + F.coalesce(F.sum("len").over(inner), F.lit(0))}
    ).drop("range", "offset_n", "offset_l", "len")


def trim_to_compression(nodes: DataFrame, original_chars: int, ratio: float = TARGET_RATIO) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): nodes leave from the rare and short end until the target is met; if it still is not, definitions are cut.

    Nothing happens while the rounded ratio is within the target.
    """
    total, n = nodes.agg(F.coalesce(F.sum(F.length("definition").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    none = nodes.limit(0)
    target = int(original_chars * ratio)
    if not original_chars or round(total / original_chars, 4) <= ratio or total <= target:
        return nodes, none
    least = max(1, min(n, target // CHARS_PER_KEPT)) if target else 1
    placed = running_chars(nodes)
    leaves = (F.col("place") < n - least) & (F.lit(total) - F.col("before") > target)
    removed = placed.filter(leaves).drop("place", "before")
    kept = placed.filter(~leaves).drop("place", "before")
    left_chars, left = kept.agg(F.coalesce(F.sum(F.length("definition").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    if left_chars > target and left:
        each = max(1, target // left) if target else 1
        kept = kept.withColumn("definition", F.substring("definition", 1, each))
    return kept, removed


def remove_decisions(removed: DataFrame) -> DataFrame:
    return removed.select(
        F.concat(F.lit("remove_"), F.substring(F.sha1("node_id"), 1, 8)).alias("decision_id"), F.lit("remove").alias("action"), F.lit(None).cast("string").alias("result_node"),
        F.lit(1).cast("long").alias("n_affected"), F.concat(F.lit("为满足 30% 压缩比，删除低频知识点“"), "name", F.lit("”的冗余摘要；原始来源仍可通过 RAG 检索。")).alias("reason"),
        F.lit(0.68).alias("confidence"), F.lit("active").alias("status"), F.col("node_ord").alias("decision_ord"),
    )


@dataclass(frozen=True)
class Integration:
    """What the whole job leaves; ``node_map`` still knows the nodes that were trimmed."""

    nodes: DataFrame
    edges: DataFrame
    decisions: DataFrame
    node_map: DataFrame
    stats: DataFrame


def run_integration(nodes: DataFrame, edges: DataFrame, original_chars: int, ratio: float = TARGET_RATIO) -> Integration:
    """Groups by name, clusters of similar singletons, merged nodes, decisions, remapped edges; then trimming where the texts are still too long."""
    grouped = similar_groups(nodes)
    merged, mapping = cut(merge_nodes(grouped)), node_map(grouped)
    decided, links = decisions(merged), cut(remap_edges(edges, mapping))
    kept, removed = trim_to_compression(merged, original_chars, ratio)
    if not removed.isEmpty():
        decided = decided.unionByName(remove_decisions(removed))
        links = surviving_edges(links, kept)
    return Integration(kept, links, decided, mapping, stats(nodes, edges, kept, links, decided, original_chars))


def apply_feedback(decided: DataFrame, nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Decisions after teachers' messages (msg_ord, message): one that names a decision's result node overrides it.

    Of several, the last message counts, and its split rule before its keep rule. Only messages with such words
    are matched, and a name is looked for once however many decisions there are.
    """
    has = lambda words, c: F.lit(False) if not words else c.rlike("|".join(words))
    asks = messages.withColumns({"keep": has(lexicon.KEEP_WORDS, F.col("message")) | F.lower("message").contains("keep"), "split": has(lexicon.SPLIT_WORDS, F.col("message"))}).filter("keep OR split")
    names = decided.join(nodes.select(F.col("node_id").alias("result_node"), "name"), "result_node").filter("name <> ''").select("decision_id", "name")
    hits = dictionary_join(asks, "message", names)
    rule = F.when(F.col("split"), F.concat(F.lit("教师反馈要求拆分该整合决策："), "message")).otherwise(F.concat(F.lit("教师反馈要求保留相关知识点："), "message"))
    said = names.join(hits, "name").groupBy("decision_id").agg(F.max_by(rule, "msg_ord").alias("said"))
    return decided.join(said, "decision_id", "left").withColumns(
        {"status": F.when(F.col("said").isNotNull(), "overridden").otherwise(F.col("status")), "reason": F.coalesce("said", "reason")}
    ).drop("said")
