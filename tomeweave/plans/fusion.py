"""Queries: node and edge tables, integration, report. Parts are nodes, brands their books, line items edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave import lexicon
from tomeweave.functions.text import normalize_name
from tomeweave.operators import graph_stats as G
from tomeweave.operators import integrate as I
from tomeweave.operators import report as R
from tomeweave.operators.knowledge import book_nodes
from tomeweave.plans.retrieval import index_sql
from tomeweave.plans.tables import projected, projected_sql, table
from tomeweave.sources.files import remove_book
from tomeweave.registry import ORACLE_SQL, query

_RELATION = ("prerequisite", "contains", "applies_to", "parallel")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    method = F.element_at(F.array(*map(F.lit, ("definition_sentence", "term_annotation", "heading", "frequency_term"))), F.col("p_size") % 4 + 1)
    # One part in 25 has a name of its own: these are the nodes that only similar ones can join.
    name = F.when(F.col("p_partkey") % 25 == 0, F.concat("p_name", F.lit(" n"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_partkey").alias("node_ord"), name.alias("name"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("definition"), F.repeat("p_type", F.col("p_size") % 3).alias("source_text"),
        F.col("p_brand").alias("book_id"), F.col("p_brand").alias("book_title"), F.col("p_type").alias("chapter"), F.col("p_size").alias("page"), F.lit("核心概念").alias("category"),
        (F.lit(0.5) + (F.col("p_size") % 50) / F.lit(100.0)).alias("quality_score"), method.alias("extraction_method"),
        F.when(F.col("p_size") % 10 == 0, F.array(F.lit("not_in_source"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.lit(1).alias("frequency"),
    )


NODES = """SELECT *, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM (SELECT 'p' || p_partkey AS node_id, p_partkey AS node_ord, CASE WHEN p_partkey % 25 = 0 THEN p_name || ' n' || p_partkey ELSE p_name END AS name, p_name || ' ' || p_type || ' ' || p_brand AS definition, repeat(p_type, p_size % 3) AS source_text, p_brand AS book_id, p_brand AS book_title,
  p_type AS chapter, p_size AS page, '核心概念' AS category, 0.5::DOUBLE + (p_size % 50) / 100.0::DOUBLE AS quality_score,
  ['definition_sentence', 'term_annotation', 'heading', 'frequency_term'][p_size % 4 + 1] AS extraction_method, CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS warnings FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    end = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, _RELATION)), F.col("l_linenumber") % 4 + 1)
    return li.select(end("l_partkey").alias("source"), end("l_suppkey").alias("target"), kind.alias("relation_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_ord"))


EDGES = "SELECT 'p' || l_partkey AS source, 'p' || l_suppkey AS target, ['prerequisite', 'contains', 'applies_to', 'parallel'][l_linenumber % 4 + 1] AS relation_type, l_orderkey * 10 + l_linenumber AS edge_ord FROM lineitem"

# Graph -------------------------------------------------------------------------------------------


@query(f"SELECT book_id, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS name_key, min(node_ord) AS node_ord FROM ({NODES}) GROUP BY ALL")
def g2_book_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book_nodes(nodes(spark, sf_dir)).select("book_id", normalize_name(F.col("name")).alias("name_key"), "node_ord")


_PAIRS = f"""SELECT doc_id, i::INTEGER AS pair_no, l[i + 1] AS parent, l[i + 2] AS child FROM (SELECT doc_id, l, unnest(range(len(l) - 1)) AS i FROM (SELECT doc_id, regexp_split_to_array({projected_sql("coalesce(text, '')")}, '[。，]') AS l FROM documents))"""


@query(f"""SELECT doc_id, pair_no, parent <> child AND length(parent) < length(child) AND right(child, 2) = right(parent, 2)
  AND ({" OR ".join(f"ends_with(parent, '{x}')" for x in lexicon.GENERAL_SUFFIXES)}) AS likely FROM ({_PAIRS})""")
def g4_likely_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tomeweave.operators.relations import is_likely_hierarchy

    split = F.split(projected(F.coalesce("text", F.lit(""))), "[。，]")
    rows = table(spark, sf_dir, "documents").select("doc_id", split.alias("l")).filter(F.size("l") > 1)
    pairs = rows.select("doc_id", F.posexplode(F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("parent"), F.slice("l", F.lit(2), F.size("l") - 1).alias("child"))).alias("pair_no", "p"))
    return pairs.select("doc_id", "pair_no", is_likely_hierarchy(F.col("p.parent"), F.col("p.child")).alias("likely"))


@query(f"SELECT DISTINCT source, target, relation_type FROM ({EDGES}) WHERE source IN (SELECT node_id FROM ({NODES}) WHERE warnings = 0) AND target IN (SELECT node_id FROM ({NODES}) WHERE warnings = 0)")
def g10_surviving_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = nodes(spark, sf_dir).filter(F.size("warnings") == 0)
    return I.surviving_edges(edges(spark, sf_dir), kept).select("source", "target", "relation_type").distinct()


@query(f"SELECT source, target, relation_type, min(edge_ord) AS edge_ord FROM ({EDGES}) GROUP BY ALL")
def g11_dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_edges(edges(spark, sf_dir))


@query(f"""
WITH m AS (SELECT book_id, extraction_method, count(*) AS n, sum(quality_score) AS q, sum(warnings) AS w FROM ({NODES}) GROUP BY ALL)
SELECT book_id, round(sum(q) / sum(n), 3) AS avg_quality, sum(w)::BIGINT AS warning_count, list_sort(list(extraction_method || '=' || n)) AS methods FROM m GROUP BY book_id
""")
def g13_graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_quality(nodes(spark, sf_dir))


_DEGREE = f"SELECT node_id, count(*) AS degree FROM (SELECT source AS node_id FROM ({EDGES}) UNION ALL SELECT target FROM ({EDGES})) GROUP BY ALL"


@query(_DEGREE)
def g14_node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_degree(edges(spark, sf_dir))


@query(f"""
WITH s AS (
  SELECT node_id, coalesce(degree, 0) AS degree, (coalesce(degree, 0) * 10 + log2(1 + 1) * 14 + least(8.0::DOUBLE, log2(length(definition) + 8)) * 2.2::DOUBLE + least(6.0::DOUBLE, log2(length(source_text) + 8)) + 3.0::DOUBLE)
    * greatest(0.35::DOUBLE, least(1.0::DOUBLE, quality_score)) - warnings * 5 AS score FROM ({NODES}) LEFT JOIN ({_DEGREE}) USING (node_id)
), r AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS normalized FROM s)
SELECT node_id, degree, round(score, 6) AS score, round(normalized, 6) AS normalized, floor(12 + pow(round(normalized, 9), 0.72::DOUBLE) * 48 + 0.5::DOUBLE)::BIGINT AS size FROM r
""")
def g15_node_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = G.node_importance(nodes(spark, sf_dir), edges(spark, sf_dir))
    return scored.withColumns({"score": F.round("score", 6), "normalized": F.round("normalized", 6)})


@query(f"""
WITH c AS (SELECT * FROM ({EDGES}) WHERE relation_type = 'contains'),
t AS (SELECT source, count(*) AS n_children, min(edge_ord) AS first FROM c GROUP BY source HAVING count(*) >= 2 ORDER BY n_children DESC, first, source LIMIT 10),
n AS (SELECT c.source AS parent, n_children, row_number() OVER (PARTITION BY c.source ORDER BY edge_ord, target) AS nth, target AS child FROM c JOIN t USING (source))
SELECT * FROM n WHERE nth <= 18
""")
def g16_containment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.containment_groups(edges(spark, sf_dir))


# Integration -------------------------------------------------------------------------------------


@query(f"SELECT node_id, k AS group_key, count(*) OVER (PARTITION BY k) AS group_size FROM ({NODES})")
def i1_exact_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.exact_name_groups(nodes(spark, sf_dir)).select("node_id", "group_key", "group_size")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.similar_groups(nodes(spark, sf_dir))


_MERGED = f"""
RECURSIVE n0 AS MATERIALIZED ({NODES}), sg AS MATERIALIZED (SELECT node_id, book_id, row_number() OVER (ORDER BY node_ord) AS i, name || ' ' || definition AS text FROM n0 WHERE k IN (SELECT k FROM n0 GROUP BY k HAVING count(*) = 1)),
u AS MATERIALIZED (WITH {index_sql("SELECT * FROM sg", "char_wb_2_4", "i")} SELECT i, gram, w / norm AS weight FROM w JOIN norm USING (i)),
nb AS MATERIALIZED (SELECT y.i AS i, list(x.i) AS l FROM (SELECT a.i AS a, b.i AS b FROM u a JOIN u b ON a.gram = b.gram AND a.i < b.i GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.62::DOUBLE) JOIN sg x ON x.i = a JOIN sg y ON y.i = b WHERE x.book_id <> y.book_id GROUP BY y.i),
ld(i, leaders) AS (
  SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT ld.i + 1, CASE WHEN list_has_any(leaders, coalesce(l, []::BIGINT[])) THEN leaders ELSE list_append(leaders, ld.i + 1) END FROM ld LEFT JOIN nb ON nb.i = ld.i + 1 WHERE ld.i < (SELECT count(*) FROM sg)
), ls AS MATERIALIZED (SELECT leaders FROM ld ORDER BY i DESC LIMIT 1),
cl AS MATERIALIZED (SELECT sg.node_id, 'leader:' || le.node_id AS k FROM sg LEFT JOIN nb USING (i), ls JOIN sg le ON le.i = CASE WHEN list_contains(leaders, sg.i) THEN sg.i ELSE list_min(list_intersect(l, leaders)) END),
n AS MATERIALIZED (SELECT n0.* EXCLUDE (k), coalesce(cl.k, n0.k) AS k FROM n0 LEFT JOIN cl USING (node_id)), s AS (SELECT k, list_sort(list(DISTINCT book_title))[1:4] AS titles FROM n GROUP BY k),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(definition) + length(source_text) DESC, node_ord) AS rb, row_number() OVER (PARTITION BY k ORDER BY length(definition) DESC, node_ord) AS rd FROM n),
m AS MATERIALIZED (
  SELECT k, count(*) AS frequency, min(b.node_ord) AS node_ord, CASE WHEN count(*) > 1 THEN 'merged_' || substr(sha1(k), 1, 10) ELSE max(b.node_id) END AS node_id, max(name) FILTER (rb = 1) AS name,
    max(definition) FILTER (rd = 1) || CASE WHEN count(*) > 1 THEN '（整合来源：' || array_to_string(any_value(titles), '；') || '）' ELSE '' END AS definition,
    max(source_text) FILTER (rb = 1) AS source_text, max(book_title) FILTER (rb = 1) AS book_title, max(chapter) FILTER (rb = 1) AS chapter, max(page) FILTER (rb = 1) AS page FROM b JOIN s USING (k) GROUP BY k
), d AS (
  SELECT CASE WHEN frequency > 1 THEN 'merge_' ELSE 'keep_' END || substr(sha1(k), 1, 8) AS decision_id, CASE WHEN frequency > 1 THEN 'merge' ELSE 'keep' END AS action, node_id AS result_node, frequency AS n_affected,
    CASE WHEN frequency > 1 THEN frequency || ' 本/处教材知识点语义相近，保留“' || book_title || '”中更完整的表述。' ELSE '“' || name || '”未发现高置信重复知识点，保留以维持教学完整性。' END AS reason,
    CASE WHEN frequency > 1 THEN least(0.96::DOUBLE, 0.72::DOUBLE + 0.04::DOUBLE * frequency) ELSE 0.7::DOUBLE END AS confidence, 'active' AS status, node_ord AS decision_ord FROM m
), map AS MATERIALIZED (SELECT n.node_id, m.node_id AS integrated_id FROM n JOIN m USING (k)),
e AS MATERIALIZED (
  SELECT a.integrated_id AS source, z.integrated_id AS target, relation_type, min(edge_ord) AS edge_ord FROM ({EDGES}) x JOIN map a ON a.node_id = x.source JOIN map z ON z.node_id = x.target
  WHERE a.integrated_id <> z.integrated_id GROUP BY ALL
)"""


@query(f"WITH {_MERGED} SELECT node_id, k AS group_key FROM n")
def i4_groups_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by name, and clusters of similar singletons."""
    return _grouped(spark, sf_dir).select("node_id", "group_key")


@query(f"WITH {_MERGED} SELECT node_id, frequency, name, definition, source_text, book_title FROM m")
def i5_merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_nodes(_grouped(spark, sf_dir)).select("node_id", "frequency", "name", "definition", "source_text", "book_title")


@query(f"WITH {_MERGED} SELECT * FROM d")
def i6_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.decisions(I.merge_nodes(_grouped(spark, sf_dir)))


@query(f"WITH {_MERGED} SELECT * FROM map")
def i7_node_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.node_map(_grouped(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT * FROM e")
def i8_remap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.remap_edges(edges(spark, sf_dir), I.node_map(_grouped(spark, sf_dir)))


def _document_chars(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]


def _stats(spark: SparkSession, sf_dir: str, grouped: DataFrame | None = None) -> DataFrame:
    own, links, grouped = nodes(spark, sf_dir), edges(spark, sf_dir), grouped or _grouped(spark, sf_dir)
    merged = I.merge_nodes(grouped)
    return I.stats(own, links, merged, I.remap_edges(links, I.node_map(grouped)), I.decisions(merged), _document_chars(spark, sf_dir))


_STATS = f"""WITH {_MERGED}, c AS (SELECT sum(length(text))::BIGINT AS original_chars FROM documents), st AS (
  SELECT original_chars, (SELECT sum(length(definition))::BIGINT FROM m) AS integrated_chars, round((SELECT sum(length(definition)) FROM m)::DOUBLE / original_chars::DOUBLE, 4) AS compression_ratio,
    (SELECT count(*) FROM n) AS original_nodes, (SELECT count(*) FROM m) AS integrated_nodes, (SELECT count(*) FROM lineitem) AS original_edges, (SELECT count(*) FROM e) AS integrated_edges,
    (SELECT count(*) FROM d WHERE action = 'merge') AS merge_count, (SELECT count(*) FROM d WHERE action = 'keep') AS keep_count, (SELECT count(*) FROM d WHERE action = 'remove') AS remove_count FROM c)"""


@query(f"{_STATS} SELECT * FROM st")
def i9_integration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


#: The whole job with five characters for a node, so that nodes have to leave.
_ALL_STEPS = f"""WITH {_MERGED}, tg AS (SELECT sum(length(definition))::BIGINT AS total, count(*) AS c, floor(5 * (SELECT count(*) FROM n) * 0.3::DOUBLE)::BIGINT AS target FROM m),
pl AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(length(definition)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m WINDOW w AS (ORDER BY frequency, length(definition), node_ord)),
lv AS (SELECT pl.*, total > target AND place < tg.c - greatest(1, least(tg.c, target // 40)) AND total - before > target AS leaves FROM pl, tg),
x AS (SELECT * FROM d UNION ALL SELECT 'remove_' || substr(sha1(node_id), 1, 8), 'remove', NULL, 1, '为满足 30% 压缩比，删除低频知识点“' || name || '”的冗余摘要；原始来源仍可通过 RAG 检索。', 0.68::DOUBLE, 'active', node_ord FROM lv WHERE leaves),
ke AS (SELECT * FROM e WHERE source IN (SELECT node_id FROM lv WHERE NOT leaves) AND target IN (SELECT node_id FROM lv WHERE NOT leaves))"""


def _whole(spark: SparkSession, sf_dir: str) -> I.Integration:
    own = nodes(spark, sf_dir)
    return I.run_integration(own, edges(spark, sf_dir), 5 * own.count())


@query(f"{_ALL_STEPS} SELECT decision_id, action, result_node, n_affected FROM x")
def i9_integration_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All decisions of the whole job: merge, keep and remove."""
    return _whole(spark, sf_dir).decisions.select("decision_id", "action", "result_node", "n_affected")


@query(f"{_ALL_STEPS} SELECT * FROM ke")
def i8_edges_after_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).edges


_LESS = _MERGED.replace(f"n0 AS MATERIALIZED ({NODES})", f"n0 AS MATERIALIZED (SELECT * FROM ({NODES}) WHERE book_id <> 'Brand#11')")


@query(f"WITH {_LESS} SELECT node_id, integrated_id FROM map")
def s8_reintegrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without one book, what is left is integrated again."""
    left = remove_book({"nodes": nodes(spark, sf_dir), "edges": edges(spark, sf_dir)}, "Brand#11")
    return I.run_integration(left["nodes"], left["edges"], _document_chars(spark, sf_dir)).node_map


def _long_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with definitions of many lengths and frequencies of one to five."""
    own = nodes(spark, sf_dir)
    return own.withColumns({"definition": F.repeat("definition", (F.col("node_ord") % 7 + 1).cast("int")), "frequency": (F.col("node_ord") % 5 + 1).cast("long")})


_TRIM = f"""
WITH n AS (SELECT node_id, node_ord, name, repeat(definition, node_ord % 7 + 1) AS definition, node_ord % 5 + 1 AS frequency FROM ({NODES})),
c AS (SELECT sum(length(definition))::BIGINT AS total, count(*) AS n, floor(sum(length(definition)) * 0.3::DOUBLE)::BIGINT AS target FROM n),
p AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(length(definition)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WINDOW w AS (ORDER BY frequency, length(definition), node_ord)),
x AS (SELECT p.*, place < c.n - greatest(1, least(c.n, target // 40)) AND total - before > target AS leaves, target FROM p, c),
k AS (SELECT sum(length(definition)) AS chars, count(*) AS n, any_value(target) AS target FROM x WHERE NOT leaves)
"""


def _trimmed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = _long_nodes(spark, sf_dir)
    return I.trim_to_compression(own, own.agg(F.sum(F.length("definition").cast("long"))).first()[0])


@query(f"{_TRIM} SELECT node_id, leaves AS removed FROM x")
def i10_trim_to_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, removed = _trimmed(spark, sf_dir)
    return kept.select("node_id", F.lit(False).alias("removed")).unionByName(removed.select("node_id", F.lit(True).alias("removed")))


@query(f"{_TRIM} SELECT node_id, CASE WHEN k.chars > k.target THEN substring(definition, 1, greatest(1, k.target // k.n)) ELSE definition END AS definition FROM x, k WHERE NOT leaves")
def i11_truncate_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trimmed(spark, sf_dir)[0].select("node_id", "definition")


@query(f"{_TRIM} SELECT 'remove_' || substr(sha1(node_id), 1, 8) AS decision_id, 'remove' AS action, NULL::VARCHAR AS result_node, 1::BIGINT AS n_affected, '为满足 30% 压缩比，删除低频知识点“' || name || '”的冗余摘要；原始来源仍可通过 RAG 检索。' AS reason, 0.68::DOUBLE AS confidence, 'active' AS status, node_ord AS decision_ord FROM x WHERE leaves")
def i12_remove_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.remove_decisions(_trimmed(spark, sf_dir)[1])


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part type once, in a message of one of four wordings about a part of that type."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("msg_ord"))
    wording = F.element_at(F.array(F.lit("请保留 "), F.lit("请分开 "), F.lit("Keep "), F.lit("见 ")), (F.col("msg_ord") % 4 + 1).cast("int"))
    return p.select("msg_ord", F.concat(wording, "p_name").alias("message"))


_FEEDBACK = f"""
WITH {_MERGED},
g AS (SELECT msg_ord, ['请保留 ', '请分开 ', 'Keep ', '见 '][msg_ord % 4 + 1] || p_name AS message FROM (SELECT p_name, min(p_partkey) AS msg_ord FROM part GROUP BY p_name)),
a AS (SELECT *, regexp_matches(message, '分开|拆分|不是同一个') AS split, regexp_matches(message, '保留|不应该删除') OR contains(lower(message), 'keep') AS keep FROM g),
h AS (SELECT d.decision_id, arg_max(CASE WHEN split THEN '教师反馈要求拆分该整合决策：' ELSE '教师反馈要求保留相关知识点：' END || message, msg_ord) AS said FROM d JOIN m ON m.node_id = d.result_node JOIN a ON (split OR keep) AND contains(message, m.name) GROUP BY ALL),
fb AS (SELECT d.decision_id, action, CASE WHEN said IS NULL THEN d.status ELSE 'overridden' END AS status, coalesce(said, reason) AS reason FROM d LEFT JOIN h USING (decision_id))
"""


def _feedback(spark: SparkSession, sf_dir: str, grouped: DataFrame | None = None) -> DataFrame:
    merged = I.merge_nodes(grouped or _grouped(spark, sf_dir))
    return I.apply_feedback(I.decisions(merged), merged, _messages(spark, sf_dir))


@query(f"{_FEEDBACK} SELECT * FROM fb")
def i13_apply_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback(spark, sf_dir).select("decision_id", "action", "status", "reason")


# Report ------------------------------------------------------------------------------------------


@query(f"{_STATS} SELECT (SELECT count(DISTINCT source) FROM documents) AS book_count, (SELECT count(DISTINCT p_brand) FROM part) AS graph_count, original_chars, integrated_chars, compression_ratio, compression_ratio <= 0.3 AS target_met FROM st")
def r1_report_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir)


def _overview(spark: SparkSession, sf_dir: str, grouped: DataFrame | None = None) -> DataFrame:
    books = table(spark, sf_dir, "documents").agg(F.countDistinct("source")).first()[0]
    return R.overview(_stats(spark, sf_dir, grouped), books, table(spark, sf_dir, "part").agg(F.countDistinct("p_brand")).first()[0])


@query(f"""
WITH n AS ({NODES}), e AS (SELECT n.book_id, count(*) AS n_edges FROM n JOIN ({EDGES}) x ON x.source = n.node_id GROUP BY ALL)
SELECT book_id, count(*) AS n_chapters, max(page)::BIGINT AS n_pages, sum(length(definition))::BIGINT AS n_chars, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges FROM n LEFT JOIN e USING (book_id) GROUP BY book_id
""")
def r2_report_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nodes(spark, sf_dir)
    parts = own.select("book_id", F.col("page").cast("long").alias("page_end"), F.length("definition").cast("long").alias("char_count"))
    return R.by_book(own, parts, own, edges(spark, sf_dir))


@query(f"{_FEEDBACK} SELECT action, status, count(*) AS n FROM fb GROUP BY ALL")
def r3_decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.decision_summary(_feedback(spark, sf_dir))


@query(f"WITH {_MERGED} SELECT relation_type, count(*) AS n, list_position(['prerequisite', 'contains', 'applies_to', 'parallel'], relation_type)::BIGINT AS position FROM e GROUP BY relation_type")
def r4_relation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation_distribution(I.remap_edges(edges(spark, sf_dir), I.node_map(_grouped(spark, sf_dir))))


@query(f"SELECT round(avg(quality_score), 9) AS avg_quality FROM ({NODES})")
def r5_average_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.average_quality(nodes(spark, sf_dir)).select(F.round("avg_quality", 9).alias("avg_quality"))


def _examples(spark: SparkSession, sf_dir: str, grouped: DataFrame | None = None) -> DataFrame:
    grouped = grouped or _grouped(spark, sf_dir)
    merged = I.merge_nodes(grouped)
    return R.example_decisions(I.decisions(merged), I.node_map(grouped), nodes(spark, sf_dir), merged)


@query(f"""
WITH {_MERGED}, f AS (SELECT * FROM d WHERE action = 'merge' ORDER BY decision_ord LIMIT 5),
a AS (SELECT f.decision_id, n.name || '（' || n.book_title || '，' || n.chapter || '，第 ' || n.page || ' 页）' AS text, row_number() OVER (PARTITION BY f.decision_id ORDER BY n.node_ord) AS nth FROM f JOIN map ON integrated_id = result_node JOIN n USING (node_id))
SELECT decision_id, action, (SELECT string_agg(text, '；' ORDER BY nth) FROM a WHERE a.decision_id = f.decision_id AND nth <= 4) AS affected,
  m.name || '（' || m.book_title || '，' || m.chapter || '，第 ' || m.page || ' 页）' AS result, confidence FROM f JOIN m ON m.node_id = f.result_node
""")
def r6_example_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir)


def _report_sql() -> str:
    of = lambda name: f"({ORACLE_SQL[name]})"
    fixed = {0: "# 教材知识整合报告", 1: "", 2: "## 整合概览", 3: "", 10: "", 11: "## 整合决策摘要", 12: "", 18: "", 19: "## 知识图谱统计", 20: "", 23: "", 24: "## 重点整合案例", 25: ""}
    total = lambda c, value: f"coalesce(sum(n) FILTER ({c} = '{value}'), 0)::BIGINT"
    counts = ", ".join(
        f"{{'k': {k}, 'x': '- {word}：' || {total(c, value)} || ' 项'}}" for k, word, c, value in
        ((13, "合并", "action", "merge"), (14, "保留", "action", "keep"), (15, "删除", "action", "remove"), (16, "有效决策", "status", "active"), (17, "教师覆盖", "status", "overridden"))
    )
    return f"""
SELECT u.k::INTEGER AS line_no, u.x AS line FROM (
  SELECT unnest([{", ".join(f"{{'k': {k}, 'x': '{x}'}}" for k, x in fixed.items())}]) AS u
  UNION ALL SELECT unnest([{{'k': 4, 'x': '- 原始教材数量：' || book_count}}, {{'k': 5, 'x': '- 已构建图谱教材数：' || graph_count}}, {{'k': 6, 'x': '- 原始总字数：' || original_chars}}, {{'k': 7, 'x': '- 整合后字数：' || integrated_chars}},
    {{'k': 8, 'x': printf('- 压缩比：%.2f%%', compression_ratio * 100)}}, {{'k': 9, 'x': '- 压缩目标：不超过 30%，当前' || CASE WHEN target_met THEN '满足' ELSE '未满足' END || '目标'}}]) FROM {of("r1_report_overview")}
  UNION ALL SELECT unnest([{counts}]) FROM {of("r3_decision_summary")}
  UNION ALL SELECT {{'k': 21, 'x': printf('- 平均节点质量分：%.3f', avg_quality)}} FROM {of("r5_average_quality")}
  UNION ALL SELECT {{'k': 22, 'x': '- 关系类型分布：' || coalesce(string_agg(relation_type || ' ' || n, '，' ORDER BY position), '无')}} FROM {of("r4_relation_distribution")}
  UNION ALL SELECT {{'k': 25 + k, 'x': k || '. **' || action || '** `' || decision_id || '`：' || affected || ' → ' || result || '，置信度 ' || printf('%.2f', confidence)}} FROM (SELECT *, row_number() OVER (ORDER BY decision_id) AS k FROM {of("r6_example_decisions")})
)"""


@query(_report_sql())
def r7_render_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _grouped(spark, sf_dir)
    linked = G.relation_distribution(I.remap_edges(edges(spark, sf_dir), I.node_map(grouped)))
    return R.render(_overview(spark, sf_dir, grouped), R.decision_summary(_feedback(spark, sf_dir, grouped)), linked, r5_average_quality(spark, sf_dir), _examples(spark, sf_dir, grouped))
