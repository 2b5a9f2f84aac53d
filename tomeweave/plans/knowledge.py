"""Queries: terms, graphs and retrieval benchmarks. Where the rules on names are ordered rewriting, there is no SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomeweave import lexicon as L
from tomeweave.operators import knowledge as G
from tomeweave.operators import questions as B
from tomeweave.operators import relations as R
from tomeweave.operators import retrieval as V
from tomeweave.operators import terms as K
from tomeweave.operators.chunks import RetrievalConfig
from tomeweave.operators.dictionary import dictionary_join
from tomeweave.operators.lineage import cut
from tomeweave.operators.scan import retrieve
from tomeweave.plans import terms_sql as Q
from tomeweave.plans.retrieval import CONFIG, answers_sql, corpus, corpus_sql, questions, ranked_sql, terms_sql
from tomeweave.plans.tables import chapters, chapters_sql, cjk_sql, projected, projected_sql, strip_sql, table
from tomeweave.registry import query

_ZH = projected_sql("coalesce(text, '')")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the projected documents between commas and sentence ends."""
    split = F.split(projected(F.coalesce("text", F.lit(""))), "[。，\n]")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split).alias("pos", "piece"))


_PIECES = f"SELECT doc_id, unnest(l) AS piece, unnest(range(len(l)))::INTEGER AS pos FROM (SELECT doc_id, string_split_regex({_ZH}, '[。，\\n]') AS l FROM documents)"


@query(f"SELECT doc_id, pos, {Q.clean_sql('piece')} AS name FROM ({_PIECES})")
def k1_clean_candidate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("doc_id", "pos", K.clean_name(F.col("piece")).alias("name"))


_SUFFIXES = ", ".join(f"'{s}'" for s in L.CONCEPT_SUFFIXES)


@query(f"""
SELECT doc_id, pos, CASE WHEN best >= 2 AND best < length(piece) THEN substring(piece, 1, best) ELSE piece END AS trimmed
FROM (SELECT *, coalesce(list_max([strpos(piece, s) + length(s) - 1 for s in [{_SUFFIXES}] if strpos(piece, s) > 0]), 0) AS best FROM ({_PIECES}))
""")
def k2_trim_to_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("doc_id", "pos", K.trimmed_to_suffix(F.col("piece")).alias("trimmed"))


@query(f"SELECT doc_id, pos, name, quality, warnings FROM {Q.validated_sql(_PIECES, 'piece', 'piece')}")
def k3_validate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.validated(_terms(spark, sf_dir), "piece", "piece").select("doc_id", "pos", "name", "quality", "warnings")


#: Short names of other kinds, which the warnings of K3 come from, stand in texts that lack them.
@query(f"SELECT doc_id, pos, name, quality, warnings FROM {Q.validated_sql(f'SELECT *, piece || chr(38656) AS raw FROM ({_PIECES})', 'raw', 'piece')}")
def k3_validate_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a loose ending behind each piece."""
    rows = _terms(spark, sf_dir).withColumn("raw", F.concat("piece", F.lit("需")))
    return K.validated(rows, "raw", "piece").select("doc_id", "pos", "name", "quality", "warnings")


_SHORT = ", ".join(f"'{s}'" for s in sorted(L.SHORT_CONCEPTS))


@query(f"""
SELECT doc_id, pos, round(0.58::DOUBLE + CASE WHEN regexp_matches(piece, '({"|".join(L.CONCEPT_SUFFIXES)})$') THEN 0.18 ELSE 0 END::DOUBLE + CASE WHEN piece IN ({_SHORT}) THEN 0.12 ELSE 0 END::DOUBLE
  + CASE WHEN length(piece) BETWEEN 3 AND 8 THEN 0.08 ELSE 0 END::DOUBLE - CASE WHEN regexp_matches(piece, '[0-9]') THEN 0.22 ELSE 0 END::DOUBLE, 3) AS score FROM ({_PIECES})
""")
def k4_score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("doc_id", "pos", K.name_score(F.col("piece"), F.lit(0)).alias("score"))


_CANDIDATES = Q.candidates_sql(chapters_sql(True))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chapter_candidates(G.with_graph_text(chapters(spark, sf_dir, True)))


def _method(found: DataFrame, method: str) -> DataFrame:
    return found.filter(F.col("method") == method).select("chapter_id", "cand_ord", "name", "source_text", F.round("quality", 6).alias("quality"))


def _method_sql(method: str, candidates: str = _CANDIDATES) -> str:
    return f"WITH {candidates} SELECT chapter_id, cand_ord, name, source_text, round(quality, 6) AS quality FROM cand WHERE method = '{method}'"


@query(_method_sql("term_annotation", Q.candidates_sql(f"SELECT * REPLACE (replace(replace(content, '激素', '激素（hormone）'), '神经，', '神经（条件下），') AS content) FROM ({chapters_sql(True)})")))
def k5_annotated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with a gloss, which the texts get first: they have no brackets."""
    glossed = F.replace(F.replace("content", F.lit("激素"), F.lit("激素（hormone）")), F.lit("神经，"), F.lit("神经（条件下），"))
    return _method(K.chapter_candidates(G.with_graph_text(chapters(spark, sf_dir, True).withColumn("content", glossed))), "term_annotation")


@query(_method_sql("definition_sentence"))
def k6_definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _method(_found(spark, sf_dir), "definition_sentence")


@query(_method_sql("heading"))
def k7_heading_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _method(_found(spark, sf_dir), "heading")


@query(_method_sql("frequency_term"))
def k8_frequency_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _method(_found(spark, sf_dir), "frequency_term")


@query(f"SELECT doc_id, raw, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_ZH}, '[一-鿿]{{1,10}}(?:{'|'.join(L.CONCEPT_SUFFIXES)})')) AS raw FROM documents) GROUP BY ALL HAVING count(*) >= 2")
def k8_suffix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "documents").select("doc_id", projected(F.coalesce("text", F.lit(""))).alias("x"))
    return text.select("doc_id", F.explode(K.suffix_counts(F.col("x"))).alias("c")).select("doc_id", "c.raw", (-F.col("c.n")).cast("long").alias("n"))


@query(f"WITH {_CANDIDATES} SELECT chapter_id, name, cand_ord, method, round(quality, 6) AS quality FROM ded")
def k9_dedupe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedupe_candidates(_found(spark, sf_dir)).select("chapter_id", "name", "cand_ord", "method", F.round("quality", 6).alias("quality"))


@query(f"WITH {_CANDIDATES} SELECT chapter_id, rank, name, method FROM ranked")
def k10_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rank_candidates(K.dedupe_candidates(_found(spark, sf_dir))).select("chapter_id", F.col("rank").cast("long").alias("rank"), "name", "method")


#: Parts as candidates: a brand is a book, a type a chapter; a name comes up often in a chapter.
_PART_CANDIDATES = """SELECT p_brand AS book_id, substring(p_type, 1, 4) AS chapter_id, p_partkey AS cand_ord, p_name AS name, repeat(p_type, p_size % 3) AS source_text,
  ['frequency_term', 'heading', 'term_annotation', 'definition_sentence'][p_size % 4 + 1] AS method, p_size % 4 + 1 AS place, 0.5::DOUBLE + (p_size % 7) / 20.0::DOUBLE AS quality FROM part"""


def _part_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, K.METHODS)), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("book_id"), F.substring("p_type", 1, 4).alias("chapter_id"), F.col("p_partkey").alias("cand_ord"), F.col("p_name").alias("name"), F.repeat("p_type", F.col("p_size") % 3).alias("source_text"),
        method.alias("method"), (F.lit(0.5) + (F.col("p_size") % 7) / F.lit(20.0)).alias("quality"), F.array().cast("array<string>").alias("warnings"),
    )


_DEDUPED = f"""c AS ({_PART_CANDIDATES}), b AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_id, name ORDER BY quality DESC, cand_ord) AS nth, min(cand_ord) OVER (PARTITION BY book_id, chapter_id, name) AS first FROM c),
d AS (SELECT book_id, chapter_id, name, first AS cand_ord, source_text, method, place, quality FROM b WHERE nth = 1)"""


@query(f"WITH {_DEDUPED} SELECT book_id, chapter_id, name, cand_ord, source_text, method, round(quality, 6) AS quality FROM d")
def k9_dedupe_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dedupe_candidates(_part_candidates(spark, sf_dir)).drop("warnings").withColumn("quality", F.round("quality", 6))


_RANKED_PARTS = f"{_DEDUPED}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY quality DESC, place DESC, length(source_text) DESC, cand_ord) AS rank FROM d), k AS (SELECT * FROM r WHERE rank <= 10)"


@query(f"WITH {_RANKED_PARTS} SELECT book_id, chapter_id, rank, name, method FROM k")
def k10_rank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = K.rank_candidates(K.dedupe_candidates(_part_candidates(spark, sf_dir)))
    return ranked.select("book_id", "chapter_id", F.col("rank").cast("long").alias("rank"), "name", "method")


@query(f"SELECT doc_id, {Q.around_sql('x', '(pl - 1)', '(pl + 2)')} AS sentence FROM (SELECT *, strpos(x, '红细胞') AS pl FROM (SELECT doc_id, {_ZH} AS x FROM documents)) WHERE pl > 0")
def k11_sentence_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", projected(F.coalesce("text", F.lit(""))).alias("x")).withColumn("at", F.instr("x", "红细胞")).filter("at > 0")
    return rows.select("doc_id", K.sentence_around(F.col("x"), F.col("at") - 1, F.col("at") + 2).alias("sentence"))


@query(f"SELECT doc_id, coalesce([{strip_sql('s')} for s in string_split_regex(x, '[。！？\\n]') if contains(s, '红细胞') AND length({strip_sql('s')}) > 8][1], '') AS sentence FROM (SELECT doc_id, {_ZH} AS x FROM documents)")
def k12_source_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", K.first_sentence_with(projected(F.coalesce("text", F.lit(""))), F.lit("红细胞")).alias("sentence"))


_TOKENS = f"regexp_extract_all(gt, '{K.KEYWORD}')"


@query(f"""WITH ch AS (SELECT chapter_id, {Q.graph_text_sql('content')} AS gt FROM ({chapters_sql(True)})),
t AS (SELECT chapter_id, gt, unnest({_TOKENS}) AS raw, unnest(range(len({_TOKENS}))) AS i FROM ch),
c AS (SELECT chapter_id, name AS word, count(*) AS n, min(i) AS first FROM {Q.validated_sql('SELECT * FROM t', 'raw', 'gt')} GROUP BY ALL)
SELECT chapter_id, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 12""")
def k13_top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keywords(G.with_graph_text(chapters(spark, sf_dir, True)))


# Graph -------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chapter_nodes(chapters(spark, sf_dir, True))


_NODES = f"""{_CANDIDATES}, nd AS MATERIALIZED (SELECT 'node_' || substr(sha1(book_id || ':' || chapter_id || ':' || name), 1, 10) AS node_id, book_id, chapter_id, name,
  CASE WHEN source_text = '' THEN name || ' 是 ' || title || ' 中反复出现的核心知识点。' ELSE substring(source_text, 1, 220) END AS definition, substring(source_text, 1, 260) AS source_text, page_start AS page, method, quality, chapter_ord * 16 + rank AS node_ord
  FROM ranked JOIN (SELECT chapter_id, title, page_start, chapter_ord FROM ch) USING (chapter_id))"""


@query(f"WITH {_NODES} SELECT node_id, book_id, name, definition, page, method AS extraction_method, round(quality, 6) AS quality_score FROM nd")
def g1_chapter_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("node_id", "book_id", "name", "definition", "page", "extraction_method", F.round("quality_score", 6).alias("quality_score"))


@query(f"""WITH {_RANKED_PARTS}, t AS (SELECT p_brand AS book_id, substring(p_type, 1, 4) AS chapter_id, min(p_partkey) AS chapter_ord, min(p_type) AS title, min(p_size)::BIGINT AS page FROM part GROUP BY ALL)
SELECT 'node_' || substr(sha1(book_id || ':' || chapter_id || ':' || name), 1, 10) AS node_id, book_id, name, CASE WHEN source_text = '' THEN name || ' 是 ' || title || ' 中反复出现的核心知识点。' ELSE substring(source_text, 1, 220) END AS definition,
  title AS chapter, page, method AS extraction_method, round(quality, 6) AS quality_score, chapter_ord * 16 + rank AS node_ord FROM k JOIN t USING (book_id, chapter_id)""")
def g1_nodes_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("book_id"), F.substring("p_type", 1, 4).alias("chapter_id")).agg(
        F.min("p_partkey").alias("chapter_ord"), F.min("p_type").alias("title"), F.min("p_size").cast("long").alias("page_start")
    )
    nodes = G.nodes_of(_part_candidates(spark, sf_dir), pages)
    return nodes.select("node_id", "book_id", "name", "definition", "chapter", "page", "extraction_method", F.round("quality_score", 6).alias("quality_score"), "node_ord")


_EVIDENCE = f"SELECT doc_id, x, regexp_extract(x, '[一-鿿]{{1,3}}神经', 0) AS a, regexp_extract(x, '[一-鿿]{{1,3}}激素', 0) AS b FROM (SELECT doc_id, {_ZH} AS x FROM documents)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", projected(F.coalesce("text", F.lit(""))).alias("x"))
    return rows.withColumns({"a": F.regexp_extract("x", "[一-鿿]{1,3}神经", 0), "b": F.regexp_extract("x", "[一-鿿]{1,3}激素", 0)}).filter("a <> '' AND b <> ''")


def _between_sql(a: str, words: tuple[str, int, int], b: str) -> str:
    """A pattern that differs by row is compiled for each; not for texts without the words."""
    return rf"(CASE WHEN regexp_matches(x, '{words[0]}') THEN regexp_matches(x, regexp_escape({a}) || '[^。；\n]{{0,{words[1]}}}(?:{words[0]})[^。；\n]{{0,{words[2]}}}' || regexp_escape({b})) ELSE false END)"


_HIERARCHY = "(a <> b AND length(a) < length(b) AND regexp_matches(a, '(" + "|".join(L.GENERAL_SUFFIXES) + ")$') AND right(a, 2) = right(b, 2))"


@query(f"SELECT doc_id, {_between_sql('a', L.CONTAINS_WORDS, 'b')} OR {_between_sql('b', L.PART_WORDS, 'a')} OR {_HIERARCHY} AS holds FROM ({_EVIDENCE}) WHERE a <> '' AND b <> ''")
def g3_contains_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", R.contains_evidence(F.col("a"), F.col("b"), F.col("x")).alias("holds"))


_LEARN = r"(CASE WHEN regexp_matches(x, '理解|掌握|学习') THEN regexp_matches(x, '(?:理解|掌握|学习)[^。；\n]{0,18}' || regexp_escape(b) || '[^。；\n]{0,28}(?:需要|必须|先)[^。；\n]{0,28}' || regexp_escape(a)) ELSE false END)"


@query(f"SELECT doc_id, {_LEARN} OR {_between_sql('a', L.BASIS_WORDS, 'b')} AS holds FROM ({_EVIDENCE}) WHERE a <> '' AND b <> ''")
def g5_prerequisite_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", R.prerequisite_evidence(F.col("a"), F.col("b"), F.col("x")).alias("holds"))


@query(f"SELECT doc_id, {_between_sql('a', L.APPLIES_WORDS, 'b')} OR {_between_sql('b', L.RELIES_WORDS, 'a')} AS holds FROM ({_EVIDENCE}) WHERE a <> '' AND b <> ''")
def g6_applies_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("doc_id", R.applies_evidence(F.col("a"), F.col("b"), F.col("x")).alias("holds"))


#: Up to three names of a document are nodes of its chapter, with the whole text as their source.
_ENDS = ("神经", "激素", "系统")
_TRIO = f"""SELECT source AS book_id, 'ch_' || doc_id AS chapter_id, 'd' || doc_id || '_' || ord AS node_id, doc_id * 16 + ord AS node_ord, name, '' AS definition, CASE WHEN doc_id % 3 = 0 THEN 'heading' ELSE 'frequency_term' END AS method, x AS src
FROM (SELECT *, unnest([{", ".join(f"regexp_extract(x, '[一-鿿]{{1,3}}{e}', 0)" for e in _ENDS)}]) AS name, unnest([1, 2, 3]) AS ord FROM (SELECT doc_id, coalesce(source, '') AS source, {_ZH} AS x FROM documents)) WHERE name <> ''"""


def _trio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), projected(F.coalesce("text", F.lit(""))).alias("x"))
    names = F.array(*(F.regexp_extract("x", f"[一-鿿]{{1,3}}{e}", 0) for e in _ENDS))
    each = rows.select("*", F.posexplode(names).alias("k", "name")).filter("name <> ''").withColumn("ord", F.col("k") + 1)
    return each.select(
        F.col("source").alias("book_id"), F.concat(F.lit("ch_"), F.col("doc_id").cast("string")).alias("chapter_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("ord").cast("string")).alias("node_id"),
        (F.col("doc_id") * 16 + F.col("ord")).alias("node_ord"), "name", F.lit("").alias("definition"), F.col("x").alias("source_text"), F.lit("核心概念").alias("category"),
        F.concat(F.lit("ch_"), F.col("doc_id").cast("string")).alias("chapter"), F.when(F.col("doc_id") % 3 == 0, "heading").otherwise("frequency_term").alias("extraction_method"),
    )


def _inferred_sql(group: str, nodes: str) -> str:
    """CTEs up to ``inf`` (book_id, chapter_id, i, j, source, target, relation_type, description) of the pairs within a group of ``nodes``."""
    swap = lambda c: c.replace("(a <>", "(@ <>").replace("length(a) < length(b)", "length(b) < length(a)").replace("regexp_matches(a,", "regexp_matches(b,").replace("@", "b").replace("<> b", "<> a", 1)
    learn = _LEARN.replace("regexp_escape(b)", "#").replace("regexp_escape(a)", "regexp_escape(b)").replace("#", "regexp_escape(a)")
    ends = " AND ".join(f"regexp_matches({x}, '({'|'.join(L.CONCEPT_SUFFIXES)})$')" for x in "ab")
    joined = f"{_between_sql('a', L.AND_WORDS, 'b')} OR {_between_sql('b', L.AND_WORDS, 'a')}".replace("regexp_matches(x,", "regexp_matches(shared,")
    both = lambda t: f"contains({t}, a) AND contains({t}, b)"
    return f"""pr AS (SELECT l.book_id, l.chapter_id, l.node_ord AS i, r.node_ord AS j, l.node_id AS li, r.node_id AS ri, l.name AS a, r.name AS b, l.chapter_id = r.chapter_id AS same, l.method = 'heading' AND r.method = 'heading' AS heads,
  concat_ws('。', l.name, nullif(l.definition, ''), nullif(l.src, ''), r.name, nullif(r.definition, ''), nullif(r.src, '')) AS x, l.src || chr(10) || r.src AS shared FROM {nodes} l JOIN {nodes} r ON l.{group} = r.{group} AND l.book_id = r.book_id AND l.node_ord < r.node_ord),
ru AS (SELECT *, CASE WHEN {_between_sql('a', L.CONTAINS_WORDS, 'b')} OR {_between_sql('b', L.PART_WORDS, 'a')} OR {_HIERARCHY} THEN 0
  WHEN {_between_sql('b', L.CONTAINS_WORDS, 'a')} OR {_between_sql('a', L.PART_WORDS, 'b')} OR {swap(_HIERARCHY)} THEN 1
  WHEN {_LEARN} OR {_between_sql('a', L.BASIS_WORDS, 'b')} THEN 2 WHEN {learn} OR {_between_sql('b', L.BASIS_WORDS, 'a')} THEN 3
  WHEN {_between_sql('a', L.APPLIES_WORDS, 'b')} OR {_between_sql('b', L.RELIES_WORDS, 'a')} THEN 4 WHEN {_between_sql('b', L.APPLIES_WORDS, 'a')} OR {_between_sql('a', L.RELIES_WORDS, 'b')} THEN 5
  WHEN same AND (({both('shared')} AND ({joined})) OR heads OR ({ends} AND right(a, 1) = right(b, 1))) THEN 6 END AS rule FROM pr),
di AS (SELECT *, rule IN (1, 3, 5) AS back FROM ru WHERE rule IS NOT NULL),
inf AS (SELECT book_id, chapter_id, i, j, CASE WHEN back THEN ri ELSE li END AS source, CASE WHEN back THEN li ELSE ri END AS target, ['contains', 'prerequisite', 'applies_to', 'parallel'][rule // 2 + 1] AS relation_type,
  CASE rule // 2 WHEN 0 THEN s || ' 包含或统摄 ' || t || '。' WHEN 1 THEN '理解 ' || t || ' 之前需要掌握 ' || s || '。' WHEN 2 THEN s || ' 可应用于 ' || t || '。' ELSE s || ' 与 ' || t || ' 是同层级相关知识点。' END AS description
  FROM (SELECT *, CASE WHEN back THEN b ELSE a END AS s, CASE WHEN back THEN a ELSE b END AS t FROM di))"""


_CHAPTER_EDGES = f"""n AS MATERIALIZED ({_TRIO}), {_inferred_sql("chapter_id", "n")}"""


@query(f"WITH {_CHAPTER_EDGES} SELECT source, target, relation_type, description FROM inf")
def g8_relations_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.infer_relations(R.pairs_within(_trio(spark, sf_dir), ["book_id", "chapter_id"])).select("source", "target", "relation_type", "description")


@query(f"WITH {_CHAPTER_EDGES} SELECT source, target, description FROM inf WHERE relation_type = 'parallel'")
def g7_parallel_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chapter_edges(_trio(spark, sf_dir)).filter("relation_type = 'parallel'").select("source", "target", "description")


_EDGES = f"{_CHAPTER_EDGES}, ed AS MATERIALIZED (SELECT book_id, source, target, relation_type, description, i * 16 + j - i AS edge_ord FROM inf)"


@query(f"WITH {_EDGES} SELECT * FROM ed")
def g9_edges_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chapter_edges(_trio(spark, sf_dir))


G12_SQL = f"""
WITH {_EDGES}, co AS (SELECT book_id, count(DISTINCT relation_type) AS kinds, count(*) FILTER (relation_type = 'parallel') AS parallel, count(*) AS m FROM ed GROUP BY book_id),
fine AS (SELECT book_id FROM co WHERE kinds >= 3 AND parallel <= greatest(8.0::DOUBLE, m * 0.85::DOUBLE)),
ld AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY node_ord) AS k FROM n WHERE book_id NOT IN (SELECT book_id FROM fine)) WHERE k <= 80),
more AS (SELECT * FROM (WITH {_inferred_sql("book_id", "ld")} SELECT * FROM inf) f WHERE relation_type <> 'parallel' AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.source = f.source AND ed.target = f.target AND ed.relation_type = f.relation_type))
SELECT book_id, source, target, relation_type, description FROM ed
UNION ALL SELECT book_id, source, target, relation_type, description FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY i, j) AS nth FROM more) WHERE nth <= 24
"""


@query(G12_SQL)
def g12_enriched_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _trio(spark, sf_dir)
    return R.enrich_relations(nodes, R.chapter_edges(nodes)).select("book_id", "source", "target", "relation_type", "description")


#: The nodes of chapters, with as many of their pairs' relations as a chapter keeps.
_REAL = f"""{_NODES}, n AS MATERIALIZED (SELECT book_id, chapter_id, node_id, node_ord, name, definition, method, source_text AS src FROM nd), {_inferred_sql("chapter_id", "n")}"""
_KEPT = f"""{_REAL}, ed AS MATERIALIZED (SELECT * FROM (SELECT inf.*, row_number() OVER (PARTITION BY chapter_id ORDER BY i, j) AS nth, most FROM inf JOIN (SELECT chapter_id, greatest(4, count(*)) AS most FROM n GROUP BY ALL) USING (chapter_id)) WHERE nth <= most)"""


@query(f"WITH {_REAL} SELECT source, target, relation_type, description FROM inf")
def g8_infer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return R.infer_relations(R.pairs_within(nodes, ["book_id", "chapter_id"])).select("source", "target", "relation_type", "description")


@query(f"WITH {_KEPT} SELECT source, target, description FROM ed WHERE relation_type = 'parallel'")
def g7_parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chapter_edges(_nodes(spark, sf_dir)).filter("relation_type = 'parallel'").select("source", "target", "description")


@query(f"WITH {_KEPT} SELECT book_id, source, target, relation_type FROM ed")
def g9_chapter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chapter_edges(_nodes(spark, sf_dir)).select("book_id", "source", "target", "relation_type")


@query()
def g12_book_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return G.book_edges(nodes, G.book_nodes(nodes)).select("book_id", "source", "target", "relation_type", "description")


# Questions ---------------------------------------------------------------------------------------

_FIT = rf"""NOT regexp_matches(text, '{L.SOURCE_BLOCKLIST}') AND page > 23 AND NOT regexp_full_match({strip_sql("chapter")}, '第[一二三四五六七八九十\d]+章') AND NOT regexp_full_match(chapter, '.+_\d+')"""
_SOURCE = f"SELECT * FROM ({corpus_sql(True)}) WHERE {_FIT}"


@query(f"SELECT chunk_id, page FROM ({_SOURCE})")
def b1_source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.source_chunks(corpus(spark, sf_dir, True)).select("chunk_id", "page")


@query(Q.chunk_terms_sql(corpus_sql(True)))
def b2_candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_terms(B.V.spread(corpus(spark, sf_dir, True), "chunk_id"))


@query(f"SELECT doc_id, pos, term, {Q.valid_term_sql('term')} AS valid FROM (SELECT doc_id, pos, {Q.normalize_term_sql('piece')} AS term FROM ({_PIECES}))")
def b3_valid_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("doc_id", "pos", K.normalize_term(F.col("piece")).alias("term")).withColumn("valid", K.is_valid_term(F.col("term")))


_TURNS = f"SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, chapter, chunk_id) AS turn FROM ({_SOURCE})"
_SEEDS = ", ".join(f"'{s}'" for s in L.SEEDS)


@query(f"""WITH src AS (SELECT * FROM ({_SOURCE})), own AS (SELECT term, book_id FROM ({Q.chunk_terms_sql('SELECT chunk_id, text FROM src')}) JOIN src USING (chunk_id)),
seed AS (SELECT book_id, unnest([s for s in [{_SEEDS}] if contains(text, s)]) AS term FROM src)
SELECT term, count(DISTINCT book_id) AS n_books FROM (SELECT * FROM own UNION ALL SELECT term, book_id FROM seed) GROUP BY term""")
def b4_term_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.term_sources(B.source_chunks(corpus(spark, sf_dir, True)))


@query(f"""
WITH h AS (SELECT book_id, turn, unnest([i for s, i in [{_SEEDS}] if contains(text, s)]) AS seed FROM ({_TURNS})), f AS (SELECT book_id, seed, min(turn) AS turn FROM h GROUP BY ALL)
SELECT book_id, [{_SEEDS}][seed] AS term, row_number() OVER (PARTITION BY book_id ORDER BY turn, seed)::INTEGER AS place FROM f
""")
def b5_seed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.book_terms(B.seed_hits(B.interleaved(B.source_chunks(corpus(spark, sf_dir, True)))))


@query(f"WITH {_NODES}, gt0 AS (SELECT DISTINCT book_id, {Q.graph_term_sql('name', 'source_text')} AS term FROM nd) SELECT book_id, term, row_number() OVER (PARTITION BY book_id ORDER BY length(term) DESC, term) AS place FROM gt0 WHERE term IS NOT NULL")
def b6_graph_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.graph_terms(_nodes(spark, sf_dir)).select("book_id", "term", F.col("place").cast("long").alias("place"))


@query(f"SELECT chunk_id, book_id, turn FROM ({_TURNS})")
def b7_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.interleaved(B.source_chunks(corpus(spark, sf_dir, True))).select("chunk_id", "book_id", F.col("turn").cast("long").alias("turn"))


@query()
def b8_generate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return B.generate_questions(corpus(spark, sf_dir, True), G.book_nodes(nodes), 30)


_FIRST_TERMS = Q.chunk_terms_sql("SELECT chapter_id AS chunk_id, content AS text FROM fc")
_FALLBACK_HINT = strip_sql(cjk_sql("CASE WHEN pos > 0 THEN substring(content, greatest(1, pos - 60), 160 + least(pos - 1, 60)) ELSE substring(content, 1, 160) END"))


@query(f"""WITH fc AS MATERIALIZED ({chapters_sql(True)}), ft AS (SELECT chunk_id AS chapter_id, term FROM ({_FIRST_TERMS}) WHERE pos = 0),
fn AS (SELECT fc.*, coalesce(term, ({terms_sql('title')})[1]) AS term FROM fc LEFT JOIN ft USING (chapter_id)),
fo AS (SELECT *, row_number() OVER (ORDER BY book_id, chapter_ord) AS k, strpos(content, term) AS pos FROM fn WHERE term IS NOT NULL)
SELECT 'q_' || printf('%03d', k) AS question_id, replace('{L.TEMPLATES["fact"]}', '{{term}}', term) AS question, 'fact' AS kind, book_id AS expected_book, title AS expected_chapter, page_start AS expected_page, '' AS expected_chunk_id,
  [term] AS expected_terms, {_FALLBACK_HINT} AS answer_hint FROM fo WHERE k <= 30""")
def b9_fallback_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fallback_questions(chapters(spark, sf_dir, True), 30)


_HINT = strip_sql(cjk_sql("CASE WHEN pos > 0 THEN substring(x, greatest(1, pos - 60), 160 + least(pos - 1, 60)) ELSE substring(x, 1, 160) END"))


@query(f"SELECT doc_id, {_HINT} AS hint FROM (SELECT doc_id, x, strpos(x, '红细胞') AS pos FROM (SELECT doc_id, {_ZH} AS x FROM documents))")
def b10_answer_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", B.answer_hint(projected(F.coalesce("text", F.lit(""))), F.lit("红细胞")).alias("hint"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in a document ask for the chapter of the first such document. The rows are kept, as an evaluation reads them several times and each of them takes a pass over all documents."""
    asked = questions(spark, sf_dir).filter("question <> ''")
    docs = chapters(spark, sf_dir)
    inside = dictionary_join(docs, "content", asked, "question")
    first = inside.groupBy("question").agg(F.min(F.struct("chapter_ord", "book_id", "title")).alias("f"))
    words = F.slice(F.filter(F.split("question", " "), lambda w: F.length(w) > 5), 1, 3)
    return cut(asked.join(first, "question").select("question_id", "question", F.col("f.book_id").alias("expected_book"), F.col("f.title").alias("expected_chapter"), F.lit("").alias("expected_chunk_id"), words.alias("expected_terms")))


def _expected_sql() -> str:
    return f"""x AS MATERIALIZED (SELECT question_id, question, [w for w in string_split(question, ' ') if length(w) > 5][1:3] AS terms, book_id AS expected_book, title AS expected_chapter FROM (
  SELECT q.question_id, question, c.book_id, c.title, row_number() OVER (PARTITION BY q.question_id ORDER BY chapter_ord) AS nth FROM q JOIN ({chapters_sql()}) c ON question <> '' AND contains(content, question)) WHERE nth = 1)"""


def _eval_sql(config: RetrievalConfig = CONFIG) -> str:
    hits = f"""{answers_sql(False, config)}, {_expected_sql()},
hit AS (SELECT h.question_id, h.rank, h.chunk_id, length(text) AS n, book_id = expected_book AND chapter = expected_chapter AND len([t for t in terms if contains(text, t)]) > 0 AS hit FROM h JOIN x USING (question_id))"""
    return hits.replace(ranked_sql(False, True, config), ranked_sql(False, False, config))


_EVAL = _eval_sql()


@query(f"WITH {_EVAL} SELECT question_id, rank, chunk_id, hit FROM hit")
def b12_chunk_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = corpus(spark, sf_dir), _expected(spark, sf_dir)
    return B.chunk_matches(retrieve(chunks, asked.select("question_id", "question"), CONFIG, False), chunks, asked).select("question_id", "rank", "chunk_id", "hit")


def _metrics_sql(config: RetrievalConfig = CONFIG) -> str:
    return f"""{_eval_sql(config)},
tok AS (SELECT x.question_id, greatest(1, (length(x.question) + 1 + coalesce(sum(n) + 2 * (count(n) - 1), 0)) // 2)::BIGINT AS tokens, min(rank) FILTER (hit) AS rank FROM x LEFT JOIN hit USING (question_id) GROUP BY x.question_id, x.question),
ans AS (SELECT x.question_id, len([t for t in terms if contains(coalesce(evidence, opening, '{L.NO_ANSWER}'), t)]) > 0 AND contains(coalesce(evidence, opening, '{L.NO_ANSWER}'), expected_book) AS told FROM x LEFT JOIN v USING (question_id)),
met AS (SELECT '{B.config_name(config)}' AS config_name, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE), 4) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr, round(avg(told::INTEGER), 4) AS answer_accuracy,
  round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS citation_accuracy, round(avg(told::INTEGER), 4) AS evidence_hit_rate, round(avg(tokens), 2) AS avg_context_tokens, sum(tokens)::BIGINT AS estimated_token_cost, count(*) AS question_count FROM tok JOIN ans USING (question_id))"""


_METRICS = _metrics_sql()


@query(f"WITH {_METRICS} SELECT * FROM met")
def b13_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.evaluate(corpus(spark, sf_dir), _expected(spark, sf_dir), CONFIG, B.config_name(CONFIG))


#: One configuration of each analyzer, each rerank and two ways to cut.
_SOME = [c for c in B.grid() if B.config_name(c) in ("chunk800_ov60_char_wb_2_4_base", "chunk1200_ov80_char_2_5_phrase", "chunk1200_ov80_char_wb_2_4_phrase")]


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {sql} SELECT * FROM met)" for sql in map(_metrics_sql, _SOME)))
def b13_evaluate_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three configurations in one scan."""
    return B.evaluate_grid(chapters(spark, sf_dir), _expected(spark, sf_dir), _SOME)


@query(f"WITH {_METRICS} SELECT question_id, tokens FROM tok")
def b14_context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = corpus(spark, sf_dir), _expected(spark, sf_dir)
    ranked = retrieve(chunks, asked.select("question_id", "question"), CONFIG, False)
    return B.context_tokens(V.with_texts(ranked, chunks, ["chunk_id"], ["text"]), asked)


@query("""
SELECT 'chunk' || size || '_ov' || ov || '_' || an || '_' || CASE WHEN ph THEN 'phrase' ELSE 'base' END AS config_name, size::INTEGER AS chunk_size, ov::INTEGER AS overlap, 5 AS top_k, an AS analyzer, round(CASE WHEN ph THEN 0.48 ELSE 0.6 END::DOUBLE, 9) AS tfidf_weight,
  round(CASE WHEN ph THEN 0.27 ELSE 0.4 END::DOUBLE, 9) AS bm25_weight, round(CASE WHEN ph THEN 0.25 ELSE 0 END::DOUBLE, 9) AS phrase_weight, ph AS phrase_rerank, count(DISTINCT d.doc_id) AS n_documents, sum(greatest(0, ceil((length(x) - ov) / (size - ov)::DOUBLE)))::BIGINT AS n_steps
FROM unnest([300, 500, 800, 1200]) a(size), unnest([60, 80, 100]) b(ov), unnest(['char_wb_2_4', 'char_2_5']) c(an), unnest([false, true]) e(ph), (SELECT doc_id, coalesce(text, '') AS x FROM documents) d GROUP BY ALL
""")
def b11_config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid, with the steps that each chunking takes over the documents."""
    sizes = chapters(spark, sf_dir).select(F.length("content").alias("n"))
    grid = B.config_grid(spark)
    ways = grid.select("chunk_size", "overlap").distinct()
    steps = sizes.join(F.broadcast(ways)).groupBy("chunk_size", "overlap").agg(  # twelve rows
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.greatest(F.lit(0), F.ceil((F.col("n") - F.col("overlap")) / (F.col("chunk_size") - F.col("overlap"))))).cast("long").alias("n_steps")
    )
    rounded = {c: F.round(c, 9) for c in ("tfidf_weight", "bm25_weight", "phrase_weight")}
    return grid.drop("min_score").withColumns(rounded).join(steps, ["chunk_size", "overlap"])


@query()
def b15_choose_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of the whole grid: twelve ways to cut, each for two analyzers, each with and without the rerank, in one scan."""
    return B.choose_best(B.evaluate_grid(chapters(spark, sf_dir), _expected(spark, sf_dir), B.grid()))
