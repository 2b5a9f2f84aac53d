"""Queries: grams, TF-IDF, BM25, phrases, ranking and answers; passages of ``benchmark`` are the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave import lexicon
from tomeweave.operators import retrieval as V
from tomeweave.operators import scan as S
from tomeweave.operators import simjoin as J
from tomeweave.operators.chunks import RetrievalConfig, build_chunks
from tomeweave.plans.corpus import chunks_sql
from tomeweave.plans.tables import chapters, chapters_sql, cjk_sql, projected, projected_sql, strip_sql, table
from tomeweave.registry import query

CONFIG = RetrievalConfig()


def questions(spark: SparkSession, sf_dir: str, chinese: bool = False) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    asked = F.concat(projected(text), F.lit("的定义是什么")) if chinese else text
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), asked.alias("question"))


def questions_sql(chinese: bool = False) -> str:
    asked = projected_sql("coalesce(text, '')") + " || '的定义是什么'" if chinese else "coalesce(text, '')"
    return f"SELECT item_id AS question_id, {asked} AS question FROM benchmark"


def corpus(spark: SparkSession, sf_dir: str, chinese: bool = False) -> DataFrame:
    return build_chunks(chapters(spark, sf_dir, chinese), CONFIG)


def corpus_sql(chinese: bool = False) -> str:
    return chunks_sql(CONFIG.chunk_size, CONFIG.overlap, chapters_sql(chinese))


def grams_sql(source: str, key: str, text: str, analyzer: str = "char_2_5") -> str:
    """(key, gram, tf) of a relation."""
    plain = rf"regexp_replace(lower({text}), '\s\s+', ' ', 'g')"
    if analyzer == "char_2_5":
        base, sizes = f"SELECT {key}, {plain} AS x FROM ({source})", range(2, 6)
    else:
        base, sizes = rf"SELECT {key}, ' ' || w || ' ' AS x FROM (SELECT {key}, unnest(string_split_regex({strip_sql(plain)}, '\s+')) AS w FROM ({source})) WHERE w <> ''", range(2, 5)
    each = " UNION ALL ".join(f"SELECT {key}, substring(x, unnest(range(1, length(x) - {n - 2}))::BIGINT, {n}) AS gram FROM ({base})" for n in sizes)
    return f"SELECT {key}, gram, count(*) AS tf FROM ({each}) GROUP BY ALL"


def _shape(counts: DataFrame, key: str) -> DataFrame:
    """Of each text the number of grams, the most frequent count, and the first and last gram."""
    return counts.groupBy(key).agg(F.count(F.lit(1)).alias("n_grams"), F.sum("tf").alias("total"), F.max("tf").alias("most"), F.min("gram").alias("first_gram"), F.max("gram").alias("last_gram"))


_SHAPE = "SELECT doc_id, count(*) AS n_grams, sum(tf)::BIGINT AS total, max(tf) AS most, min(gram) AS first_gram, max(gram) AS last_gram FROM (%s) GROUP BY doc_id"


@query(_SHAPE % grams_sql("SELECT * FROM documents WHERE text IS NOT NULL", "doc_id", "text"))
def v1_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(V.gram_counts(table(spark, sf_dir, "documents"), "doc_id", "char_2_5"), "doc_id")


@query(_SHAPE % grams_sql("SELECT * FROM documents WHERE text IS NOT NULL", "doc_id", "text", "char_wb_2_4"))
def v2_char_wb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(V.gram_counts(table(spark, sf_dir, "documents"), "doc_id", "char_wb_2_4"), "doc_id")


#: Index of the chunks: g (grams), n, f (df), w (weights), norm.
def index_sql(source: str, analyzer: str = "char_2_5", key: str = "chunk_id", text: str = "text") -> str:
    return f"""src AS MATERIALIZED ({source}), g AS MATERIALIZED ({grams_sql("SELECT * FROM src", key, text, analyzer)}), n AS (SELECT count(*) AS n FROM src), f AS MATERIALIZED (SELECT gram, count(*) AS df FROM g GROUP BY gram),
w AS (SELECT {key}, gram, tf, tf * (ln((1.0::DOUBLE + n) / (df + 1)) + 1) AS w FROM g JOIN f USING (gram), n), norm AS MATERIALIZED (SELECT {key}, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL)"""


@query(f"WITH {index_sql(corpus_sql())} SELECT chunk_id, count(*) AS n_grams, round(max(w / norm), 6) AS heaviest, round(sum(w / norm), 6) AS total FROM w JOIN norm USING (chunk_id) GROUP BY chunk_id")
def v3_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = V.tfidf(V.build_index(corpus(spark, sf_dir), "chunk_id", "char_2_5"))
    return weighted.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum("weight"), 6).alias("total"))


def _tokens_sql(source: str, key: str, text: str) -> str:
    """(key, gram, tf): Latin words, CJK characters, and 2- to 5-grams of CJK runs."""
    words = f"SELECT {key}, unnest(regexp_extract_all(lower({text}), '[A-Za-z0-9]+|[一-鿿]')) AS gram FROM ({source})"
    runs = f"SELECT {key}, unnest(regexp_extract_all({text}, '[一-鿿]{{2,}}')) AS x FROM ({source})"
    each = " UNION ALL ".join([words, *(f"SELECT {key}, substring(x, unnest(range(1, length(x) - {n - 2}))::BIGINT, {n}) FROM ({runs})" for n in range(2, 6))])
    return f"SELECT {key}, gram, count(*) AS tf FROM ({each}) GROUP BY ALL"


@query(_SHAPE % _tokens_sql(f"SELECT doc_id, {projected_sql('text')} AS text FROM documents WHERE text IS NOT NULL", "doc_id", "text"))
def v5_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", projected(F.col("text")).alias("text"))
    return _shape(V.gram_counts(rows, "doc_id", "tokens"), "doc_id")


def terms_sql(question: str) -> str:
    """Array of up to eight terms."""
    plain = "x"
    for word in sorted(lexicon.QUESTION_STOPWORDS, key=lambda w: (-len(w), w)):
        plain = f"replace({plain}, '{word}', '')"
    plain = f"regexp_replace({plain}, '^[的是了呢吗呀]+|[的是了呢吗呀]+$', '', 'g')"
    stop = ", ".join(f"'{w}'" for w in lexicon.QUESTION_STOPWORDS)
    tokens = f"[{plain} for x in [lower(y) for y in regexp_extract_all({question}, '[一-鿿A-Za-z0-9]+')] if length(x) >= 2 AND x NOT IN ({stop})]"
    terms = f"list_distinct(list_concat([z for z in {tokens} if length(z) >= 2], regexp_extract_all({question}, '[A-Za-z][A-Za-z0-9-]{{1,}}')))"
    return f"[s.t for s in list_sort([{{'n': -length(t), 't': t}} for t in {terms}])][1:8]"


@query(f"SELECT doc_id, array_to_string({terms_sql('q')}, ' ') AS terms FROM (SELECT doc_id, {projected_sql('coalesce(text, chr(32))')} || '的定义是什么' AS q FROM documents)")
def v7_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.concat(projected(F.coalesce("text", F.lit(" "))), F.lit("的定义是什么"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(V.query_terms(question), " ").alias("terms"))


def scores_sql(chinese: bool = False, fit_question: bool = False, config: RetrievalConfig = CONFIG) -> str:
    """CTEs up to ``s`` (question_id, chunk_id, tfidf, bm25, phrase) with BM25 as it is, and ``top`` by question."""
    extra = 1 if fit_question else 0
    idf = f"(ln((1.0::DOUBLE + n + {extra}) / (coalesce(df, 0) + 1 + {extra})) + 1)"
    base = f"(ln((1.0::DOUBLE + n + {extra}) / (df + 1)) + 1)"
    known = "" if fit_question else "WHERE df IS NOT NULL"
    cut_sql = chunks_sql(config.chunk_size, config.overlap, chapters_sql(chinese))
    return f"""{index_sql(cut_sql, config.analyzer)}, q AS MATERIALIZED ({questions_sql(chinese)}),
qg AS (SELECT question_id, gram, tf, df, tf * {idf} AS w FROM ({grams_sql("SELECT * FROM q", "question_id", "question", config.analyzer)}) LEFT JOIN f USING (gram), n {known}),
qn AS (SELECT question_id, sqrt(sum(w * w)) AS qnorm FROM qg GROUP BY ALL),
dn AS (SELECT chunk_id, sum(tf * tf * {base} * {base}) AS square FROM g JOIN f USING (gram), n GROUP BY ALL),
co AS (
  SELECT question_id, chunk_id, sum(qg.w * g.tf * {idf.replace("coalesce(df, 0)", "qg.df")}) AS dot, sum(g.tf * g.tf * (pow({idf.replace("coalesce(df, 0)", "qg.df")}, 2) - pow({base.replace("df", "qg.df")}, 2))) AS more
  FROM qg JOIN g USING (gram), n GROUP BY ALL
), ti AS (SELECT question_id, chunk_id, dot / qnorm / sqrt(square{" + more" if fit_question else ""}) AS tfidf FROM co JOIN qn USING (question_id) JOIN dn USING (chunk_id)),
tk AS MATERIALIZED ({_tokens_sql("SELECT * FROM src", "chunk_id", "text")}), td AS (SELECT gram, count(*) AS df FROM tk GROUP BY gram), tl AS (SELECT chunk_id, sum(tf) AS dl FROM tk GROUP BY ALL),
tn AS (SELECT (SELECT n FROM n) AS n, (SELECT sum(dl) FROM tl)::DOUBLE / (SELECT n FROM n) AS mean_dl),
ti0 AS (SELECT gram, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM td, tn), tif AS (SELECT gram, CASE WHEN idf >= 0 THEN idf ELSE 0.25::DOUBLE * (SELECT avg(idf) FROM ti0) END AS idf FROM ti0),
bm AS (
  SELECT question_id, tk.chunk_id, sum(qt.tf * idf * (tk.tf * 2.5::DOUBLE / (tk.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl)))) AS bm25
  FROM ({_tokens_sql("SELECT * FROM q", "question_id", "question")}) qt JOIN tif USING (gram) JOIN tk USING (gram) JOIN tl USING (chunk_id), tn GROUP BY ALL
), qw AS (SELECT question_id, unnest({terms_sql("question")}) AS term FROM q),
ph AS (
  SELECT question_id, chunk_id, least(1.0::DOUBLE, sum(least(1.0::DOUBLE, 0.55::DOUBLE + 0.18::DOUBLE * c + 0.03::DOUBLE * least(length(term), 8)))) AS phrase
  FROM (SELECT question_id, chunk_id, term, (length(text) - length(replace(text, term, ''))) // length(term) AS c FROM qw JOIN src ON contains(text, term)) GROUP BY ALL
), s AS MATERIALIZED (
  SELECT question_id, chunk_id, coalesce(tfidf, 0) AS tfidf, coalesce(bm25, 0) AS bm25, coalesce(phrase, 0) AS phrase FROM ti FULL JOIN bm USING (question_id, chunk_id) FULL JOIN ph USING (question_id, chunk_id)
), top AS (
  SELECT question_id, CASE WHEN count(*) FILTER (bm25 <> 0) < (SELECT n FROM n) THEN greatest(max(bm25) FILTER (bm25 <> 0), 0) ELSE max(bm25) END AS most FROM s GROUP BY question_id
)"""


def ranked_sql(chinese: bool = False, fit_question: bool = True, config: RetrievalConfig = CONFIG) -> str:
    """CTEs up to ``r`` (question_id, rank, chunk_id, score)."""
    a, b, c = config.weights
    return f"""{scores_sql(chinese, fit_question, config)},
r0 AS (SELECT question_id, chunk_id, {a!r}::DOUBLE * tfidf + {b!r}::DOUBLE * (bm25 / CASE WHEN coalesce(most, 0) = 0 THEN 1 ELSE most END) + {c!r}::DOUBLE * phrase AS raw, round(raw, 9) AS score FROM s JOIN top USING (question_id)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM r0), r AS MATERIALIZED (SELECT question_id, rank, chunk_id, score FROM r1 WHERE rank <= {config.top_k} AND score > {config.min_score})"""


def _scores(spark: SparkSession, sf_dir: str, fit_question: bool) -> DataFrame:
    chunks = corpus(spark, sf_dir)
    return V.all_scores(chunks, questions(spark, sf_dir), V.build_index(chunks, "chunk_id", "char_2_5"), V.build_bm25(chunks), fit_question)


@query(f"WITH {scores_sql()} SELECT question_id, chunk_id, round(tfidf, 6) AS cosine FROM s WHERE tfidf <> 0")
def v4_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, False).filter("tfidf <> 0").select("question_id", "chunk_id", F.round("tfidf", 6).alias("cosine"))


@query(f"WITH {scores_sql(fit_question=True)} SELECT question_id, chunk_id, round(tfidf, 6) AS cosine FROM s WHERE tfidf <> 0")
def v4_cosine_with_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, True).filter("tfidf <> 0").select("question_id", "chunk_id", F.round("tfidf", 6).alias("cosine"))


@query(f"WITH {scores_sql()} SELECT question_id, chunk_id, round(bm25 / CASE WHEN most = 0 THEN 1 ELSE most END, 6) AS bm25 FROM s JOIN top USING (question_id) WHERE bm25 <> 0")
def v6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scores(spark, sf_dir, False)
    n = corpus(spark, sf_dir).count()
    most = found.groupBy("question_id").agg(F.when(F.count(F.when(F.col("bm25") != 0, 1)) < n, F.greatest(F.max("bm25"), F.lit(0.0))).otherwise(F.max("bm25")).alias("most"))
    share = F.col("bm25") / F.when(F.col("most") == 0, F.lit(1.0)).otherwise(F.col("most"))
    return found.filter("bm25 <> 0").join(most, "question_id").select("question_id", "chunk_id", F.round(share, 6).alias("bm25"))


@query(f"WITH {scores_sql()} SELECT question_id, chunk_id, round(phrase, 6) AS phrase FROM s WHERE phrase <> 0")
def v8_phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, False).filter("phrase <> 0").select("question_id", "chunk_id", F.round("phrase", 6).alias("phrase"))


@query(f"WITH {ranked_sql()} SELECT question_id, chunk_id, round(raw, 5) AS score FROM r0")
def v9_hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (a, b, c) = _scores(spark, sf_dir, True), CONFIG.weights
    top = found.groupBy("question_id").agg(F.greatest(F.max("bm25"), F.lit(0.0)).alias("most"))
    share = F.col("bm25") / F.when(F.col("most") == 0, F.lit(1.0)).otherwise(F.col("most"))
    return found.join(top, "question_id").select("question_id", "chunk_id", F.round(F.col("tfidf") * a + share * b + F.col("phrase") * c, 5).alias("score"))


@query(f"WITH {ranked_sql()} SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM r")
def v10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.retrieve(corpus(spark, sf_dir), questions(spark, sf_dir), CONFIG).withColumn("score", F.round("score", 6))


def _alternatives(words: tuple[str, ...]) -> str:
    return "'" + "|".join(words) + "'"


def sentence_sql(text: str, term: str, question: str) -> str:
    plain = strip_sql(rf"regexp_replace({text}, '\s+', ' ', 'g')")
    asks = f"regexp_matches({question}, {_alternatives(lexicon.DEFINITION_QUESTION)})"
    # The split keeps the mark with its sentence: a line break is put behind each mark first.
    parts = rf"string_split(regexp_replace({plain}, '([。！？；;])\s*', '\1' || chr(10), 'g'), chr(10))"
    cue = f"CASE WHEN {asks} AND regexp_matches(x, {_alternatives(lexicon.DEFINITION_CUES)}) THEN 0 ELSE 1 END + CASE WHEN {asks} AND regexp_matches(x, {_alternatives(lexicon.ACTION_CUES)}) THEN 1 ELSE 0 END"
    ranked = f"list_sort([{{'p': {cue}, 'd': abs(length(x) - 120), 'n': length(x), 'i': i, 'x': x}} for x, i in {parts} if contains(x, {term})])"
    at = f"strpos({plain}, {term})"
    return f"coalesce(substring(({ranked})[1].x, 1, 260), CASE WHEN {at} > 0 THEN substring({plain}, greatest(1, {at} - 90), 170 + least({at} - 1, 90)) ELSE '' END)"


@query(f"SELECT chunk_id, {sentence_sql('text', chr(39) + '红细胞' + chr(39), chr(39) + '红细胞的定义是什么' + chr(39))} AS defined, {sentence_sql('text', chr(39) + '激素' + chr(39), chr(39) + '激素有哪些' + chr(39))} AS other FROM ({corpus_sql(True)})")
def v11_best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda term, question: V.best_sentence(F.col("text"), F.lit(term), F.lit(question))
    return corpus(spark, sf_dir, True).select("chunk_id", best("红细胞", "红细胞的定义是什么").alias("defined"), best("激素", "激素有哪些").alias("other"))


def answers_sql(chinese: bool, config: RetrievalConfig = CONFIG) -> str:
    place = "' [' || book_id || ', ' || chapter || ', 第' || page || '页]'"
    return f"""{ranked_sql(chinese, config=config)},
h AS (SELECT r.*, book_id, chapter, page, text, question, [t for t in {terms_sql("question")} if contains(text, t)][1] AS term FROM r JOIN src USING (chunk_id) JOIN q USING (question_id)),
e AS (SELECT *, CASE WHEN term IS NOT NULL THEN {sentence_sql("text", "term", "question")} ELSE '' END AS sentence FROM h),
v AS (SELECT question_id, arg_min({strip_sql(cjk_sql("sentence"))} || {place}, rank) FILTER (sentence <> '') AS evidence, arg_min(substring(text, 1, 260) || '...' || {place}, rank) AS opening,
  list(book_id || '|' || chapter || '|' || page || '|' || printf('%.4f', round(score, 4)) ORDER BY rank) AS citations, list(text ORDER BY rank) AS source_chunks FROM e GROUP BY question_id)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = corpus(spark, sf_dir, True), questions(spark, sf_dir, True)
    return V.answers(S.retrieve(chunks, asked, CONFIG), chunks, asked)


@query(f"WITH {answers_sql(True)} SELECT q.question_id, coalesce(evidence, opening, '{lexicon.NO_ANSWER}') AS answer FROM q LEFT JOIN v USING (question_id)")
def v12_evidence_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("question_id", "answer")


@query(f"WITH {answers_sql(True)} SELECT q.question_id, coalesce(evidence, opening, '{lexicon.NO_ANSWER}') AS answer, coalesce(citations, []) AS citations, coalesce(source_chunks, []) AS source_chunks FROM q LEFT JOIN v USING (question_id)")
def v13_answers_with_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir)


# Similar nodes: the first line of every document names a node of its source. --------------------------


def name_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.coalesce(F.element_at(F.split("text", r"\."), 1), F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("doc_id").alias("node_ord"), F.col("source").alias("book_id"), first.alias("name"), F.lit("").alias("definition"))


_NAMES = "SELECT doc_id AS node_id, source AS book_id, coalesce(string_split(text, '.')[1], '') || ' ' AS text FROM documents"
_VECTORS = f"""{index_sql(_NAMES, "char_wb_2_4", "node_id")}, u AS MATERIALIZED (SELECT node_id, gram, w / norm AS weight FROM w JOIN norm USING (node_id)),
pairs AS (SELECT a.node_id AS a, b.node_id AS b, sum(a.weight * b.weight) AS cosine FROM u a JOIN u b ON a.gram = b.gram AND a.node_id < b.node_id GROUP BY ALL HAVING sum(a.weight * b.weight) >= 0.62::DOUBLE),
other AS (SELECT pairs.* FROM pairs JOIN src x ON x.node_id = a JOIN src y ON y.node_id = b WHERE x.book_id <> y.book_id)"""


@query(f"WITH {_VECTORS} SELECT node_id, gram, round(weight, 6) AS weight FROM u")
def i2_name_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.name_vectors(name_nodes(spark, sf_dir)).select("node_id", "gram", F.round("weight", 6).alias("weight"))


@query(f"WITH {_VECTORS} SELECT a, b, round(cosine, 6) AS cosine FROM other")
def i3_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.similar_pairs(name_nodes(spark, sf_dir)).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH {_VECTORS}, ends AS (SELECT a AS node_id FROM other UNION ALL SELECT b FROM other), links AS (SELECT node_id, count(*) AS n FROM ends GROUP BY ALL)
SELECT src.node_id, min(src.node_id) OVER (PARTITION BY text) AS class_id, coalesce(n, 0) AS n_links FROM src LEFT JOIN links USING (node_id)""")
def i3_similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of i3_similar_pairs as classes and numbers of links."""
    return J.similar_classes(name_nodes(spark, sf_dir))[0]


@query()
def i4_leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.clusters(name_nodes(spark, sf_dir))
