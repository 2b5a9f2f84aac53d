"""Queries: files, cleaning, chapters and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave import lexicon
from tomeweave.functions import text as T
from tomeweave.functions.text import CJK
from tomeweave.operators import chapters as P
from tomeweave.operators.places import placed
from tomeweave.operators.chunks import RetrievalConfig, build_chunks, index_status, split_text, write_index
from tomeweave.operators.lineage import shared_folder
from tomeweave.operators.retrieval import spread
from tomeweave.plans.tables import LINES_SQL, chapters, chapters_sql, cjk_sql, lines, projected, projected_sql, strip_sql, table
from tomeweave.registry import query
from tomeweave.sources import files as S
from tomeweave.streaming.intake import append_chunks, append_documents, arriving

# Files -------------------------------------------------------------------------------------------

_NAME = r"regexp_extract(url, '([^/]*)/*$', 1)"
_SUFFIX = rf"lower(regexp_extract({_NAME}, '^.+(\.[^.]+)$', 1))"


@query(rf"""
SELECT page_id, {_SUFFIX} AS suffix, CASE WHEN known THEN 'pending' ELSE 'failed' END AS status, CASE WHEN NOT known THEN 'Unsupported file type: ' || {_SUFFIX} END AS error
FROM (SELECT *, {_SUFFIX} IN ('.md', '.markdown', '.txt', '.pdf', '.docx') AS known FROM pages)
""")
def s2_flag_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flag_unsupported(table(spark, sf_dir, "pages"), "url").select("page_id", "suffix", "status", "error")


@query(f"""
SELECT doc_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 'no text' END AS error
FROM (SELECT doc_id, coalesce({strip_sql("text")}, '') = '' AS bad FROM documents)
""")
def s3_isolate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.isolate_failures(table(spark, sf_dir, "documents"), "text").select("doc_id", "status", "error")


@query(rf"""
SELECT page_id, CASE WHEN length({_NAME}) > 1 THEN regexp_replace({_NAME}, '^(.+)\.[^.]+$', '\1') ELSE {_NAME} END AS title,
  CASE WHEN {strip_sql("safe")} = '' THEN 'upload' ELSE {strip_sql("safe")} END AS safe_name
FROM (SELECT *, regexp_replace(url, '[^\p{{L}}\p{{N}}._\-（）()\[\]【】 ]', '_', 'g') AS safe FROM pages)
""")
def s4_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.infer_title(url).alias("title"), T.safe_filename(url).alias("safe_name"))


@query(f"SELECT doc_id FROM documents WHERE coalesce({strip_sql('text')}, '') <> ''")
def s3_completed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.completed(S.isolate_failures(table(spark, sf_dir, "documents"), "text")).select("doc_id")


@query(f"SELECT book_id, chapter_id, length(content) AS char_count FROM ({chapters_sql()}) WHERE book_id <> 'src0'")
def s8_remove_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = S.remove_book({"chapters": chapters(spark, sf_dir)}, "src0")["chapters"]
    return left.select("book_id", "chapter_id", F.length("content").cast("long").alias("char_count"))


def _written(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT '.txt' AS suffix, sha1(coalesce(text, '') || chr(10)) AS digest, count(*) AS n FROM documents GROUP BY ALL")
def s1_read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is written as a text file of its own and read again. The files lie in one folder: a folder for each would be made, moved and listed, too."""
    path = _written(spark, "corpus")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value")), "doc_id").select("value")
    docs.write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)  # each task moves its own files
    return S.read_corpus(spark, path).groupBy("suffix", F.sha1("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT 'chapters' AS name, book_id, chapter_id, length(content) AS n, 1 AS page_end FROM ({chapters_sql()}) WHERE book_id <> 'src0'
UNION ALL SELECT 'items', '', item_id::VARCHAR, length(text), 0 FROM benchmark
""")
def s5_write_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state is written and replaced by another; a column and a table that the state lacks come from their defaults."""
    path, own = _written(spark, "tables"), chapters(spark, sf_dir).drop("page_end")
    S.write_tables({"chapters": own}, path)
    S.write_tables({"chapters": own.filter("book_id <> 'src0'"), "items": table(spark, sf_dir, "benchmark")}, path)
    again = S.read_tables(spark, path, ["chapters", "items", "nodes"], {"chapters": {"page_end": ("int", 1)}, "nodes": {"book_id": ("string", ""), "name": ("string", "")}})
    own = again["chapters"].select(F.lit("chapters").alias("name"), "book_id", "chapter_id", F.length("content").cast("long").alias("n"), "page_end")
    items = again["items"].select(F.lit("items").alias("name"), F.lit("").alias("book_id"), F.col("item_id").cast("string").alias("chapter_id"), F.length("text").cast("long").alias("n"), F.lit(0).alias("page_end"))
    none = again["nodes"].select(F.lit("nodes").alias("name"), "book_id", F.col("name").alias("chapter_id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("page_end"))
    return own.unionByName(items).unionByName(none)


#: Texts without a sentence end are what this parser refuses.
def _strict(text: str) -> str:
    if "." not in text:
        raise ValueError(f"no sentence in {len(text)} characters")
    return text[: text.rindex(".") + 1]


@query(rf"""
SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN NOT contains(text, '.') THEN 'no sentence in ' || length(text) || ' characters' END AS error,
  CASE WHEN contains(text, '.') THEN length(regexp_replace(text, '[^.]*$', '')) END::BIGINT AS n FROM documents
""")
def s3_parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document through a parser that raises; those that fail go to a table of their own, which is read again beside the others."""
    path = _written(spark, "quarantine")
    rows = S.parsed(table(spark, sf_dir, "documents").select("doc_id", "text"), _strict, "text")
    kept = S.quarantine(rows, path)
    failed = spark.read.parquet(path)
    return kept.unionByName(failed).select("doc_id", "error", F.length("value").cast("long").alias("n"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
SELECT doc_id % 7 AS file, sha1(line) AS digest, count(*) AS n FROM l GROUP BY ALL
""")
def s1_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in seven folders hold all documents, one after the other; their lines are read with their places."""
    path = _written(spark, "lines")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("file"), F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("file").text(path)
    rows = S.read_lines(spark, path, end="\n").select("path", "pos", F.sha1("line").alias("digest"))  # lines themselves move no further
    file = F.regexp_extract("path", r"/file=(-?\d+)/[^/]*$", 1).try_cast("long").alias("file")
    # Places from 0 without a gap: a row whose place is another's, or beyond the file's lines, is lost here.
    size = rows.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    placed = rows.join(size, "path").filter("pos < lines").dropDuplicates(["path", "pos"])
    return placed.groupBy(file, "digest").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS book_id, count(*) AS n_chapters, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents GROUP BY source")
def s6_write_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "metrics")
    own = chapters(spark, sf_dir).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.sum(F.length("content").cast("long")).alias("n_chars"))
    S.write_metrics(own, path)
    return spark.read.schema("book_id string, n_chapters long, n_chars long").json(path)


# Cleaning ----------------------------------------------------------------------------------------

_PDF_LINE = cjk_sql(r"regexp_replace(" + strip_sql(r"regexp_replace(translate(%s, chr(8194) || chr(8195) || chr(8202), '   '), '\s+', ' ', 'g')") + r", '([A-Za-z])-\s+([A-Za-z])', '\1\2', 'g')")
_PAGE_NO = r"(regexp_full_match(%s, '第?\s*\d+\s*页\s*/?\s*共?\s*\d*\s*页?') OR regexp_full_match(%s, '\d+'))"
_HEADER = rf"""(NOT (regexp_full_match(%s, '第[一二三四五六七八九十\d]+章[·\s{CJK}]{{0,20}}') AND length(%s) <= 18)
  AND (regexp_full_match(%s, '[IVXLC]+') OR regexp_full_match(%s, '\d+\s*[|｜]\s*[{CJK}A-Za-z ]{{1,20}}')))"""
_FLOW_1 = rf"regexp_replace(%s, '([{CJK}])\n([{CJK}，。；：、（）])', '\1\2', 'g')"
_FLOW = strip_sql(r"regexp_replace(regexp_replace(" + (_FLOW_1 % _FLOW_1) + r", '([（(])\s+', '\1', 'g'), '\s+([）)])', '\1', 'g')")


def _all(template: str, c: str) -> str:
    return template.replace("%s", c)


@query(f"""
WITH l AS ({LINES_SQL}), t AS (SELECT page_id, line_no, {strip_sql("line")} AS line FROM l),
n AS (SELECT page_id, line_no, {_PDF_LINE.replace("%s", "line")} AS line FROM t WHERE line <> ''),
k AS (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS x FROM n WHERE NOT {_all(_PAGE_NO, "line")} AND NOT {_all(_HEADER, "line")} GROUP BY page_id)
SELECT pages.page_id, coalesce({_all(_FLOW, "x")}, '') AS cleaned FROM pages LEFT JOIN k USING (page_id)
""")
def t1_clean_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_page_text(F.col("html")).alias("cleaned"))


@query(f"SELECT page_id, line_no, {_PDF_LINE.replace('%s', 'line')} AS line FROM ({LINES_SQL})")
def t2_normalize_pdf_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("line", T.normalize_pdf_line(F.col("line")))


@query(f"SELECT page_id, line_no, {_all(_HEADER, 'line')} AS is_header, {_all(_PAGE_NO, 'line')} AS is_page_number FROM (SELECT page_id, line_no, {strip_sql('line')} AS line FROM ({LINES_SQL}))")
def t3_is_running_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.strip(F.col("line"))
    return lines(spark, sf_dir).select("page_id", "line_no", T.is_running_header(line).alias("is_header"), T.is_page_number(line).alias("is_page_number"))


_ZH = projected_sql("coalesce(text, '')")


@query(f"SELECT doc_id, {_all(_FLOW, 'x')} AS flowed FROM (SELECT doc_id, {_ZH} AS x FROM documents)")
def t4_normalize_text_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text_flow(projected(F.coalesce("text", F.lit("")))).alias("flowed"))


_HEADING = rf"""(length(%s) <= 60 AND (regexp_matches(%s, '^\s*第[一二三四五六七八九十百零〇\d]+[章节篇]\s*[\w\p{{L}}\p{{N}}{CJK}、：:\- ]{{0,40}}$')
  OR regexp_matches(%s, '(?i)^\s*Chapter\s+\d+[\w\p{{L}}\p{{N}}\s:：\-]{{0,60}}$')))"""
#: Documents with every fifth line a heading.
_HEADED = "SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents"


def _headed(spark: SparkSession, sf_dir: str, markdown: bool) -> DataFrame:
    """Every fifth line is marked as a heading, or is one."""
    line = (lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("# "), x)).otherwise(x)) if markdown else (lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("Chapter "), i.cast("string"))).otherwise(x))
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.concat(F.lit("book "), F.col("doc_id").cast("string")).alias("title"), text.alias("text"))


@query(f"""
SELECT doc_id, i::INTEGER AS line_no, {_all(_HEADING, "line")} AS is_heading
FROM (SELECT doc_id, i, {strip_sql("line")} AS line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM ({_HEADED})))
""")
def t5_is_chapter_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", T.is_chapter_heading(F.col("line")).alias("is_heading"))


@query(rf"SELECT page_id, line_no, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^[ ：:]+|[ ：:]+$', '', 'g') AS heading FROM ({LINES_SQL})")
def t6_normalize_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("page_id", "line_no", T.normalize_heading(F.col("line")).alias("heading"))


@query(rf"SELECT doc_id, {strip_sql('regexp_replace(regexp_replace(' + cjk_sql('x') + r', ' + chr(39) + r'[ \t]+' + chr(39) + r', ' + chr(39) + ' ' + chr(39) + r', ' + chr(39) + 'g' + chr(39) + r'), ' + chr(39) + r'\n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')} AS graph_text FROM (SELECT doc_id, {_ZH} AS x FROM documents)")
def t7_normalize_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_graph_text(projected(F.coalesce("text", F.lit("")))).alias("graph_text"))


@query(f"SELECT doc_id, {strip_sql(cjk_sql('x'))} AS answer_text FROM (SELECT doc_id, {_ZH} AS x FROM documents)")
def t8_clean_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_answer_text(projected(F.coalesce("text", F.lit("")))).alias("answer_text"))


def _noise_sql(c: str) -> str:
    patterns = " OR ".join(f"regexp_matches({c}, '{p}')" for p in lexicon.NOISE_PATTERNS)
    return f"({patterns} OR regexp_matches({c}, '{'|'.join(lexicon.NOISE_MARKERS)}'))"


@query(rf"SELECT doc_id, i::INTEGER AS line_no, {_noise_sql('x')} AS is_noise FROM (SELECT doc_id, i, regexp_replace(line, '\s+', '', 'g') AS x FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split({_ZH}, '。') AS l FROM documents)))")
def t9_noise_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(projected(F.coalesce("text", F.lit(""))), "。")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", T.looks_like_noise_source(F.col("line")).alias("is_noise"))


@query(r"""
SELECT doc_id, i::INTEGER AS word_no, regexp_replace(lower(w), '[^\p{L}\p{N}_]+', '', 'g') AS name, regexp_replace(lower(w), '[^\p{L}\p{N}]+', '', 'g') AS merge_key
FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS l FROM documents))
""")
def t10_normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word_no", "w"))
    return rows.select("doc_id", "word_no", T.normalize_name(F.col("w")).alias("name"), T.merge_key(F.col("w")).alias("merge_key"))


# Chapters ----------------------------------------------------------------------------------------


def _sections_sql(markdown: bool) -> str:
    line = "CASE WHEN i % 5 = 4 THEN '# ' || line ELSE line END" if markdown else "CASE WHEN i % 5 = 4 THEN 'Chapter ' || i ELSE line END"
    heading = r"regexp_matches(line, '^\s{0,3}#{1,3}\s+(.+)$')" if markdown else _all(_HEADING, strip_sql("line"))
    name = strip_sql(r"regexp_extract(line, '^\s{0,3}#{1,3}\s+(.+)$', 1)") if markdown else strip_sql("line")
    return rf"""
WITH a AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM ({_HEADED})),
b AS (SELECT doc_id, i, regexp_replace({line}, '\s+$', '') AS line FROM a),
c AS (SELECT *, {heading} AS h FROM b),
d AS (SELECT *, sum(h::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM c),
e AS (SELECT doc_id, section, max({name}) FILTER (h) AS opened, {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), '')")} AS content FROM d GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS n FROM e WHERE content <> ''),
g AS (
  SELECT doc_id, n, coalesce(opened, 'book ' || doc_id) AS title, content FROM f
  UNION ALL SELECT doc_id, 1, 'book ' || doc_id, {strip_sql("(SELECT string_agg(b.line, chr(10) ORDER BY i) FROM b WHERE b.doc_id = documents.doc_id)")} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)
)
SELECT doc_id AS book_id, 'ch_' || printf('%03d', n) AS chapter_id, title, 1::BIGINT AS page_start, 1::BIGINT AS page_end, content, length(content) AS char_count FROM g
"""


@query(_sections_sql(True))
def p1_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_sections(_headed(spark, sf_dir, True), True)


@query(_sections_sql(False))
def p1_heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_sections(_headed(spark, sf_dir, False), False)


#: Conversations are books, turns are pages; every seventh page begins with a heading.
_PAGES_SQL = """SELECT conv_id AS book_id, 'talk ' || conv_id AS title, turn AS page_no, CASE WHEN turn % 3 = 2 THEN 'Chapter ' || turn || ':' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM conversations"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Chapter "), F.col("turn").cast("string"), F.lit(":\n"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("book_id"), F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("title"), F.col("turn").alias("page_no"), F.concat(heading, F.coalesce("text", F.lit(""))).alias("text")
    )


_PAGED_SQL = rf"""
WITH p AS ({_PAGES_SQL}),
a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS n, [{strip_sql("x")} for x in string_split(text, chr(10)) if {strip_sql("x")} <> ''][1:12] AS l FROM p),
h AS (SELECT *, [x for x in l if {_all(_HEADING, "x")}][1] AS heading FROM a),
b AS (SELECT *, n > 1 AND heading IS NOT NULL AS opens FROM h),
c AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY book_id ORDER BY page_no) AS k, (n - 1) // 20 AS part FROM b),
d AS (
  SELECT book_id, k, max(title) AS stem, max(regexp_replace(regexp_replace(heading, '\s+', ' ', 'g'), '^[ ：:]+|[ ：:]+$', '', 'g')) FILTER (opens) AS opened, min(page_no) AS page_start, max(page_no) AS last,
    string_agg(text, chr(10) ORDER BY page_no) AS content FROM c GROUP BY book_id, k
), e AS (
  SELECT *, coalesce(greatest(lead(page_start) OVER (PARTITION BY book_id ORDER BY k) - 1, page_start), last) AS page_end, count(*) OVER (PARTITION BY book_id) AS chapters FROM d
), f AS (
  SELECT book_id, k, coalesce(opened, stem) AS title, page_start, page_end, content FROM e WHERE chapters > 1
  UNION ALL SELECT book_id, part, max(title) || ' 第' || (part + 1) || '部分', min(page_no), max(page_no), string_agg(text, chr(10) ORDER BY page_no) FROM c
  WHERE book_id IN (SELECT book_id FROM e WHERE chapters = 1) GROUP BY book_id, part
)"""


@query(f"""{_PAGED_SQL}
SELECT book_id, 'ch_' || printf('%03d', k + 1) AS chapter_id, title, page_start, page_end, {strip_sql("content")} AS content, length({strip_sql("content")}) AS char_count
FROM f WHERE {strip_sql("content")} <> ''
""")
def p2_chapters_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chapters_from_pages(_pages(spark, sf_dir))


@query(f"""
SELECT book_id, part::INTEGER AS k, max(title) || ' 第' || (part + 1) || '部分' AS title, min(page_no) AS page_start, max(page_no) AS page_end, count(*) AS n_pages
FROM (SELECT source AS book_id, source AS title, doc_id AS page_no, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS part FROM documents) GROUP BY book_id, part
""")
def p3_split_pages_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("source").alias("title"), F.col("doc_id").alias("page_no"), F.lit("").alias("text"))
    parts = P.split_pages_evenly(placed(docs, ["book_id"], ["page_no"]))
    return parts.select("book_id", "k", "title", "page_start", "page_end", F.size("pages").cast("long").alias("n_pages"))


@query(f"SELECT book_id, count(*) AS chapter_count, sum(length(content))::BIGINT AS total_chars, max(page_end) AS total_pages FROM ({chapters_sql()}) GROUP BY book_id")
def p4_book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.book_summary(chapters(spark, sf_dir))


_USEFUL = rf"""{strip_sql("content")} <> '' AND NOT (page_start <= 23 AND regexp_matches(content, '{"|".join(lexicon.FRONT_MATTER)}')) AND NOT regexp_full_match(title, '.+_\d+')"""


@query(f"SELECT book_id, chapter_id, title FROM ({chapters_sql(True)}) WHERE {_USEFUL}")
def p5_useful_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.useful_chapters(chapters(spark, sf_dir, True)).select("book_id", "chapter_id", "title")


@query(f"""
WITH u AS (SELECT book_id, chapter_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM ({chapters_sql()}) WHERE {_USEFUL} WINDOW w AS (PARTITION BY book_id ORDER BY chapter_ord)),
c AS (SELECT DISTINCT book_id, floor(k * (n / 12.0::DOUBLE))::BIGINT AS i FROM (SELECT DISTINCT book_id, n FROM u), range(12) r(k))
SELECT book_id, chapter_id FROM u WHERE n <= 12 OR (book_id, i) IN (SELECT book_id, i FROM c)
""")
def p6_representative_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.representative_chapters(chapters(spark, sf_dir), 12).select("book_id", "chapter_id")


# Chunks ------------------------------------------------------------------------------------------


def chunks_sql(size: int, overlap: int, source: str) -> str:
    """chunk_id, book_id, chapter_id, chapter, page, text, char_count, chunk_ord of a relation of chapters."""
    step = size - overlap
    return rf"""SELECT book_id || '_' || chapter_id || '_' || printf('%04d', i + 1) AS chunk_id, book_id, chapter_id, title AS chapter, page_start AS page,
  substring(x, i * {step} + 1, {size}) AS text, length(substring(x, i * {step} + 1, {size})) AS char_count, i + 1 AS chunk_ord
FROM (SELECT *, unnest(range(CASE WHEN length(x) = 0 THEN 0 WHEN length(x) <= {size} THEN 1 ELSE ceil((length(x) - {size}) / {step}.0)::BIGINT + 1 END)) AS i
  FROM (SELECT *, {strip_sql(r"regexp_replace(content, '\n{3,}', chr(10) || chr(10), 'g')")} AS x FROM ({source})))"""


@query(f"SELECT chapter_id, chunk_ord, text FROM ({chunks_sql(700, 80, chapters_sql())})")
def c1_split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapters(spark, sf_dir).select("chapter_id", F.posexplode(split_text(F.col("content"), 700, 80)).alias("i", "text"))
    return rows.select("chapter_id", (F.col("i") + 1).cast("long").alias("chunk_ord"), "text")


@query(chunks_sql(500, 100, chapters_sql()))
def c2_build_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_chunks(chapters(spark, sf_dir), RetrievalConfig())


@query(f"SELECT count(DISTINCT book_id) AS book_count, count(*) AS chunk_count, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS indexed_at FROM ({chunks_sql(500, 100, chapters_sql())})")
def c3_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built at the time of the newest event."""
    path = _written(spark, "index")
    at = table(spark, sf_dir, "events").agg(F.max("ts").cast("string")).first()[0]
    write_index(build_chunks(chapters(spark, sf_dir), RetrievalConfig()), path, F.lit(at).cast("timestamp"))
    return index_status(spark, path).withColumn("indexed_at", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT chunk_id, book_id, chapter, text FROM ({chunks_sql(500, 100, 'SELECT * FROM (' + _sections_sql(True) + ')')}) WHERE book_id IN (SELECT doc_id FROM documents WHERE coalesce({strip_sql('text')}, '') <> '')")
def s7_stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in two writes and are parsed in the stream, a file a batch."""
    arrived, target, failed, seen = (_written(spark, x) for x in ("documents", "chunks", "failed", "stream"))
    docs, config = _headed(spark, sf_dir, True), RetrievalConfig()
    for late in (False, True):
        docs.filter((F.pmod(F.xxhash64("book_id"), F.lit(2)) == 1) == F.lit(late)).write.mode("append").parquet(arrived)
        append_documents(arriving(spark, arrived, docs.schema, 1), target, failed, seen, config).awaitTermination()
    return spark.read.parquet(target).select("chunk_id", "book_id", "chapter", "text")


@query(f"SELECT chunk_id, book_id, text FROM ({chunks_sql(500, 100, chapters_sql())})")
def s7_incremental_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters arrive in two writes; a run after each one chunks what is new."""
    arrived, target, seen = _written(spark, "arrived"), _written(spark, "chunks"), _written(spark, "stream")
    pages = chapters(spark, sf_dir)
    for late in (False, True):
        pages.filter((F.pmod(F.xxhash64("chapter_id"), F.lit(2)) == 1) == F.lit(late)).write.mode("append").parquet(arrived)
        append_chunks(arriving(spark, arrived, pages.schema), target, seen, RetrievalConfig()).awaitTermination()
    return spark.read.parquet(target).select("chunk_id", "book_id", "text")
