"""Books to chapters: lines and pages are sessionised by their headings.

Windows run within one document or one book's pages; lines travel as rows, so a large
document is sorted by Spark, not held by a task's Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave import lexicon
from tomeweave.functions import text as T
from tomeweave.operators.places import placed

MARKDOWN_HEADING = r"(?U)^\s{0,3}#{1,3}\s+(.+)$"
PAGES_PER_PART = 20
HEADING_LINES = 12


def chapter_id(number: Column) -> Column:
    return F.format_string("ch_%03d", number.cast("int"))


def _joined(items: Column) -> Column:
    """Collected (position, text) structs in order, joined by line breaks."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), "\n")


def split_sections(docs: DataFrame, markdown: bool) -> DataFrame:
    """book_id, title, text to chapters: a heading line opens a section and is its title.

    Sections without text are dropped and take no number; a document without any section is one chapter.
    """
    found = _sections(docs.select("book_id", "title", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line")), markdown)
    whole = docs.join(found.select("book_id").distinct(), "book_id", "left_anti").withColumn("content", T.strip(F.col("text")))
    return _with_pages(found.unionByName(_one_chapter(whole)), F.lit(1), F.lit(1))


def split_line_sections(lines: DataFrame, markdown: bool) -> DataFrame:
    """The same for books that come as lines (book_id, title, pos, line), however large: only what one chapter holds becomes one value."""
    found = _sections(lines, markdown)
    left = lines.join(found.select("book_id").distinct(), "book_id", "left_anti")
    whole = left.groupBy("book_id").agg(F.first("title").alias("title"), T.strip(_joined(F.collect_list(F.struct("pos", F.col("line").alias("text"))))).alias("content"))
    return _with_pages(found.unionByName(_one_chapter(whole)), F.lit(1), F.lit(1))


def _one_chapter(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.lit("ch_001").alias("chapter_id"), "title", "content")


def _sections(rows: DataFrame, markdown: bool) -> DataFrame:
    """(book_id, chapter_id, title, content) of lines (book_id, title, pos, line)."""
    line = F.regexp_replace("line", r"(?U)\s+$", "")
    rows = rows.withColumn("line", line)
    heading = F.col("line").rlike(MARKDOWN_HEADING) if markdown else T.is_chapter_heading(F.col("line"))
    name = F.regexp_extract("line", MARKDOWN_HEADING, 1) if markdown else F.col("line")
    rows = rows.withColumn("heading", heading).withColumn("section", F.sum(F.col("heading").cast("int")).over(Window.partitionBy("book_id").orderBy("pos")))
    body = F.collect_list(F.when(~F.col("heading"), F.struct("pos", F.col("line").alias("text"))))
    opened = F.max(F.when(F.col("heading"), T.strip(name)))
    sections = rows.groupBy("book_id", "section").agg(F.first("title").alias("stem"), opened.alias("opened"), T.strip(_joined(body)).alias("content"))
    numbered = sections.filter("content <> ''").withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy("section")))
    return numbered.select("book_id", chapter_id(F.col("n")).alias("chapter_id"), F.coalesce("opened", "stem").alias("title"), "content")


def _with_pages(chapters: DataFrame, start: Column, end: Column) -> DataFrame:
    return chapters.select(
        "book_id", "chapter_id", "title", start.cast("long").alias("page_start"), end.cast("long").alias("page_end"), "content", F.length("content").cast("long").alias("char_count")
    )


def chapters_from_pages(pages: DataFrame) -> DataFrame:
    """book_id, title, page_no, text to chapters that begin at pages with a heading (the first page never does).

    Books with one chapter at most fall into parts of 20 pages. Chapters without text are dropped but take a number.
    """
    own = F.filter(F.transform(T.lines_of(F.col("text")), T.strip), lambda x: x != "")
    heading = F.get(F.filter(F.slice(own, 1, HEADING_LINES), T.is_chapter_heading), 0)
    rows = placed(pages.withColumn("heading", heading), ["book_id"], ["page_no"], {"headings": F.col("heading").isNotNull().cast("int")})
    opens = (F.col("place") > 1) & F.col("heading").isNotNull()
    by_heading = rows.groupBy("book_id", F.col("headings").alias("n")).agg(
        F.first("title").alias("stem"), F.max(F.when(opens, T.normalize_heading(F.col("heading")))).alias("opened"),
        F.min("page_no").alias("page_start"), F.max("page_no").alias("last"), F.collect_list(F.struct("page_no", "text")).alias("pages"),
    )
    books = rows.groupBy("book_id").agg(F.min("headings").alias("first"), F.max("headings").alias("final"))
    # A chapter ends before the next one's first page; the next one is a row of its own, so that no book is a window.
    nexts = rows.groupBy("book_id", (F.col("headings") - 1).alias("n")).agg(F.min("page_no").alias("following"))
    headed = by_heading.join(books.filter("first < final"), "book_id").join(nexts, ["book_id", "n"], "left").select(
        "book_id", (F.col("n") - F.col("first")).alias("k"), F.coalesce("opened", "stem").alias("title"), "page_start",
        F.coalesce(F.greatest(F.col("following") - 1, F.col("page_start")), F.col("last")).alias("page_end"), "pages",
    )
    parts = split_pages_evenly(rows.join(books.filter("first = final").select("book_id"), "book_id"))
    found = headed.unionByName(parts).select("book_id", chapter_id(F.col("k") + 1).alias("chapter_id"), "title", "page_start", "page_end", T.strip(_joined(F.col("pages"))).alias("content"))
    return _with_pages(found.filter("content <> ''"), F.col("page_start"), F.col("page_end"))


def split_pages_evenly(rows: DataFrame) -> DataFrame:
    """Parts of 20 pages of pages with their ``place`` in the book (book_id, title, place, page_no, text)."""
    part = F.floor((F.col("place") - 1) / PAGES_PER_PART).cast("int")
    parts = rows.groupBy("book_id", part.alias("k")).agg(
        F.first("title").alias("stem"), F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.collect_list(F.struct("page_no", "text")).alias("pages")
    )
    title = F.concat("stem", F.lit(" 第"), (F.col("k") + 1).cast("string"), F.lit("部分"))
    return parts.select("book_id", "k", title.alias("title"), "page_start", "page_end", "pages")


def book_summary(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapter_count"), F.sum(F.length("content").cast("long")).alias("total_chars"), F.max("page_end").alias("total_pages")
    )


def useful_chapters(chapters: DataFrame) -> DataFrame:
    front = (F.col("page_start") <= 23) & F.col("content").rlike("|".join(lexicon.FRONT_MATTER))
    return chapters.filter((T.strip(F.col("content")) != "") & ~front & ~F.col("title").rlike(r"(?U)^.+_\d+\z"))


def representative_chapters(chapters: DataFrame, most: int) -> DataFrame:
    """All useful chapters of a book, or ``most`` of them at even steps. Ids are ranked and chosen; contents join afterwards."""
    useful = useful_chapters(chapters)
    ranked = placed(useful.select("book_id", "chapter_id", "chapter_ord"), ["book_id"], ["chapter_ord", "chapter_id"])
    ranked = ranked.select("book_id", "chapter_id", (F.col("place") - 1).alias("i"), F.col("group_rows").alias("n"))
    # Row i is chosen if some k < most has floor(k * (n / most)) = i; only these k can, rounding included.
    near = F.ceil(F.col("i") * F.lit(most) / F.col("n"))
    step = F.col("n") / F.lit(float(most))
    hit = F.exists(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < most) & (F.floor(k.cast("double") * step) == F.col("i")))
    chosen = (F.col("n") <= most) | hit
    return useful.join(ranked.filter(chosen).select("book_id", "chapter_id"), ["book_id", "chapter_id"], "left_semi")
