"""Text cleaning as column expressions: all of them stay in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave import lexicon

CJK = r"\x{4e00}-\x{9fff}"
#: Where str.splitlines() breaks lines.
LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines_of(c: Column) -> Column:
    """Lines without their breaks; a final break opens no line."""
    return F.split(F.regexp_replace(c, rf"(?:{LINE_BREAKS})\z", ""), LINE_BREAKS)


def join_cjk(c: Column) -> Column:
    """Deletes blanks between two CJK characters."""
    return F.regexp_replace(c, rf"(?U)(?<=[{CJK}])\s+(?=[{CJK}])", "")


def normalize_pdf_line(c: Column) -> Column:
    """Wide spaces to blanks, blanks collapsed, broken Latin words joined, no blanks between CJK characters."""
    c = F.regexp_replace(F.translate(c, "\u2002\u2003\u200a", "   "), r"(?U)\s+", " ")
    return join_cjk(F.regexp_replace(strip(c), r"(?U)([A-Za-z])-\s+([A-Za-z])", "$1$2"))


def is_page_number(c: Column) -> Column:
    return c.rlike(r"(?U)^第?\s*\d+\s*页\s*/?\s*共?\s*\d*\s*页?\z") | c.rlike(r"(?U)^\d+\z")


def is_running_header(c: Column) -> Column:
    """Roman numerals, or a number, a bar and a short title; a short chapter line is none."""
    chapter = c.rlike(rf"(?U)^第[一二三四五六七八九十\d]+章[·\s{CJK}]{{0,20}}\z") & (F.length(c) <= 18)
    return ~chapter & (c.rlike(r"^[IVXLC]+\z") | c.rlike(rf"(?U)^\d+\s*[|｜]\s*[{CJK}A-Za-z ]{{1,20}}\z"))


def normalize_text_flow(c: Column) -> Column:
    """Joins lines that break between CJK characters and trims blanks inside brackets."""
    c = F.regexp_replace(c, rf"(?<=[{CJK}])\n(?=[{CJK}，。；：、（）])", "")
    c = F.regexp_replace(c, r"(?U)(?<=[（(])\s+", "")
    return strip(F.regexp_replace(c, r"(?U)\s+(?=[）)])", ""))


def clean_page_text(c: Column) -> Column:
    kept = F.filter(F.transform(lines_of(c), strip), lambda x: x != "")
    kept = F.filter(F.transform(kept, normalize_pdf_line), lambda x: ~is_page_number(x) & ~is_running_header(x))
    return normalize_text_flow(F.array_join(kept, "\n"))


def is_chapter_heading(c: Column) -> Column:
    c = strip(c)
    chinese = c.rlike(rf"(?U)^\s*第[一二三四五六七八九十百零〇\d]+[章节篇]\s*[\w{CJK}、：:\- ]{{0,40}}$")
    return (F.length(c) <= 60) & (chinese | c.rlike(r"(?Ui)^\s*Chapter\s+\d+[\w\s:：\-]{0,60}$"))


def normalize_heading(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^[ ：:]+|[ ：:]+$", "")


def normalize_graph_text(c: Column) -> Column:
    c = F.regexp_replace(join_cjk(c), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def looks_like_noise_source(c: Column) -> Column:
    """Tables, figures, headings and references: what no definition is taken from."""
    x = F.regexp_replace(c, r"(?U)\s+", "")
    noise = x.rlike("|".join(lexicon.NOISE_MARKERS))
    for pattern in lexicon.NOISE_PATTERNS:
        noise = noise | x.rlike("(?U)" + pattern)
    return noise


def clean_answer_text(c: Column) -> Column:
    return strip(join_cjk(c))


def normalize_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)\W+", "")


#: Names that mean the same.
MERGE_ALIASES = {"白blood细胞": "白细胞", "leukocyte": "白细胞"}


def merge_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")
    out = c
    for name, other in MERGE_ALIASES.items():
        out = F.when(c == name, F.lit(other)).otherwise(out)
    return out


def infer_title(c: Column) -> Column:
    """The last path part without its last suffix, as Path(...).stem."""
    name = F.regexp_extract(c, r"([^/]*)/*\z", 1)
    return F.regexp_replace(name, r"(?<=.)(?<!^\.)\.[^.]+\z", "")


def suffix(c: Column) -> Column:
    name = F.regexp_extract(c, r"([^/]*)/*\z", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)\z", 1))


def safe_filename(c: Column) -> Column:
    safe = strip(F.regexp_replace(c, r"[^\p{L}\p{N}._\-（）()\[\]【】 ]", "_"))
    return F.when(safe == "", F.lit("upload")).otherwise(safe)
