"""Terms of chapters and chunks, as column expressions: every rule on a name is an ordered rewriting by built-in functions.

Where a rule needs to know where a pattern matched, the matches are marked in the text and the text is split at the
marks, which gives each match its place. No text passes through Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeweave import lexicon as L
from tomeweave.functions.text import lines_of, strip

METHODS = ("frequency_term", "heading", "term_annotation", "definition_sentence")
MOST_FREQUENT, PER_CHAPTER = 32, 10
#: In hundredths.
LEAST_QUALITY = 52
SUFFIX_RUN = f"([一-鿿]{{1,10}}(?:{'|'.join(L.CONCEPT_SUFFIXES)}))"
TERM_SUFFIXES = sorted(L.TERM_SUFFIXES, key=len, reverse=True)
TERM_RUN = f"([一-鿿]{{1,8}}(?:{'|'.join(TERM_SUFFIXES)}))"
KEYWORD = "[一-鿿A-Za-z][一-鿿A-Za-z0-9（）()]{2,12}"
#: Brackets around remarks, and how long a remark is.
BRACKETS = (("（", "）", 16), ("(", ")", 24))
#: What marks a match: before it, between its word and the whole, and after it.
_OPEN, _MIDDLE, _CLOSE = "\x01", "\x02", "\x03"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)``, with ``c`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


# Names --------------------------------------------------------------------------------------------


def _regex(pattern: str) -> str:
    """Blanks and digits are those of all scripts. A head that is cut before a word has a letter at least: where the name begins with that word, it goes up to the next one."""
    return "(?U)" + pattern.replace("^.*?(?=", "^.+?(?=")


def _one_of(c: Column, words) -> Column:
    return c.rlike("|".join(map(re.escape, words)))


def _starts(c: Column, words) -> Column:
    return c.rlike(f"^(?:{'|'.join(map(re.escape, words))})")


def _ends(c: Column, words) -> Column:
    return c.rlike(f"(?:{'|'.join(map(re.escape, words))})\\z")


def trimmed_to_suffix(c: Column) -> Column:
    """The longest part that ends with a first occurrence of a known suffix."""
    ends = F.array(*(F.when(F.instr(c, s) > 0, F.instr(c, s) + len(s) - 1) for s in L.CONCEPT_SUFFIXES))
    best = F.coalesce(F.array_max(ends), F.lit(0))
    return F.when((best >= 2) & (best < F.length(c)), F.substring(c, 1, best)).otherwise(c)


def _without_remarks(c: Column) -> Column:
    c = reduce(lambda x, rule: F.regexp_replace(x, _regex(rule[0]), rule[1]), L.NAME_CLEANING, strip(c))
    for opening, closing, _ in BRACKETS:  # one that is never closed
        a, b = re.escape(opening), re.escape(closing)
        c = F.regexp_replace(c, f"^([^{a}{b}]*){a}[^{b}]*\\z", "$1")
    for opening, closing, most in BRACKETS:
        c = F.regexp_replace(c, f"{re.escape(opening)}[^{re.escape(closing)}]{{0,{most}}}{re.escape(closing)}", "")
    return c


def _known_head(c: Column) -> Column:
    return F.regexp_replace(c, _regex(L.KNOWN_HEADS), "")


def clean_name(c: Column) -> Column:
    return _known_head(let(_without_remarks(c), trimmed_to_suffix))


def name_points(c: Column, warnings: Column) -> Column:
    """How good a name is, in hundredths."""
    part = lambda holds, points: F.when(holds, points).otherwise(0)
    points = F.lit(58) + part(_ends(c, L.CONCEPT_SUFFIXES), 18) + part(c.isin(*sorted(L.SHORT_CONCEPTS)), 12) + part(F.length(c).between(3, 8), 8)
    return points - part(c.rlike(_regex(r"\d")), 22) - warnings * 8


def name_score(c: Column, warnings: Column) -> Column:
    return F.round(name_points(c, warnings) / 100, 3)


def _rejected(c: Column) -> Column:
    """Before loose endings are cut."""
    noise = reduce(Column.__or__, (c.rlike(_regex(p)) for p in L.NOISE_PATTERNS))
    latin = c.rlike("[A-Za-z]")
    return (
        (c == "") | noise | c.rlike("|".join(L.BAD_FRAGMENTS)) | ~c.rlike(r"^[一-鿿A-Za-z0-9·+\-]+\z") | c.rlike(r"^[A-Za-z0-9+\-]+\z") | ~F.length(c).between(2, 14)
        | _one_of(c, L.PERSON_NAME_MARKERS) | (_one_of(c, L.PRONOUN_FRAGMENTS) & _one_of(c, L.VERB_PHRASE_MARKERS))
        | (latin & c.rlike("[一-鿿]")) | (_starts(c, L.BAD_PREFIXES) & ~_ends(c, L.CONCEPT_SUFFIXES))
    )


def _rejected_after(c: Column) -> Column:
    short = c.isin(*sorted(L.SHORT_CONCEPTS))
    return (
        (F.length(c) < 2) | _starts(c, L.REJECTED_STARTS) | _one_of(c, L.REJECTED_PARTS) | (_one_of(c, L.SENTENCE_PARTS) & ~short)
        | (_one_of(c, L.VERB_PHRASE_MARKERS) & ~_ends(c, L.CONCEPT_SUFFIXES)) | ((F.length(c) <= 2) & ~short & ~_ends(c, L.SHORT_ENDINGS))
    )


def _kept(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column of values, without those where it is null. Exploded, as a filter would evaluate the expression again for each use."""
    return rows.withColumn(name, F.explode(F.array_compact(F.array(value))))


def validated(rows: DataFrame, raw: str, text: str | None = None) -> DataFrame:
    """``rows`` whose name in ``raw`` passes the rules, with (name, quality, warnings). A name that ``text`` lacks is worth less.

    Each step is a projection of its own, which is compiled, and whose rejected rows go no further.
    """
    loose = f"[{re.escape(L.LOOSE_ENDINGS)}]+\\z"
    rows = rows.withColumn("_head", _without_remarks(F.col(raw))).withColumn("_full", _known_head(trimmed_to_suffix(F.col("_head"))))
    rows = _kept(rows, "_name", F.when(~_rejected(F.col("_full")), F.regexp_replace("_full", loose, "")))
    rows = _kept(rows, "name", F.when(~_rejected_after(F.col("_name")), F.col("_name")))
    name = F.col("name")
    missing = F.lit(False) if text is None else (F.col(text) != "") & ~F.contains(F.col(text), name)
    rows = rows.withColumn("warnings", F.array_compact(F.array(F.when(F.col("_full").rlike(loose), "trimmed_fragment"), F.when(missing, "not_in_source"))))
    points = name_points(name, F.size("warnings"))
    rows = _kept(rows, "_points", F.when(points >= LEAST_QUALITY, points))
    return rows.withColumn("quality", F.least(F.lit(100), F.col("_points")) / 100).drop("_head", "_full", "_name", "_points")


# Sentences ----------------------------------------------------------------------------------------


def matches(c: Column, pattern: str) -> Column:
    """Array of (word, start, end) of a pattern's matches from left to right: its first group, and where the whole begins and ends (from 0)."""
    plain = F.translate(c, _OPEN + _MIDDLE + _CLOSE, "   ")
    marked = F.split(F.regexp_replace(plain, _regex(pattern), f"{_OPEN}$1{_MIDDLE}$0{_CLOSE}"), _OPEN)
    nothing = F.array().cast("array<struct<word: string, start: int, end: int>>")

    def step(state: Column, x: Column) -> Column:
        whole = F.substring_index(F.substring_index(x, _CLOSE, 1), _MIDDLE, -1)
        end = state["at"] + F.length(whole)
        one = F.struct(F.substring_index(x, _MIDDLE, 1).alias("word"), state["at"].alias("start"), end.alias("end"))
        return F.struct((end + F.length(F.substring_index(x, _CLOSE, -1))).alias("at"), F.array_append(state["found"], one).alias("found"))

    def placed(pieces: Column) -> Column:
        first = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), nothing.alias("found"))
        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), first, step, lambda state: state["found"])

    return let(marked, placed)


def sentence_around(c: Column, start: Column, end: Column) -> Column:
    """From the last sentence end or line break before ``start`` to the first one from ``end`` on; without one, 181 characters more at most."""
    left = F.length(F.substring_index(F.translate(F.substring(c, F.lit(1), start), "。；", "\n\n"), "\n", -1))
    after = F.instr(F.translate(F.substring(c, end + 1, F.length(c)), "。；", "\n\n"), "\n")
    stop = F.when(after > 0, end + after).otherwise(F.least(F.length(c), end + 180) + 1)
    return strip(F.substring(c, start - left + 1, stop - start + left))


def first_sentence_with(c: Column, word: Column) -> Column:
    """The first sentence of more than eight characters that has the word."""
    sentences = F.transform(F.filter(F.split(c, "[。！？\n]"), lambda s: F.contains(s, word)), strip)
    return F.coalesce(F.get(F.filter(sentences, lambda s: F.length(s) > 8), 0), F.lit(""))


# Candidates ---------------------------------------------------------------------------------------


def suffix_counts(c: Column) -> Column:
    """Array of (n, first, raw): the runs that end with a known suffix, twice or more in a text, the most frequent first, then as first seen."""

    def counted(runs: Column) -> Column:
        each = F.transform(F.array_distinct(runs), lambda x, i: F.struct((-F.size(F.filter(runs, lambda y: y == x))).alias("n"), i.alias("first"), x.alias("raw")))
        return F.array_sort(F.filter(each, lambda x: x["n"] <= -2))

    return let(F.regexp_extract_all(c, F.lit(SUFFIX_RUN), 1), counted)


CANDIDATES = ("book_id", "chapter_id", "cand_ord", "name", "source_text", "method", "quality", "warnings")


def _raw(method: str, raw: Column, source: Column, bonus: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), raw.alias("raw"), source.alias("source"), bonus.cast("int").alias("bonus"))


def chapter_candidates(chapters: DataFrame) -> DataFrame:
    """All candidates of chapters with ``content`` and ``graph_text``, in the order of discovery: glosses, definitions, headings, frequent runs."""
    own = chapters.select("book_id", "chapter_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("content", "graph_text")))
    text = F.col("graph_text")
    nothing = F.lit(None).cast("string")
    found = [F.transform(matches(text, p), lambda m: _raw("term_annotation", m["word"], sentence_around(text, m["start"], m["end"]), F.lit(8))) for p in L.GLOSS_PATTERNS]
    found.append(F.transform(matches(text, L.DEFINITION_PATTERN), lambda m: _raw("definition_sentence", m["word"], sentence_around(text, m["start"], m["end"]), F.lit(12))))

    def heading(line: Column) -> Column:
        head = reduce(lambda x, p: F.regexp_replace(x, _regex(p), ""), L.ENUMERATION, strip(line))
        return _raw("heading", head, strip(line), F.lit(4))

    found.append(F.filter(F.transform(lines_of(text), heading), lambda x: F.length(x["raw"]).between(2, 18)))
    found.append(F.transform(F.slice(suffix_counts(text), 1, MOST_FREQUENT), lambda x: _raw("frequency_term", x["raw"], nothing, F.least(F.lit(16), x["n"] * -3))))
    rows = own.select("*", F.posexplode(F.concat(*found)).alias("k", "c"))
    rows = validated(rows.select("*", "c.*"), "raw", "graph_text")
    in_text = F.when(F.col("source").isNull(), first_sentence_with(F.col("graph_text"), F.col("name"))).otherwise(F.col("source"))
    source = let(in_text, lambda x: F.when(x == "", first_sentence_with(F.col("content"), F.col("name"))).otherwise(x))
    quality = F.round((F.col("quality") * 100 + F.col("bonus")) / 100, 3)
    return rows.withColumns({"cand_ord": F.col("k").cast("long"), "source_text": source, "quality": quality}).select(*CANDIDATES)


def dedupe_candidates(found: DataFrame) -> DataFrame:
    """Of each name in a chapter the best candidate (the first of equals), at the place of the first."""
    best = F.struct("quality", (-F.col("cand_ord")).alias("o"))
    kept = [F.max_by(c, best).alias(c) for c in ("source_text", "method", "quality", "warnings")]
    return found.groupBy("book_id", "chapter_id", "name").agg(F.min("cand_ord").alias("cand_ord"), *kept)


def rank_candidates(found: DataFrame, most: int = PER_CHAPTER) -> DataFrame:
    method = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    order = Window.partitionBy("book_id", "chapter_id").orderBy(F.desc("quality"), F.desc(method), F.desc(F.length("source_text")), "cand_ord")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def keywords(chapters: DataFrame, most: int = 12) -> DataFrame:
    """The most frequent validated tokens of each chapter, ties as first seen."""
    found = F.regexp_extract_all(F.coalesce("graph_text", F.lit("")), F.lit(KEYWORD), 0)
    rows = validated(chapters.select("chapter_id", "graph_text", F.posexplode(found).alias("pos", "raw")), "raw", "graph_text")
    counted = rows.groupBy("chapter_id", F.col("name").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("chapter_id").orderBy(F.desc("n"), "pos"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most).select("chapter_id", F.col("rank").cast("long").alias("rank"), "word", "n")


# Terms of questions --------------------------------------------------------------------------------


def _edges(c: Column, letters: str) -> Column:
    own = f"[{re.escape(letters)}]+"
    return F.regexp_replace(c, f"^{own}|{own}\\z", "")


def normalize_term(c: Column) -> Column:
    return _edges(F.regexp_replace(_edges(F.regexp_replace(c, L.TERM_LEAD, ""), L.TERM_EDGES), L.TERM_OPENERS, ""), L.TERM_EDGES_AGAIN)


def is_valid_term(c: Column) -> Column:
    n = F.length(c)
    return ~(
        ~n.between(2, 10) | ~c.rlike(r"^[一-鿿]+\z") | c.isin(*sorted(L.TERM_STOPWORDS)) | c.rlike(L.TERM_BLOCKLIST) | c.rlike(_regex(L.TERM_REFERENCES))
        | _starts(c, L.TERM_STARTS) | _ends(c, L.TERM_ENDS) | ((n > 6) & F.contains(c, F.lit("的"))) | ((n > 8) & ~_ends(c, L.LONG_TERM_ENDS))
        | ((n <= 2) & ~_ends(c, L.SHORT_TERM_ENDS) & ~c.isin(*sorted(L.SHORT_TERMS)))
    )


def looks_like_entity(c: Column) -> Column:
    none = c.isin(*sorted(L.TERM_STOPWORDS)) | _starts(c, L.ENTITY_STARTS) | _one_of(c, L.ENTITY_PARTS)
    return ~none & (_ends(c, L.TERM_SUFFIXES) | _one_of(c, L.CONCEPT_KEYWORDS))


#: Of each pattern the group that is the term.
TERM_GROUPS = ((L.TITLE_TERM, 1), (L.TERM_PATTERNS[0], 1), (L.TERM_PATTERNS[1], 2), (L.TERM_PATTERNS[2], 1), (L.TERM_PATTERNS[3], 1))


def candidate_terms(c: Column) -> Column:
    """Valid terms of a text in the order of the patterns, each once."""
    raw = F.concat(*(F.regexp_extract_all(c, F.lit(_regex(p)), g) for p, g in TERM_GROUPS), F.filter(F.regexp_extract_all(c, F.lit(TERM_RUN), 1), looks_like_entity))
    return F.array_distinct(F.filter(F.transform(raw, normalize_term), is_valid_term))


def graph_term(name: Column, source: Column) -> Column:
    """A node's name as a question term; null if it cannot be one."""

    def to_suffix(term: Column) -> Column:
        return reduce(lambda c, s: c.when(F.contains(term, F.lit(s)), F.substring(term, F.lit(1), F.instr(term, s) + len(s) - 1)), TERM_SUFFIXES, F.when(F.lit(False), term)).otherwise(term)

    def fit(term: Column) -> Column:
        bad = ~is_valid_term(term) | ((F.length(term) > 4) & _starts(term, L.GRAPH_TERM_STARTS)) | term.rlike(L.GRAPH_TERM_PARTS) | term.isin(*sorted(L.GRAPH_TERM_GENERAL))
        return F.when(~bad & ((source == "") | F.contains(source, term)), term)

    return let(let(normalize_term(name), to_suffix), fit)


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, pos, term) of all chunks, pos from 0."""
    return chunks.select("chunk_id", F.posexplode(candidate_terms(F.coalesce("text", F.lit("")))).alias("pos", "term")).withColumn("pos", F.col("pos").cast("long"))
