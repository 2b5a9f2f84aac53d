"""DuckDB SQL of the rules on names and terms, from the same word lists and patterns.

This dialect has no lookahead: a head that is cut before a word is matched with the word, which is put back.
"""

from __future__ import annotations

from functools import reduce

from tomeweave import lexicon as L
from tomeweave.operators import terms as K
from tomeweave.plans.tables import cjk_sql, strip_sql


def text_sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cut(c: str, pattern: str, by: str = "") -> str:
    if "(?=" in pattern:
        head, word = pattern.split("(?=", 1)
        pattern, by = head.replace("^.*?", "^.+?") + "(" + word, r"\1"
    return f"regexp_replace({c}, {text_sql(pattern)}, {text_sql(by)}, 'g')"


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {text_sql(w)})" for w in words) + ")"


def _starts(c: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({c}, {text_sql(w)})" for w in words) + ")"


def _ends(c: str, words) -> str:
    return "(" + " OR ".join(f"suffix({c}, {text_sql(w)})" for w in words) + ")"


def _in(c: str, words) -> str:
    return f"{c} IN ({', '.join(map(text_sql, sorted(words)))})"


def _let(c: str, name: str, expression: str) -> str:
    return f"([{expression} for {name} in [{c}]])[1]"


def _like(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {text_sql(pattern)})"


def clean_sql(c: str) -> str:
    c = reduce(lambda x, rule: _cut(x, *rule), L.NAME_CLEANING, strip_sql(c))
    for a, b in (("（", "）"), (r"\(", r"\)")):
        c = f"regexp_replace({c}, '^([^{a}{b}]*){a}[^{b}]*$', '\\1')"
    for a, b, most in (("（", "）", 16), (r"\(", r"\)", 24)):
        c = f"regexp_replace({c}, '{a}[^{b}]{{0,{most}}}{b}', '', 'g')"
    ends = f"coalesce(list_max([strpos(tn, s) + length(s) - 1 for s in [{', '.join(map(text_sql, L.CONCEPT_SUFFIXES))}] if strpos(tn, s) > 0]), 0)"
    trimmed = _let(c, "tn", _let(ends, "best", "CASE WHEN best >= 2 AND best < length(tn) THEN substring(tn, 1, best) ELSE tn END"))
    return _cut(trimmed, L.KNOWN_HEADS)


def points_sql(c: str, warnings: str) -> str:
    return f"""(58 + CASE WHEN {_ends(c, L.CONCEPT_SUFFIXES)} THEN 18 ELSE 0 END + CASE WHEN {_in(c, L.SHORT_CONCEPTS)} THEN 12 ELSE 0 END + CASE WHEN length({c}) BETWEEN 3 AND 8 THEN 8 ELSE 0 END
  - CASE WHEN {_like(c, "[0-9]")} THEN 22 ELSE 0 END - 8 * {warnings})"""


def _rejected(c: str) -> str:
    noise = " OR ".join(_like(c, p) for p in L.NOISE_PATTERNS)
    return f"""({c} = '' OR {noise} OR {_any(c, L.BAD_FRAGMENTS)} OR NOT regexp_full_match({c}, '[一-鿿A-Za-z0-9·+\\-]+') OR regexp_full_match({c}, '[A-Za-z0-9+\\-]+') OR length({c}) NOT BETWEEN 2 AND 14
  OR {_any(c, L.PERSON_NAME_MARKERS)} OR ({_any(c, L.PRONOUN_FRAGMENTS)} AND {_any(c, L.VERB_PHRASE_MARKERS)}) OR ({_like(c, "[A-Za-z]")} AND {_like(c, "[一-鿿]")})
  OR ({_starts(c, L.BAD_PREFIXES)} AND NOT {_ends(c, L.CONCEPT_SUFFIXES)}))"""


def _rejected_after(c: str) -> str:
    short = _in(c, L.SHORT_CONCEPTS)
    return f"""(length({c}) < 2 OR {_starts(c, L.REJECTED_STARTS)} OR {_any(c, L.REJECTED_PARTS)} OR ({_any(c, L.SENTENCE_PARTS)} AND NOT {short})
  OR ({_any(c, L.VERB_PHRASE_MARKERS)} AND NOT {_ends(c, L.CONCEPT_SUFFIXES)}) OR (length({c}) <= 2 AND NOT {short} AND NOT {_ends(c, L.SHORT_ENDINGS)}))"""


def validated_sql(source: str, raw: str, text: str) -> str:
    """A relation: the rows of ``source`` whose name passes, with name, quality and warnings."""
    loose = f"'[{L.LOOSE_ENDINGS}]+$'"
    return f"""(WITH v0 AS (SELECT *, {clean_sql(raw)} AS n0 FROM ({source})),
v1 AS (SELECT *, regexp_matches(n0, {loose}) AS trimmed, regexp_replace(n0, {loose}, '') AS name FROM v0 WHERE NOT {_rejected("n0")}),
v2 AS (SELECT *, [w for w in [CASE WHEN trimmed THEN 'trimmed_fragment' END, CASE WHEN {text} <> '' AND NOT contains({text}, name) THEN 'not_in_source' END] if w IS NOT NULL] AS warnings FROM v1 WHERE NOT {_rejected_after("name")}),
v3 AS (SELECT *, {points_sql("name", "len(warnings)")} AS points FROM v2)
SELECT * EXCLUDE (n0, trimmed, points), least(100, points) / 100.0::DOUBLE AS quality FROM v3 WHERE points >= {K.LEAST_QUALITY})"""


def around_sql(x: str, start: str, end: str) -> str:
    """From the last sentence end before ``start`` (from 0) to the first from ``end`` on."""
    left = f"length(string_split(translate(substring({x}, 1, {start}), '。；', chr(10) || chr(10)), chr(10))[-1])"
    after = f"strpos(translate(substring({x}, {end} + 1), '。；', chr(10) || chr(10)), chr(10))"
    stop = f"CASE WHEN {after} > 0 THEN {end} + {after} ELSE least(length({x}), {end} + 180) + 1 END"
    return strip_sql(f"substring({x}, {start} - {left} + 1, {stop} - {start} + {left})")


def sentence_sql(x: str, word: str) -> str:
    return f"coalesce([{strip_sql('s')} for s in string_split_regex({x}, '[。！？\\n]') if contains(s, {word}) AND length({strip_sql('s')}) > 8][1], '')"


def graph_text_sql(c: str) -> str:
    return strip_sql(rf"regexp_replace(regexp_replace({cjk_sql(c)}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def candidates_sql(chapters: str) -> str:
    """CTEs up to ``cand`` (book_id, chapter_id, cand_ord, name, source_text, method, quality, warnings) of a relation of chapters."""
    ctes = [f"ch AS MATERIALIZED (SELECT *, {graph_text_sql('content')} AS gt FROM ({chapters}))"]
    parts = []
    for n, (pattern, method, bonus) in enumerate([*((p, "term_annotation", 8) for p in L.GLOSS_PATTERNS), (L.DEFINITION_PATTERN, "definition_sentence", 12)]):
        marked = f"string_split(regexp_replace(gt, {text_sql(pattern)}, chr(1) || '\\1' || chr(2) || '\\0' || chr(3), 'g'), chr(1))"
        # The window's sum up to a match is where it begins.
        ctes.append(f"""m{n} AS (SELECT *, split_part(piece, chr(2), 1) AS word, split_part(split_part(piece, chr(3), 1), chr(2), 2) AS whole FROM (SELECT chapter_id, unnest({marked}) AS piece, unnest(range(len({marked}))) AS k FROM ch)),
p{n} AS (SELECT *, sum(CASE WHEN k = 0 THEN length(piece) ELSE length(whole) + length(split_part(piece, chr(3), 2)) END) OVER (PARTITION BY chapter_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS pl FROM m{n})""")
        parts.append(f"SELECT chapter_id, {n} AS stage, k AS idx, word AS raw, {around_sql('gt', 'pl', '(pl + length(whole))')} AS src, '{method}' AS method, {bonus} AS bonus FROM p{n} JOIN ch USING (chapter_id) WHERE k > 0")
    head = reduce(lambda x, p: f"regexp_replace({x}, {text_sql(p)}, '')", L.ENUMERATION, strip_sql("line"))
    parts.append(f"""SELECT * FROM (SELECT chapter_id, 4 AS stage, i AS idx, {head} AS raw, {strip_sql('line')} AS src, 'heading' AS method, 4 AS bonus
  FROM (SELECT chapter_id, unnest(string_split(gt, chr(10))) AS line, unnest(range(len(string_split(gt, chr(10))))) AS i FROM ch)) WHERE length(raw) BETWEEN 2 AND 18""")
    runs = f"regexp_extract_all(gt, {text_sql(K.SUFFIX_RUN)})"
    parts.append(f"""SELECT chapter_id, 5, first, raw, NULL, 'frequency_term', least(16, 3 * n) FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY n DESC, first) AS nth FROM (
  SELECT chapter_id, raw, count(*) AS n, min(i) AS first FROM (SELECT chapter_id, unnest({runs}) AS raw, unnest(range(len({runs}))) AS i FROM ch) GROUP BY ALL) WHERE n >= 2) WHERE nth <= {K.MOST_FREQUENT}""")
    # Frequent runs come in their own order.
    parts[-1] = parts[-1].replace("5, first, raw", "5, nth, raw")
    ctes.append(f"raws AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY stage, idx) - 1 AS cand_ord FROM ({' UNION ALL '.join(parts)}))")
    checked = validated_sql("SELECT raws.*, book_id, content, gt FROM raws JOIN ch USING (chapter_id)", "raw", "gt")
    source = f"CASE WHEN src IS NULL THEN {sentence_sql('gt', 'name')} ELSE src END"
    ctes.append(f"cand0 AS (SELECT *, {source} AS s0 FROM {checked})")
    ctes.append(f"""cand AS MATERIALIZED (SELECT book_id, chapter_id, cand_ord, name, CASE WHEN s0 = '' THEN {sentence_sql('content', 'name')} ELSE s0 END AS source_text, method,
  round((quality * 100 + bonus) / 100, 3) AS quality, warnings FROM cand0)""")
    places = ", ".join(f"'{m}'" for m in K.METHODS)
    ctes.append("ded AS (SELECT * EXCLUDE (nth, cand_ord, first), first AS cand_ord FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, name ORDER BY quality DESC, cand_ord) AS nth, min(cand_ord) OVER (PARTITION BY chapter_id, name) AS first FROM cand) WHERE nth = 1)")
    ctes.append(f"ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY quality DESC, list_position([{places}], method) DESC, length(source_text) DESC, cand_ord) AS rank FROM ded) WHERE rank <= {K.PER_CHAPTER})")
    return ", ".join(ctes)


def normalize_term_sql(c: str) -> str:
    def edges(x: str, letters: str) -> str:
        own = "[" + "".join("\\" + y if y in "()[]" else y for y in letters) + "]+"
        return f"regexp_replace({x}, '^{own}|{own}$', '', 'g')"

    return edges(_cut(edges(_cut(c, L.TERM_LEAD), L.TERM_EDGES), L.TERM_OPENERS), L.TERM_EDGES_AGAIN)


def valid_term_sql(c: str) -> str:
    n = f"length({c})"
    return f"""(NOT ({n} NOT BETWEEN 2 AND 10 OR NOT regexp_full_match({c}, '[一-鿿]+') OR {_in(c, L.TERM_STOPWORDS)} OR {_like(c, L.TERM_BLOCKLIST)} OR {_like(c, L.TERM_REFERENCES)} OR {_starts(c, L.TERM_STARTS)} OR {_ends(c, L.TERM_ENDS)}
  OR ({n} > 6 AND contains({c}, '的')) OR ({n} > 8 AND NOT {_ends(c, L.LONG_TERM_ENDS)}) OR ({n} <= 2 AND NOT {_ends(c, L.SHORT_TERM_ENDS)} AND NOT {_in(c, L.SHORT_TERMS)})))"""


def entity_sql(c: str) -> str:
    return f"(NOT ({_in(c, L.TERM_STOPWORDS)} OR {_starts(c, L.ENTITY_STARTS)} OR {_any(c, L.ENTITY_PARTS)}) AND ({_ends(c, L.TERM_SUFFIXES)} OR {_any(c, L.CONCEPT_KEYWORDS)}))"


def chunk_terms_sql(chunks: str) -> str:
    """(chunk_id, pos, term) of a relation of chunks: the place of a term's first valid occurrence among the distinct ones."""
    lists = [f"regexp_extract_all(text, {text_sql(p)}, {g})" for p, g in K.TERM_GROUPS]
    lists.append(f"[e for e in regexp_extract_all(text, {text_sql(K.TERM_RUN)}, 1) if {entity_sql('e')}]")
    each = " UNION ALL ".join(f"SELECT chunk_id, {n} AS stage, unnest({x}) AS raw, unnest(range(len({x}))) AS i FROM ({chunks})" for n, x in enumerate(lists))
    terms = f"SELECT chunk_id, stage, i, {normalize_term_sql('raw')} AS term FROM ({each})"
    first = f"SELECT chunk_id, term, min(stage * 1000000 + i) AS pl FROM ({terms}) WHERE {valid_term_sql('term')} GROUP BY ALL"
    return f"SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY pl) - 1 AS pos, term FROM ({first})"


def graph_term_sql(name: str, source: str) -> str:
    cut = "CASE " + " ".join(f"WHEN contains(gn, {text_sql(s)}) THEN substring(gn, 1, strpos(gn, {text_sql(s)}) + {len(s)} - 1)" for s in K.TERM_SUFFIXES) + " ELSE gn END"
    bad = f"(NOT {valid_term_sql('gx')} OR (length(gx) > 4 AND {_starts('gx', L.GRAPH_TERM_STARTS)}) OR {_like('gx', L.GRAPH_TERM_PARTS)} OR {_in('gx', L.GRAPH_TERM_GENERAL)})"
    return _let(_let(normalize_term_sql(name), "gn", cut), "gx", f"CASE WHEN NOT {bad} AND ({source} = '' OR contains({source}, gx)) THEN gx END")
