"""op10: the ledger of ``documents`` under the default policy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import quality
from tomeweave.llm.common import documents

NAME = "op10_quality_rules"


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, at = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    measured = [F.col(at)[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    base_failed = ~quality.passes(at, "base@1")
    return entries.select("doc_id", *measured, base_failed.alias("base_failed"), (~base_failed & quality.passes(at)).alias("kept"), F.col(at)["failed"].alias("failed_bits"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, [x for x in string_split_regex(t, '[\x20\x09-\x0D]+') if x <> ''] AS words FROM d
), win AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS p,
         unnest([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) AS g
  FROM w WHERE len(words) >= 3
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r
), lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY r
), m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)
), f AS (
  SELECT *, (n_words < 50)::BIGINT * 1 + (100 * n_repeat_words > 50 * n_words)::BIGINT * 2 + (100 * n_symbols > 10 * n_words)::BIGINT * 4
         + (100 * n_dup_lines > 50 * n_lines)::BIGINT * 8 + (word_chars < 2 * n_words)::BIGINT * 16 + (word_chars > 15 * n_words)::BIGINT * 32 AS failed_bits
  FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits
FROM f
"""
