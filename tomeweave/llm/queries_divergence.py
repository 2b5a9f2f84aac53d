"""op11: the sources of each language of ``documents``, apart by their terms."""

from pyspark.sql import DataFrame, SparkSession

from tomeweave.llm import divergence
from tomeweave.llm.common import documents


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


#: CTEs ending in ``r(lang, source, part, item, value, rank)`` over a relation ``docs`` with text, lang and source.
CTES = r"""
d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM docs
), g AS (
  SELECT DISTINCT lang, source FROM d
), w AS (
  SELECT r, lang, source, unnest(t) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS documents FROM w GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM c GROUP BY ALL HAVING sum(documents) >= 10
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM k GROUP BY ALL
), m AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT m.*, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p, 1 + (1000000000 * (lang_n + 2)) // (total + 2 * v) AS q FROM m JOIN l USING (lang)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM part
)
"""
SQL = f"""
WITH docs AS (SELECT text, lang, source FROM documents), {CTES}
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
