"""op2: near-duplicate classes of ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from tomeweave.llm import near_dup
from tomeweave.llm.common import documents


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


#: CTEs ending in ``c(r, doc_id, n_shingles, component_id)`` over a relation ``docs`` with r (a number per row), doc_id and text.
#: Rows with equal sets are one class ``g``; pairs share a shingle that is among the first 16 % of either set (a pair at 0.85 must).
CTES = r"""
words AS (
  SELECT r, doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM docs
), sets AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE [hash(array_to_string(w[i:i + 4], ' ')) for i in range(1, len(w) - 3)] END)) AS s FROM words
), g AS (
  SELECT row_number() OVER () AS g, s, len(s) AS n, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s
), el AS (
  SELECT g, n, unnest(s) AS e, unnest(range(1, n + 1)) AS p FROM g
), pre AS (
  SELECT g, n, e FROM el WHERE p <= n - ceil(0.85 * n) + 1
), cand AS (
  SELECT DISTINCT a.g AS a, b.g AS b FROM pre a JOIN pre b ON a.e = b.e AND a.g < b.g AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), hit AS (
  SELECT c.a, c.b, x.n + y.n AS total, count(*) AS i FROM cand c JOIN el x ON x.g = c.a JOIN el z ON z.g = c.b AND z.e = x.e JOIN g y ON y.g = c.b GROUP BY ALL
), link AS (
  SELECT a, b FROM hit WHERE 100 * i >= 85 * (total - i)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT g, g FROM g UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b
), comp AS (
  SELECT a, min(first) AS component_id FROM reach JOIN g ON g.g = reach.b GROUP BY a
), c AS (
  SELECT r, sets.doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE component_id END AS component_id
  FROM sets LEFT JOIN g ON g.s = sets.s LEFT JOIN comp ON comp.a = g.g
)
"""
SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), {CTES}
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM c
"""
