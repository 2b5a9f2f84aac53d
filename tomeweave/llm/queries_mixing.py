"""op5: all ``documents`` mixed to source weights 1, 2, 3."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import mixing
from tomeweave.llm.common import documents


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return m.rows.select("doc_id", *(F.col(x).alias(y) for x, y in ((m.size, "size"), (m.source_size, "source_size"), (m.target, "target"), (m.taken, "taken"))))


#: CTE ``k(doc_id, source, size, source_size, target, taken)`` over a relation ``docs`` with r, doc_id, source and size.
CTES = r"""
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM docs GROUP BY source
), b AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM s WINDOW o AS (ORDER BY source_size * 18 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, (total - cap_before) * weight >= 3 * source_size * (weights - weight_before) AS full_up FROM b
), l AS (
  SELECT *, coalesce(sum(3 * source_size) FILTER (full_up) OVER (), 0) AS cap_full, coalesce(sum(weight) FILTER (full_up) OVER (), 0) AS weight_full FROM f
), t AS (
  SELECT source, source_size, CASE WHEN full_up THEN (3 * source_size)::DOUBLE
         ELSE ((total - cap_full) * weight)::BIGINT::DOUBLE / (weights - weight_full)::BIGINT::DOUBLE END AS target FROM l
), k AS (
  SELECT r, doc_id, d.source, size, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS epochs, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT r, doc_id, source, size, source_size, target,
         (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM k
)
"""
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), {CTES}
SELECT doc_id, size, source_size, target, taken FROM x
"""
