"""op8: every ``pages`` url judged by rules and by its template."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import urls


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return rows.select("page_id", *(F.col(names[x]).alias(x) for x in ("host", "path", "rule", "verdict", "template")))


#: Levels that the SQL spells out; the given tables have fewer.
LEVELS = 8


def _level(k: int) -> str:
    """One level of the tree: from ``t{k-1}`` to ``t{k}``; shapes that end above stay as they are."""
    return f"""
r{k} AS (SELECT *, shape[{k}] AS s FROM t{k - 1} WHERE len(shape) >= {k}),
c{k} AS (SELECT host, template, s, sum(n) AS n, sum(m) AS m, sum(b) AS b FROM r{k} GROUP BY ALL),
p{k} AS (SELECT host, template, count(*) AS k, sum(n) AS n, sum(m) AS m, sum(b) AS b FROM c{k} GROUP BY ALL),
e{k} AS (
  SELECT c.host, c.template, c.s, CASE WHEN c.m > 0 AND NOT (p.k > 20 AND p.n < 5 * p.k)
    AND pow(c.b::DOUBLE * p.m::DOUBLE - p.b::DOUBLE * c.m::DOUBLE, 2.0) > 4.0 * p.b::DOUBLE * (p.m::DOUBLE - p.b::DOUBLE) * c.m::DOUBLE THEN '/' || c.s ELSE '/*' END AS step
  FROM c{k} c JOIN p{k} p ON c.host = p.host AND c.template = p.template
),
u{k} AS (
  SELECT r.host, r.shape, r.n, r.b, r.m, r.template || e.step AS template, r.share FROM r{k} r JOIN e{k} e ON r.host = e.host AND r.template = e.template AND r.s = e.s
),
t{k} AS (
  SELECT * EXCLUDE (share), (sum(b) OVER w + 4.0::DOUBLE * min(share) OVER w) / (sum(m) OVER w + 4.0::DOUBLE) AS share FROM u{k} WINDOW w AS (PARTITION BY host, template)
  UNION ALL SELECT * FROM t{k - 1} WHERE len(shape) < {k}
)"""


def _rules(value: str) -> str:
    return "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
        for r in sorted(urls.RULES, key=lambda r: -len(r.name))
    ) + " END"


SQL = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), l AS (
  SELECT *, {_rules("name")} AS rule, {_rules("verdict")} AS label, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') AS seg FROM b
), s AS (
  SELECT * EXCLUDE (seg), CASE WHEN path <> '' THEN seg ELSE []::VARCHAR[] END AS shape FROM l
), shapes AS (
  SELECT host, shape, count(*) AS n, count(*) FILTER (label = 'block') AS b, count(label) AS m FROM s GROUP BY ALL
), total AS (
  SELECT coalesce(sum(b), 0)::DOUBLE / greatest(coalesce(sum(m), 0), 1)::DOUBLE AS share FROM shapes
), t0 AS (
  SELECT shapes.*, '' AS template, (sum(b) OVER (PARTITION BY host) + 4.0::DOUBLE * share) / (sum(m) OVER (PARTITION BY host) + 4.0::DOUBLE) AS share FROM shapes, total
), {", ".join(map(_level, range(1, LEVELS + 1)))}
SELECT page_id, s.host AS host, path, rule, coalesce(label, CASE WHEN share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template
FROM s JOIN t{LEVELS} t ON s.host = t.host AND s.shape = t.shape
"""
