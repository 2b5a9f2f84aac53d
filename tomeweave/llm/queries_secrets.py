"""op9: secrets in whole ``documents`` texts."""

from collections.abc import Callable

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import secrets
from tomeweave.llm.common import documents

BASE = ("assign", "access", "hex")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.col(at)
    count = [F.size(F.filter(F.transform(spans, lambda x: x["kind"]), _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _sql() -> str:
    """Positions in SQL: the lengths of the pieces between the matches and of the matches before."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for n, rule in enumerate(secrets.RULES):
        # Group 1 is the head, 2 or 3 (the head has a group of its own) the part whose length counts.
        # Letters of the head in either case, by classes: this dialect's own flag also folds letters beyond ASCII.
        head = re.sub(r"(?<!\\)[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", rule.head) if rule.head else ""
        pattern = f"({head})({rule.pattern})" if rule.head else f"({rule.pattern})"
        body = 3 if rule.head else 1
        parts.append(
            f"SELECT r, {n} AS n, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, {quoted(pattern)}) AS gaps, "
            f"regexp_extract_all(t, {quoted(pattern)}, 0) AS hits, regexp_extract_all(t, {quoted(pattern)}, {body}) AS bodies FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (
  SELECT r, n, kind, least, unnest(range(1, len(hits) + 1)) AS k, gaps, hits, bodies FROM m
), p AS (
  SELECT r, n, kind, list_sum([length(x) for x in gaps[1:k]]) + coalesce(list_sum([length(x) for x in hits[1:k - 1]]), 0) AS b, length(hits[k]) AS l
  FROM u WHERE length(bodies[k]) >= least
), s AS (
  SELECT r, string_agg(kind || ':' || b::BIGINT || ':' || (b + l)::BIGINT, ',' ORDER BY b, n) AS spans,
         string_agg(kind || ':' || b::BIGINT || ':' || (b + l)::BIGINT, ',' ORDER BY b, n) FILTER (n < 3) AS base,
         count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex
  FROM p GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)
"""


SQL = _sql()
