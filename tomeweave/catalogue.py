"""All registered queries of the document-fusion jobs with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomeweave.plans import corpus, fusion, knowledge, retrieval
from tomeweave.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "flagship", "fusion", "knowledge", "retrieval"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["v10_top_k"](spark, sf_dir)
