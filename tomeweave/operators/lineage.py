"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is named, a folder in the warehouse, which all machines share too."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
