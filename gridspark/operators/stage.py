"""Intermediate rows that are written once and read as often as needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that one task sorts.
ROWS = 200_000


def partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: as many as the session has, more where tasks would grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, if one is set."""
    return spark.conf.get("spark.checkpoint.dir", None)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that driver and executors share (``spark.checkpoint.dir``); as it is where none is set."""
    spark = df.sparkSession
    shared = folder(spark)
    if not shared:
        return df
    path = f"{shared}/gridspark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
