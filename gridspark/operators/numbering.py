"""Row numbers of tables of any size: rows are sorted by ranges, and each range counts on from those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.stage import folder, partitions, written


def numbered(df: DataFrame, *order: Column | str, by: list[str] | None = None, into: str = "row") -> DataFrame:
    """``df`` with ``into``: row numbers from 1 in the given order, within ``by`` if there is one.

    What ``row_number`` says, but a group may be any part of the table: a task
    sorts one range of a bounded number of rows, whatever the groups.
    The sorted rows are written once (kept in the session where there is no
    shared folder), since ranges are drawn from a sample.
    """
    by = by or []
    parts = partitions(df.sparkSession, df.count())
    ranged = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    placed = ranged.select(*[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place"))
    kept = written(placed) if folder(df.sparkSession) else placed.persist()
    # As many rows as there are ranges and groups, written so that Spark knows their size when it joins them.
    pieces = written(kept.groupBy("__part", *by).agg(F.min("__place").alias("__first"), F.count("*").alias("__n")))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = pieces.select(F.col("__part").alias("__in"), *[F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)], (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = [F.col("__part") == F.col("__in"), *[F.col(f"`{c}`").eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]]
    return kept.join(ahead, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__place") + F.col("__shift")).alias(into))
