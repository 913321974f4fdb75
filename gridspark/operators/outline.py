"""Outlines of sheets: groups of rows from their levels, and the rows that collapsed groups hide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.stage import partitions

#: Rows of a band, in which runs are found by one sort.
BAND = 65536


def groups(rows: DataFrame, *, summary_below: bool = True, by: str = "sheet", row: str = "row", level: str = "level", collapsed: str = "collapsed") -> DataFrame:
    """(by, level, first_row, last_row, collapsed): for each level the runs of rows at that level or a deeper one.

    Rows are (by, row, level, collapsed), level 0 or null for rows in no group;
    rows that are absent have none.  A group is collapsed if its summary row,
    the one after it (or before it, as ``summary_below`` says), is marked so.
    Runs are found in bands of rows; only those that touch an end of a band are
    put together with their neighbours.
    """
    deep = rows.where((F.col(level) > 0) & F.col(row).isNotNull()).select(F.col(by).alias("__by"), F.col(row).cast("long").alias("__row"), F.explode(F.sequence(F.lit(1), F.col(level).cast("int"))).alias("__level"))
    band = ["__by", "__level", "__band"]
    parts = partitions(rows.sparkSession, rows.agg(F.sum(F.when(F.col(level) > 0, F.col(level)))).first()[0] or 0)
    # Rows less their rank are the same along a run; a row that is there twice has one rank.
    island = F.col("__row") - F.dense_rank().over(Window.partitionBy(*band).orderBy("__row"))
    ends = [F.min("__row").alias("__row"), F.max("__last").alias("__last")]
    pieces = deep.withColumn("__band", F.floor(F.col("__row") / BAND)).repartition(parts, *band).withColumns({"__island": island, "__last": F.col("__row")}).groupBy(*band, "__island").agg(*ends)
    touching = (F.pmod("__row", F.lit(BAND)) == 0) | (F.pmod("__last", F.lit(BAND)) == BAND - 1)
    along = Window.partitionBy("__by", "__level").orderBy("__row")
    begins = F.coalesce(F.col("__row") != F.lag("__last").over(along) + 1, F.lit(True))
    joined = pieces.where(touching).withColumn("__begins", begins.cast("int")).withColumn("__run", F.sum("__begins").over(along)).groupBy("__by", "__level", "__run").agg(*ends)
    runs = pieces.where(~touching).select("__by", "__level", "__row", "__last").unionByName(joined.drop("__run"))
    marked = rows.where(F.coalesce(F.col(collapsed), F.lit(False))).select(F.col(by).alias("__by"), F.col(row).cast("long").alias("__at"), F.lit(True).alias("__marked")).distinct()
    placed = runs.withColumn("__at", F.col("__last") + 1 if summary_below else F.col("__row") - 1).repartition(parts, "__by", "__at").join(marked, ["__by", "__at"], "left")
    return placed.select(F.col("__by").alias(by), F.col("__level").alias(level), F.col("__row").alias("first_row"), F.col("__last").alias("last_row"), F.coalesce("__marked", F.lit(False)).alias(collapsed))


def with_hidden(rows: DataFrame, *, summary_below: bool = True, by: str = "sheet", row: str = "row", level: str = "level", collapsed: str = "collapsed", into: str = "hidden") -> DataFrame:
    """``rows`` with whether a collapsed group has them: its rows are listed once, a band at a time, and joined by their numbers."""
    shut = groups(rows, summary_below=summary_below, by=by, row=row, level=level, collapsed=collapsed).where(F.col(collapsed))
    parts = partitions(rows.sparkSession, rows.count())
    # Sheets meet as structs: a null one is one, too.
    spans = shut.select(F.struct(F.col(by)).alias("__by"), "last_row", F.explode(F.sequence("first_row", "last_row", F.lit(BAND).cast("long"))).alias("__from"))
    covered = spans.select("__by", F.explode(F.sequence("__from", F.least("last_row", F.col("__from") + BAND - 1))).alias("__row")).repartition(parts, "__by", "__row").distinct().withColumn("__hidden", F.lit(True))
    placed = rows.withColumns({"__of": F.struct(F.col(by)), "__at": F.col(row).cast("long")}).repartition(parts, "__of", "__at")
    return placed.join(covered, (F.col("__of") == F.col("__by")) & (F.col("__at") == F.col("__row")), "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__hidden", F.lit(False)).alias(into))
