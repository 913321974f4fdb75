"""VLOOKUP as a join: the first row of the table whose key is equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.values import number_text


def _key(c: Column, kind: str) -> Column:
    """Texts match without case; a number matches the text that spells it; null is 0 and ''."""
    if kind in ("string",):
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit("0")).otherwise(F.lower(c))
    return F.coalesce(number_text(c.cast("double")), F.lit("0"))


def vlookup(df: DataFrame, value: str, table: DataFrame, index: int, *, columns: list[str] | None = None, order: list[str] | None = None, into: str = "found") -> DataFrame:
    """``df`` with column ``into`` and its error in ``into + '_error'``.

    The table's first column is the key, column ``index`` (from 1) the result.
    Of several rows with the key, the first by ``order`` counts; the table is
    brought down to those before the join, with partial aggregation, so neither
    side grows.  Spark broadcasts the result if it is small by its statistics,
    and joins by sorting otherwise.  No match: #N/A; an index outside the table:
    #VALUE! or #REF!.
    """
    names = columns or table.columns
    if index < 1 or index > len(names):
        return df.withColumn(into, F.lit(None).cast("string")).withColumn(f"{into}_error", F.lit("#VALUE!" if index < 1 else "#REF!"))
    kinds = dict(table.dtypes)
    place = F.struct(*[F.col(c) for c in (order or names)])
    result = F.struct(F.col(names[index - 1]).alias("v"))
    first = table.groupBy(_key(F.col(names[0]), kinds[names[0]]).alias("__key")).agg(F.min_by(result, place).alias("__hit"))
    looked = df.withColumn("__look", _key(F.col(value), dict(df.dtypes)[value])).join(first, F.col("__look") == F.col("__key"), "left")
    return looked.select(*df.columns, F.col("__hit.v").alias(into), F.when(F.col("__hit").isNull(), F.lit("#N/A")).alias(f"{into}_error"))
