"""Chart aggregations and geometry: series, stacks, shares, angles, axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(df: DataFrame, category: str, name: str, value: Column, names: list) -> DataFrame:
    """One row a category, one column a series: sums, nulls where there is nothing."""
    return df.groupBy(category).pivot(name, names).agg(value)


def stacks(df: DataFrame, category: str, order: str, value: str, *, mixed: bool = False) -> DataFrame:
    """``df`` with columns base and top: where each series' bar starts and ends.

    Bars stack positive and negative values apart, and a null has no bar; areas
    (``mixed``) stack all in one sum, null as 0.  A category holds one row a
    series, so its window is small.
    """
    before = Window.partitionBy(category).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    if mixed:
        base = F.coalesce(F.sum(F.coalesce(v, F.lit(0.0))).over(before), F.lit(0.0))
        return df.withColumn("base", base).withColumn("top", F.col("base") + F.coalesce(v, F.lit(0.0)))
    up = F.coalesce(F.sum(F.when(v >= 0, v)).over(before), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(v < 0, v)).over(before), F.lit(0.0))
    return df.withColumn("base", F.when(v >= 0, up).when(v < 0, down)).withColumn("top", F.col("base") + v)


def shares(df: DataFrame, category: str, value: str, into: str = "share") -> DataFrame:
    """Percent of the category's total of positive values; 0 where that is 0."""
    total = F.sum(F.when(F.col(value) > 0, F.col(value))).over(Window.partitionBy(category))
    return df.withColumn(into, F.coalesce(F.try_divide(F.col(value), total) * 100, F.lit(0.0)))


def stack_extent(df: DataFrame, category: str, value: str) -> DataFrame:
    """(low, high) over all categories of their negative and positive sums."""
    v = F.col(value)
    sums = df.groupBy(category).agg(F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("down"))
    return sums.agg(F.min("down").alias("low"), F.max("up").alias("high"))


def pie(df: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """start and end angle of each slice of pie ``by``, from the top, clockwise; what is not positive has none."""
    v = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    whole = F.sum(v).over(Window.partitionBy(by))
    upto = F.sum(v).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    turn = lambda s: F.try_divide(s, whole) * (2 * math.pi) - math.pi / 2
    return df.withColumn("start", turn(upto - v)).withColumn("end", turn(upto))


def nice(c: Column) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten, mirrored for negatives; 1 for 0."""
    size = F.abs(c)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(size)))
    ratio = size / unit
    step = F.when(ratio <= 1, F.lit(1.0)).when(ratio <= 2, F.lit(2.0)).when(ratio <= 5, F.lit(5.0)).otherwise(F.lit(10.0))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.signum(c) * step * unit)


def series_range(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(low, high) of the values; a single value reaches to 0, nothing is 0 to 1."""
    found = df.groupBy(*by).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    one = F.col("a") == F.col("b")
    low = F.when(F.col("a").isNull() | (one & (F.col("a") >= 0)), F.lit(0.0)).otherwise(F.col("a"))
    high = F.when(F.col("a").isNull() | (one & (F.col("a") == 0)), F.lit(1.0)).when(one & (F.col("a") < 0), F.lit(0.0)).otherwise(F.col("b"))
    return found.select(*by, low.alias("low"), high.alias("high"))


def ticks(df: DataFrame, low: str, high: str, intervals: int = 5) -> DataFrame:
    """Rows at equal steps from low to high, with the label of each."""
    out = df.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(intervals))))
    at = F.col(low) + (F.col(high) - F.col(low)) * F.col("tick") / intervals
    shown = F.round(at, 1)
    label = F.when(F.abs(at) >= 10, F.round(at, 0).cast("bigint").cast("string")).when(shown == F.floor(shown), F.floor(shown).cast("string")).otherwise(shown.cast("string"))
    return out.withColumn("at", at).withColumn("label", label)


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points with both coordinates."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def radar(df: DataFrame, index: str, value: str, by: str, radius: float = 1.0) -> DataFrame:
    """x and y of each vertex: angles from the top, lengths relative to the highest value."""
    group = Window.partitionBy(by)
    angle = F.lit(-math.pi / 2) + F.lit(2 * math.pi) * F.col(index) / F.count("*").over(group)
    length = F.coalesce(F.try_divide(F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)), F.max(value).over(group)), F.lit(0.0)) * radius
    return df.withColumn("x", length * F.cos(angle)).withColumn("y", length * F.sin(angle))
