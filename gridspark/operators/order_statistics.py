"""Order statistics of many ranges at once: the n-th values that rows ask for.

Values are counted, so that equal ones are one row.  Each range is cut into
bands at approximate quantiles; a band's count says which of the wanted places
it holds, and only bands that hold one go on.  Rounds go on until each of them
is small enough to be put in order by one task, however large its range is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.stage import written

#: Bands that a range, or a band of it, is cut into, and distinct values that one task may put in order.
BANDS = 64
SORTED = 100_000


def order_statistics(rows: DataFrame, wanted: DataFrame, *, by: list[str], value: str, place: str = "place", into: str = "found") -> DataFrame:
    """``wanted`` (by, place, ...) with the value in that place, from 1 and in ascending order, of the rows of its range.

    Nulls take no place; a place that the range doesn't have gives null.
    """
    v = F.col(value)
    counted = rows.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n")).withColumn("__band", F.lit(""))
    counted = written(counted)
    asked = written(wanted.select(*by, F.col(place).cast("long").alias("__place")).distinct().withColumns({"__band": F.lit(""), "__left": F.col("__place")}))
    key = [*by, "__band"]
    while (counted.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > SORTED:
        shares = [i / BANDS for i in range(1, BANDS)]
        bounds = counted.groupBy(*key).agg(F.percentile_approx("__v", shares, 10_000).alias("__bounds"))
        part = F.size(F.filter(F.col("__bounds"), lambda b: b < F.col("__v")))
        parted = written(counted.join(bounds, key).withColumn("__part", part).drop("__bounds"))
        totals = parted.groupBy(*key, "__part").agg(F.sum("__n").alias("__n"))
        # BANDS rows for each band that is cut.
        before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        ahead = totals.withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        name = lambda: F.concat("__band", F.lit("/"), F.col("__part").cast("string"))
        holds = (F.col("__left") > F.col("__ahead")) & (F.col("__left") <= F.col("__ahead") + F.col("__n"))
        asked = written(asked.join(ahead, key).where(holds).select(*by, name().alias("__band"), "__place", (F.col("__left") - F.col("__ahead")).alias("__left")))
        finer = parted.withColumn("__band", name()).drop("__part")
        counted = written(finer.join(asked.select(*key).distinct(), key, "left_semi"))
    order = Window.partitionBy(*key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("__upto", F.sum("__n").over(order))
    hit = (F.col("__left") <= F.col("__upto")) & (F.col("__left") > F.col("__upto") - F.col("__n"))
    found = asked.join(summed, key).where(hit).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__place").alias("__asked"), F.col("__v").alias(into))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(place).cast("long") == F.col("__asked")]
    return wanted.join(found, same, "left").select(*wanted.columns, into)


def percentiles(rows: DataFrame, *, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share from 0 to 1): exact percentiles, interpolated between the two values that are nearest."""
    sized = rows.groupBy(*by).agg(F.count(value).alias("__n"))
    rank = lambda s: F.lit(float(s)) * (F.col("__n") - 1)
    places = F.array(*[F.struct(F.lit(n).alias("name"), rank(s).alias("rank"), at.cast("long").alias("place")) for n, s in shares.items() for at in (F.floor(rank(s)) + 1, F.ceil(rank(s)) + 1)])
    wanted = sized.where("__n > 0").select(*by, F.explode(places).alias("at")).select(*by, "at.*").distinct()
    found = order_statistics(rows, wanted, by=by, value=value)

    def between(name: str) -> Column:
        own = F.col("name") == name
        low, high = F.min(F.when(own, F.col("found").cast("double"))), F.max(F.when(own, F.col("found").cast("double")))
        rest = F.max(F.when(own, F.col("rank") - F.floor("rank")))
        return (low + (high - low) * rest).alias(name)

    return found.groupBy(*by).agg(*[between(n) for n in shares])
