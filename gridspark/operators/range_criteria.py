"""SUMIF and COUNTIF with criteria that come as rows: one criterion, or a million.

A criterion is read into a comparison and an operand by column functions.  The
values of a group are brought down to distinct ones, put in order once, and
summed up to each; a criterion looks its operand up there.  No row of values
meets a row of criteria otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.values import NUMBER, parse_number

#: Parts of a group's values, each summed up in a task of its own.
PARTS = 128

_SIGN = r"^\s*(<=|>=|<>|=|>|<)\s*([\s\S]*)$"


def read_criterion(criterion: Column) -> tuple[Column, Column, Column]:
    """(comparison, operand, the number that the operand spells or null) of a criterion's text."""
    sign = F.regexp_extract(criterion, _SIGN, 1)
    operand = F.when(sign != "", F.regexp_extract(criterion, _SIGN, 2)).otherwise(criterion)
    number = F.when((operand != "") & ((F.trim(operand) == "") | F.trim(operand).rlike(NUMBER)), parse_number(operand))
    return F.when(sign == "", F.lit("=")).otherwise(sign), operand, number


def _text_place(text: Column) -> Column:
    """A number in the order of texts, by their first seven bytes."""
    first = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(first, 16, 10).cast("double")


def upto(rows: DataFrame, by: list[str], value: str, layers: list[str], place: Column) -> DataFrame:
    """(by, value, layers, layer_before ...): each layer's own sum at a value, and that of all smaller ones of the group.

    A group is cut into parts at approximate quantiles of ``place``, a number
    in the order of the values; parts are summed up on their own, then their
    totals, of which a group has PARTS + 1 at most.
    """
    shares = [i / PARTS for i in range(1, PARTS)]
    placed = rows.withColumn("__place", place)
    bounds = placed.groupBy(*by).agg(F.percentile_approx("__place", shares, 1000).alias("__bounds"))
    part = F.size(F.filter(F.col("__bounds"), lambda b: b < F.col("__place")))
    parted = placed.join(bounds, by).withColumn("__part", part).drop("__bounds", "__place")
    inner = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = parted.groupBy(*by, "__part").agg(*[F.sum(c).alias(c) for c in layers])
    ahead = totals.select(*by, "__part", *[zero(F.sum(c).over(outer)).alias(f"__{c}") for c in layers])
    summed = parted.select(*by, "__part", value, *layers, *[zero(F.sum(c).over(inner)).alias(f"{c}_before") for c in layers])
    joined = summed.join(ahead, [*by, "__part"])
    return joined.select(*by, value, *layers, *[(F.col(f"{c}_before") + F.col(f"__{c}")).alias(f"{c}_before") for c in layers])


def by_criteria(asked: DataFrame, values: DataFrame, *, by: list[str], criterion: str, value: str, summed: str | None = None, count_into: str = "n", sum_into: str = "total") -> DataFrame:
    """``asked`` with the number of ``values`` rows of its group that meet its criterion, and what stands in ``summed`` beside them.

    A number operand compares with numbers and with texts that spell one; of
    other values only ``<>`` is true.  A text operand compares with texts
    without case; numbers are unlike any.  Blank values meet ``<>`` of a
    number, and ``=``, ``<=``, ``>=`` of nothing.  A null criterion meets
    blanks, empty texts and zeros.  Groups without values give 0.
    """
    is_text = dict(values.dtypes)[value] == "string"
    v = F.col(value)
    spelt = F.when(v != "", parse_number(v)) if is_text else v.cast("double")
    added = F.coalesce(F.col(summed).cast("double"), F.lit(0.0)) if summed else F.lit(0.0)
    base = values.select(*by, spelt.alias("__num"), F.lower(v).alias("__txt") if is_text else F.lit(None).cast("string").alias("__txt"), (v.isNull()).alias("__none"), added.alias("__s"))
    counted = base.groupBy(*by, "__num", "__txt", "__none").agg(F.count("*").alias("__n"), F.sum("__s").alias("__s"))
    whole = counted.groupBy(*by).agg(*[F.sum(F.when(c, F.col(f"__{m}")).otherwise(0)).alias(f"__{m}_{k}") for m in ("n", "s") for k, c in (("all", F.lit(True)), ("none", F.col("__none")), ("num", F.col("__num").isNotNull()), ("txt", F.col("__txt").isNotNull()))])

    sign, operand, wanted = read_criterion(F.col(criterion))
    no = F.col(criterion).isNull()
    read = asked.withColumns({"__sign": F.when(no, "=").otherwise(sign), "__operand": F.lower(F.coalesce(operand, F.lit(""))), "__wanted": F.when(no, F.lit(0.0)).otherwise(wanted)})
    layers = ["__n", "__s"]

    def looked_up(axis: str, wish: str) -> DataFrame:
        kept = counted.where(F.col(axis).isNotNull()).select(*by, F.col(axis).alias("__at"), *layers)
        asks = read.where(F.col(wish).isNotNull()).select(*by, F.col(wish).alias("__at"), F.lit(0).cast("long").alias("__n"), F.lit(0.0).alias("__s"))
        both = kept.unionByName(asks.distinct()).groupBy(*by, "__at").agg(*[F.sum(c).alias(c) for c in layers])
        place = F.col("__at") if axis == "__num" else _text_place(F.col("__at"))
        found = upto(both, by, "__at", layers, place)
        return found.select(*by, F.col("__at").alias(wish), *[F.struct(c, f"{c}_before").alias(f"{c}{axis}") for c in layers])

    found = read.join(looked_up("__num", "__wanted"), [*by, "__wanted"], "left")
    if is_text:
        found = found.join(looked_up("__txt", "__operand"), [*by, "__operand"], "left")
    found = found.join(whole, by, "left")

    def answer(m: str) -> Column:
        total = {k: F.coalesce(F.col(f"__{m}_{k}"), F.lit(0)) for k in ("all", "none", "num", "txt")}

        def over(axis: str, known: Column, unlike: Column) -> Column:
            own, before = (F.coalesce(F.col(f"__{m}__{axis}.{c}"), F.lit(0)) for c in (f"__{m}", f"__{m}_before"))
            s = F.col("__sign")
            return (
                F.when(s == "=", own).when(s == "<", before).when(s == "<=", before + own)
                .when(s == ">", known - before - own).when(s == ">=", known - before).otherwise(unlike - own)
            )

        blank = F.when((F.col("__operand") == "") & F.col("__sign").isin("=", "<=", ">="), total["none"]).otherwise(F.lit(0))
        by_number = over("num", total["num"], total["all"])
        by_text = over("txt", total["txt"], total["txt"]) if is_text else F.when(F.col("__sign") == "<>", total["all"] - total["none"]).otherwise(F.lit(0))
        empty = F.coalesce(F.col(f"__{m}__txt.__{m}"), F.lit(0)) if is_text else F.coalesce(F.col(f"__{m}__num.__{m}"), F.lit(0))
        return F.when(F.col(criterion).isNull(), total["none"] + empty).when(F.col("__wanted").isNotNull(), by_number).otherwise(by_text + blank)

    out = [answer("n").cast("long").alias(count_into), *([answer("s").cast("double").alias(sum_into)] if summed else [])]
    return found.select(*[F.col(f"`{c}`") for c in asked.columns], *out)
