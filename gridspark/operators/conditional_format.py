"""Conditional formats: predicates, range statistics, graphics, and which rule wins.

A rule's range is a group (``by``).  Statistics of a range are aggregates joined
back to its rows, not windows, so that a range over a whole table does not have
to fit one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.values import parse_number
from gridspark.operators.order_statistics import order_statistics as _statistics
from gridspark.operators.order_statistics import percentiles

#: Accuracy of the sketches, and rows that one task may sort.
_ACCURACY = 10_000
_SORTED = 100_000

_COMPARE = {
    "equal": lambda v, a: v == a,
    "notEqual": lambda v, a: v != a,
    "greaterThan": lambda v, a: v > a,
    "greaterThanOrEqual": lambda v, a: v >= a,
    "lessThan": lambda v, a: v < a,
    "lessThanOrEqual": lambda v, a: v <= a,
}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def cell_is(value: Column, operator: str, first: float | str, second: float | None = None) -> Column:
    """Compares with literals; texts know equal and notEqual only, without case; between is inclusive as given."""
    if isinstance(first, str):
        if operator not in ("equal", "notEqual"):
            return F.lit(False)
        return _sure(_COMPARE[operator](F.lower(F.coalesce(value, F.lit(""))), F.lit(first.lower())))
    if operator in ("between", "notBetween"):
        if second is None:
            return F.lit(False)
        inside = value.between(first, second)
        return _sure(inside if operator == "between" else ~inside)
    return _sure(_COMPARE[operator](value, F.lit(float(first)))) if operator in _COMPARE else F.lit(False)


def text_rule(value: Column, kind: str, text: str) -> Column:
    """contains, notContains, beginsWith or endsWith, without case; an empty text is in nothing."""
    v, t = F.lower(F.coalesce(value.cast("string"), F.lit(""))), text.lower()
    if kind == "notContains":
        return ~v.contains(t) if text else F.lit(True)
    return {"contains": v.contains, "beginsWith": v.startswith, "endsWith": v.endswith}[kind](t) if text else F.lit(False)


def blank(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def erroneous(kind: Column) -> Column:
    """containsErrors; a cell that is absent holds none."""
    return _sure(kind == "error")


def _with(df: DataFrame, by: list[str], stats: DataFrame) -> DataFrame:
    """Joins a range's statistics to its rows; one row of them for a whole table is broadcast."""
    if by:
        return df.join(stats, by, "left")
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(stats.withColumn("__one", F.lit(1))), "__one").drop("__one")


def _flagged(df: DataFrame, joined: DataFrame, into: str, flag: Column) -> DataFrame:
    return joined.select(*df.columns, _sure(flag).alias(into))


def repeated(df: DataFrame, value: str, *, by: list[str] | None = None, unique: bool = False, into: str = "match") -> DataFrame:
    """duplicateValues, or uniqueValues: counts of equal values, joined back.

    Counts are taken with partial aggregation, and a value that most rows hold
    is one row of the counted side.
    """
    keys = [*(by or []), value]
    counted = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__n"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = df.join(counted, on, "left")
    return _flagged(df, joined, into, F.col(value).isNotNull() & ((F.col("__n") == 1) if unique else (F.col("__n") > 1)))


def top(df: DataFrame, value: str, rank: int = 10, *, percent: bool = False, bottom: bool = False, by: list[str] | None = None, into: str = "match") -> DataFrame:
    """top10: values not below the n-th highest, ties included; n is ``rank``, or that percentage of the values.

    The n-th value is an order statistic, of all groups at once with ``by``; over
    a whole table it may be the end of a short top-k.
    """
    by = by or []
    v = F.col(value)
    sized = df.groupBy(*by).agg(F.count(v).alias("__count"))
    n = F.greatest(F.lit(1.0), F.ceil(F.col("__count") * rank / 100)) if percent else F.least(F.lit(float(rank)), F.col("__count").cast("double"))
    if by:
        place = n if bottom else F.col("__count") - n + 1
        wanted = sized.where("__count > 0").select(*by, place.cast("long").alias("__place"))
        limit = _statistics(df, wanted, by=by, value=value, place="__place", into="__limit").drop("__place")
    elif percent:
        found = order_statistic(df, value, max(1, math.ceil(df.where(v.isNotNull()).count() * rank / 100)), descending=not bottom)
        return df.select(*df.columns, _sure(v <= F.lit(found) if bottom else v >= F.lit(found)).alias(into))
    else:
        # The best ``rank`` rows: Spark keeps that many per task and merges them.
        best = df.where(v.isNotNull()).orderBy(v if bottom else F.desc(value)).limit(rank)
        limit = best.agg((F.max if bottom else F.min)(v).alias("__limit"))
    return _flagged(df, _with(df, by, limit), into, v <= F.col("__limit") if bottom else v >= F.col("__limit"))


def order_statistic(df: DataFrame, value: str, place: int, *, descending: bool = False) -> float | None:
    """The value in that place (from 1) of a whole table, nulls left out.

    Approximate percentiles, merged from sketches, give a band that must hold
    the place; the band is narrowed until it is small enough to sort.  Only
    counts and bounds come to the driver.
    """
    v = -F.col(value) if descending else F.col(value)
    rows = df.where(F.col(value).isNotNull()).select(v.alias("v"))
    total, margin = rows.count(), 2.0 / _ACCURACY
    if not 1 <= place <= total:
        return None
    while total > _SORTED:
        p = place / total
        low, high = rows.agg(F.percentile_approx("v", [max(0.0, p - margin), min(1.0, p + margin)], _ACCURACY)).first()[0]
        below, inside = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not below < place <= below + inside:
            margin *= 4
        elif low == high:
            return -low if descending else low
        elif inside == total:
            # The sketch no longer narrows: halve what lies between the bounds.
            middle = low / 2 + high / 2
            if not low < middle < high:
                found = low if place <= rows.where(F.col("v") == low).count() else high
                return -found if descending else found
            first = rows.where(F.col("v") <= middle).count()
            upper = place > first
            rows, place, total = rows.where(F.col("v") > middle if upper else F.col("v") <= middle), place - first * upper, total - first if upper else first
        else:
            rows, place, total = rows.where(F.col("v").between(low, high)), place - below, inside
    found = rows.orderBy("v").limit(place).agg(F.max("v")).first()[0]
    return -found if descending else found


def percentile_of(df: DataFrame, value: str, share: float) -> float | None:
    """The exact percentile of a whole table, interpolated between order statistics."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    rank = share * (n - 1)
    low = order_statistic(df, value, math.floor(rank) + 1)
    return low if rank == math.floor(rank) else low + (order_statistic(df, value, math.ceil(rank) + 1) - low) * (rank - math.floor(rank))


def average_rule(df: DataFrame, value: str, *, above: bool = True, inclusive: bool = False, deviations: float | None = None, by: list[str] | None = None, into: str = "match") -> DataFrame:
    """aboveAverage: against the mean plus ``deviations`` population deviations (not mirrored for below)."""
    by = by or []
    limit = F.avg(value) + (F.lit(float(deviations)) * F.stddev_pop(value) if deviations is not None else F.lit(0.0))
    joined = _with(df, by, df.groupBy(*by).agg(limit.alias("__limit")))
    v, t = F.col(value), F.col("__limit")
    return _flagged(df, joined, into, (v >= t if inclusive else v > t) if above else (v <= t if inclusive else v < t))


def time_period(day: Column, period: str, today: Column) -> Column:
    """The ten periods, relative to ``today``; weeks start on Sunday, and last7Days ends today."""
    week = F.date_sub(today, (F.dayofweek(today) - 1).cast("int"))
    month = F.trunc(today, "month")
    spans = {
        "today": (today, F.date_add(today, 1)),
        "yesterday": (F.date_sub(today, 1), today),
        "tomorrow": (F.date_add(today, 1), F.date_add(today, 2)),
        "last7Days": (F.date_sub(today, 6), F.date_add(today, 1)),
        "thisWeek": (week, F.date_add(week, 7)),
        "lastWeek": (F.date_sub(week, 7), week),
        "nextWeek": (F.date_add(week, 7), F.date_add(week, 14)),
        "thisMonth": (month, F.add_months(month, 1)),
        "lastMonth": (F.add_months(month, -1), month),
        "nextMonth": (F.add_months(month, 1), F.add_months(month, 2)),
    }
    if period not in spans:
        return F.lit(False)
    first, after = spans[period]
    return _sure((day >= first) & (day < after))


@dataclass(frozen=True)
class Stop:
    """A threshold: kind is min, max, num, percent or percentile."""

    kind: str
    value: float = 0.0


def thresholds(df: DataFrame, value: str, stops: list[Stop], by: list[str] | None = None) -> DataFrame:
    """Per range, columns t0, t1, ...: each stop's threshold, from one pass of aggregates and one of order statistics."""
    low, high = F.min(value), F.max(value)

    def one(s: Stop) -> Column:
        if s.kind == "min":
            return low
        if s.kind == "max":
            return high
        if s.kind == "num":
            return F.lit(float(s.value))
        if s.kind == "percent":
            return low + (high - low) * (s.value / 100)
        if s.kind == "percentile" and not by:
            return F.lit(percentile_of(df, value, s.value / 100))
        return F.lit(None).cast("double")

    found = df.groupBy(*(by or [])).agg(*[one(s).cast("double").alias(f"t{i}") for i, s in enumerate(stops)])
    shares = {f"t{i}": s.value / 100 for i, s in enumerate(stops) if s.kind == "percentile"}
    if not by or not shares:
        return found
    return found.drop(*shares).join(percentiles(df, by=by, value=value, shares=shares), by, "left").select(*by, *[f"t{i}" for i in range(len(stops))])


def _hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")


def colour_scale(df: DataFrame, value: str, stops: list[tuple[Stop, str]], *, by: list[str] | None = None, into: str = "colour") -> DataFrame:
    """The colour between stops, red, green and blue each linear; ends beyond the outer stops."""
    joined = _with(df, by or [], thresholds(df, value, [s for s, _ in stops], by))
    v = F.col(value).cast("double")
    rgb = [[int(c[i : i + 2], 16) for i in (1, 3, 5)] for _, c in stops]
    out = F.lit(stops[-1][1])
    for i in range(len(stops) - 2, -1, -1):
        a, b = F.col(f"t{i}"), F.col(f"t{i + 1}")
        t = F.when(b == a, F.lit(0.0)).otherwise((v - a) / F.nullif(b - a, F.lit(0.0)))
        mixed = F.concat(F.lit("#"), *[_hex(F.floor(x + (y - x) * t + 0.5)) for x, y in zip(rgb[i], rgb[i + 1], strict=True)])
        out = F.when(v <= b, mixed).otherwise(out)
    last = F.col(f"t{len(stops) - 1}")
    out = F.when(v <= F.col("t0"), F.lit(stops[0][1])).when(v >= last, F.lit(stops[-1][1])).otherwise(out)
    return joined.select(*df.columns, F.when(v.isNotNull(), out).alias(into))


def data_bar(df: DataFrame, value: str, low: Stop = Stop("min"), high: Stop = Stop("max"), *, shortest: float = 10, longest: float = 90, by: list[str] | None = None, into: str = "percent") -> DataFrame:
    """Length of the bar in percent; none where the thresholds are equal."""
    joined = _with(df, by or [], thresholds(df, value, [low, high], by))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0))))
    bar = F.when(F.col(value).isNotNull() & (F.col("t0") != F.col("t1")), F.lit(float(shortest)) + (longest - shortest) * t)
    return joined.select(*df.columns, bar.alias(into))


def icon_set(df: DataFrame, value: str, stops: list[Stop], *, reverse: bool = False, by: list[str] | None = None, into: str = "icon") -> DataFrame:
    """Index of the icon: the last stop that the value reaches, from the second on."""
    joined = _with(df, by or [], thresholds(df, value, stops, by))
    index = F.lit(0)
    for i in range(1, len(stops)):
        index = F.when(F.col(value) >= F.col(f"t{i}"), F.lit(i)).otherwise(index)
    if reverse:
        index = F.lit(len(stops) - 1) - index
    known = F.col(value).isNotNull()
    for i in range(len(stops)):
        known = known & F.col(f"t{i}").isNotNull()
    return joined.select(*df.columns, F.when(known, index).cast("int").alias(into))


@dataclass(frozen=True)
class Rule:
    """A predicate over a row, its priority (lower wins) and the style it gives; without a style it blocks nothing."""

    name: str
    priority: int
    predicate: Column
    style: str | None


def winner(df: DataFrame, rules: list[Rule], *, into: str = "rule") -> DataFrame:
    """The first rule, by priority and then order, that holds and has a style: a chain of conditions, no shuffle."""
    name, style = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: -r.priority):
        if r.style is not None:
            name, style = F.when(_sure(r.predicate), F.lit(r.name)).otherwise(name), F.when(_sure(r.predicate), F.lit(r.style)).otherwise(style)
    return df.select(*df.columns, name.alias(into), style.alias(f"{into}_style"))


def last_graphic(hits: DataFrame, *, by: list[str], kind: str = "kind", priority: str = "priority", place: str = "place") -> DataFrame:
    """Of the graphics (colour scale, data bar, icon set) that hit a cell, one of each kind: that of the highest priority number, and of equal ones the last.

    ``by`` names the cell.  An aggregate with partial results on the map side:
    a cell's hits are never sorted, however many rules overlap.
    """
    rest = [c for c in hits.columns if c not in (*by, kind)]
    last = F.max_by(F.struct(*rest), F.struct(priority, place))
    return hits.groupBy(*by, kind).agg(last.alias("__last")).select(*by, kind, *[F.col("__last")[c].alias(c) for c in rest])


def bar_look(df: DataFrame, value: str, *, fill: str, negative: str | None = None, percent: str = "percent", into: str = "bar_colour") -> DataFrame:
    """The colour of a data bar: ``negative`` below zero where the rule gives one; null where there is no bar."""
    colour = F.when(F.col(value) < 0, F.lit(negative or fill)).otherwise(F.lit(fill))
    return df.withColumn(into, F.when(F.col(percent).isNotNull(), colour))


def with_extensions(rules: DataFrame, extensions: DataFrame, *, by: list[str], guid: str = "guid") -> DataFrame:
    """Data-bar rules with the settings that an extension of the same GUID adds; GUIDs compare without case and braces.

    The first of several extensions of one GUID counts (by its other columns);
    rules without a GUID or without an extension keep nulls there.
    """
    plain = lambda c: F.regexp_replace(F.upper(c), "[{}]", "")
    more = [c for c in extensions.columns if c not in (*by, guid)]
    keyed = extensions.where(F.col(guid).isNotNull()).groupBy(*by, plain(F.col(guid)).alias("__guid")).agg(F.min(F.struct(*more)).alias("__more"))
    joined = rules.withColumn("__guid", plain(F.col(guid))).join(keyed, [*by, "__guid"], "left")
    return joined.select(*[F.col(c) for c in rules.columns], *[F.col("__more")[c].alias(c) for c in more])


_ROW_KINDS = ("cellIs", "containsText", "notContainsText", "beginsWith", "endsWith", "containsBlanks", "notContainsBlanks", "containsErrors", "notContainsErrors")


def holding(hits: DataFrame, *, value: str = "value", kind: str = "kind", type: str = "type", operator: str = "operator", first: str = "first", second: str = "second", text: str = "text") -> Column:
    """Whether the rule that a row carries (columns ``type``, ``operator``, ``first``, ``second``, ``text``) holds for its cell.

    Cells meet rules by ``grid.in_ranges``; nothing of the rules goes through
    the driver.  Types that need the whole range have operators of their own;
    any other type, known or not, never holds.
    """
    v, low, high, op = F.col(value), F.col(first), F.col(second), F.col(operator)
    number = F.when(F.col(kind) == "boolean", (F.upper(v) == "TRUE").cast("double")).otherwise(parse_number(F.coalesce(v, F.lit(""))))
    a, b = low.try_cast("double"), high.try_cast("double")
    quoted = F.lower(F.regexp_replace(F.regexp_extract(low, r'^"(.*)"$', 1), '""', '"'))
    as_text = F.lower(F.coalesce(v, F.lit("")))
    numeric, inside = F.lit(False), number.between(a, b)
    for name, compare in _COMPARE.items():
        numeric = F.when(op == name, compare(number, a)).otherwise(numeric)
    numeric = F.when(op == "between", inside).when(op == "notBetween", ~inside).otherwise(numeric)
    literal = F.when(op == "equal", as_text == quoted).when(op == "notEqual", as_text != quoted)
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    empty = blank(v) | (F.col(kind) == "empty")
    tests = (
        F.when(low.startswith('"'), literal).otherwise(numeric), (t != "") & F.contains(as_text, t), (t == "") | ~F.contains(as_text, t), (t != "") & F.startswith(as_text, t),
        (t != "") & F.endswith(as_text, t), empty, ~empty, F.col(kind) == "error", F.coalesce(F.col(kind) != "error", F.lit(True)),
    )
    holds = F.lit(False)
    for name, test in zip(_ROW_KINDS, tests, strict=True):
        holds = F.when(F.col(type) == name, test).otherwise(holds)
    return _sure(holds)


def holding_in_range(
    hits: DataFrame, *, by: list[str], value: str = "value", type: str = "type", rank: str = "rank", percent: str = "percent", bottom: str = "bottom",
    below: str = "below", equal: str = "equal", deviations: str = "deviations", into: str = "holds",
) -> DataFrame:
    """``hits`` with whether the rule that a row carries holds for its cell, for the types that need all cells of the range.

    A row is a cell beside a rule whose range it is in; ``by`` names the rule.
    top10 has ``rank``, ``percent`` and ``bottom``; aboveAverage ``below``,
    ``equal`` and ``deviations`` (null: none); duplicateValues and uniqueValues
    nothing more.  Rules stay rows: all ranges are counted, averaged and put in
    order together.  Texts that spell numbers count as such for top10 and
    aboveAverage, others not at all.  Any other type never holds.
    """
    kind, number = dict(hits.dtypes)[value], F.col(value)
    number = F.when(F.trim(number) != "", parse_number(number)) if kind == "string" else number.cast("double")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    numbered = hits.withColumn("__number", number)
    rules = numbered.groupBy(*by).agg(F.count("__number").alias("__count"), F.avg("__number").alias("__mean"), F.stddev_pop("__number").alias("__spread"), F.first(F.struct(type, rank, percent, bottom)).alias("__rule"))
    k = F.when(F.col(f"__rule.{percent}"), F.greatest(F.lit(1.0), F.ceil(F.col("__count") * F.col(f"__rule.{rank}") / 100))).otherwise(F.least(F.col(f"__rule.{rank}").cast("double"), F.col("__count").cast("double")))
    place = F.when(F.coalesce(F.col(f"__rule.{bottom}"), F.lit(False)), k).otherwise(F.col("__count") - k + 1)
    ordered = rules.where((F.col(f"__rule.{type}") == "top10") & (F.col("__count") > 0)).select(*by, place.cast("long").alias("__place"))
    # Only ranges of such rules are put in order.
    limits = _statistics(numbered.join(ordered.select(*by), by, "left_semi"), ordered, by=by, value="__number", place="__place", into="__limit").drop("__place")
    same = numbered.where(F.col(type).isin("duplicateValues", "uniqueValues") & F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__same"))
    joined = numbered.join(rules.select(*by, "__mean", "__spread"), by, "left").join(limits, by, "left").join(same, [*by, value], "left")
    v, t = F.col("__number"), F.col(type)
    average = F.col("__mean") + F.coalesce(F.col(deviations).cast("double") * F.col("__spread"), F.lit(0.0))
    above = F.when(on(below), F.when(on(equal), v <= average).otherwise(v < average)).otherwise(F.when(on(equal), v >= average).otherwise(v > average))
    holds = (
        F.when(t == "top10", F.when(on(bottom), v <= F.col("__limit")).otherwise(v >= F.col("__limit"))).when(t == "aboveAverage", above)
        .when(t == "duplicateValues", F.col("__same") > 1).when(t == "uniqueValues", F.col("__same") == 1)
    )
    return joined.select(*[F.col(f"`{c}`") for c in hits.columns], _sure(holds).alias(into))


def banded(number: Column, every: int, remainder: int) -> Column:
    """MOD(ROW(), every) = remainder, or of COLUMN()."""
    return number % every == remainder
