"""Aggregate functions of formulas as Spark aggregates: usable in ``agg`` and ``over``.

Each takes the values of a range as columns (one or several) and works with
partial aggregation.  Ranges count numbers, texts that spell one, and booleans;
nulls and other texts are passed over; an error in the range is the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.criteria import criteria
from gridspark.functions.values import Value, parse_number


def numeric(v: Value) -> Column:
    """What a value counts as in a range, null if nothing."""
    if v.kind == "number":
        return v.plain()
    if v.kind == "boolean":
        return v.plain().cast("double")
    c = v.plain()
    return F.when(c != "", parse_number(c))


def _error(*values: Value) -> Column | None:
    # The smallest code of each column: which row holds it does not matter.
    found = [F.min(v.error) for v in values if v.error is not None]
    return F.coalesce(*found) if found else None


def total(*values: Value) -> Value:
    """SUM; 0 of nothing."""
    return Value(reduce(lambda a, b: a + b, [F.coalesce(F.sum(numeric(v)), F.lit(0.0)) for v in values], F.lit(0.0)), "number", _error(*values))


def average(*values: Value) -> Value:
    """AVERAGE; #DIV/0! of nothing."""
    n = reduce(lambda a, b: a + b, [F.count(numeric(v)) for v in values])
    e = F.when(n == 0, F.lit("#DIV/0!"))
    inner = _error(*values)
    return Value(F.try_divide(total(*values).column, n), "number", e if inner is None else F.coalesce(inner, e))


def least(*values: Value) -> Value:
    """MIN; 0 of nothing."""
    found = [F.min(numeric(v)) for v in values]
    return Value(F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.lit(0.0)), "number", _error(*values))


def greatest(*values: Value) -> Value:
    """MAX; 0 of nothing."""
    found = [F.max(numeric(v)) for v in values]
    return Value(F.coalesce(F.greatest(*found) if len(found) > 1 else found[0], F.lit(0.0)), "number", _error(*values))


def count(*values: Value) -> Value:
    """COUNT: numbers only; a range with an error counts nothing."""
    each = []
    for v in values:
        n = F.count(v.plain()) if v.kind == "number" else F.lit(0).cast("long")
        each.append(n if v.error is None else F.when(F.count(v.error) > 0, F.lit(0)).otherwise(n))
    return Value(reduce(lambda a, b: a + b, each), "number")


def count_all(*values: Value) -> Value:
    """COUNTA: whatever is not empty."""
    filled = lambda v: F.count_if(v.column.isNotNull() & (v.column != "")) if v.kind == "text" else F.count(v.column)
    each = [filled(v) if v.error is None else F.when(F.count(v.error) > 0, F.lit(1)).otherwise(filled(v)) for v in values]
    return Value(reduce(lambda a, b: a + b, each), "number")


def _meets(tested: Value, criterion, inside: Column | None) -> Column:
    """Rows outside the range don't count, whatever a criterion says of nulls."""
    met = criteria(tested, criterion)
    return met if inside is None else met & F.coalesce(inside, F.lit(False))


def sum_if(tested: Value, criterion, summed: Value | None = None, inside: Column | None = None) -> Value:
    """SUMIF: what stands beside values that meet the criterion; of a range of rows those ``inside``."""
    met = _meets(tested, criterion, inside)
    return Value(F.coalesce(F.sum(F.when(met, numeric(summed or tested))), F.lit(0.0)), "number", _error(*([summed] if summed else [])))


def count_if(tested: Value, criterion, inside: Column | None = None) -> Value:
    """COUNTIF."""
    return Value(F.count_if(_meets(tested, criterion, inside)), "number")


def every(v: Value) -> Value:
    """AND over a range: nulls are passed over; FALSE of nothing."""
    return Value(F.coalesce(F.bool_and(_truth(v)), F.lit(False)), "boolean", _error(v))


def some(v: Value) -> Value:
    """OR over a range: #VALUE! of nothing."""
    found = F.bool_or(_truth(v))
    return Value(found, "boolean", F.coalesce(*[e for e in (_error(v), F.when(found.isNull(), F.lit("#VALUE!"))) if e is not None]))


def _truth(v: Value) -> Column:
    c = v.plain()
    return c if v.kind == "boolean" else c != 0 if v.kind == "number" else F.when(F.upper(c) == "TRUE", F.lit(True)).when(F.upper(c) == "FALSE", F.lit(False))


def joined(v: Value, *order: Column) -> Value:
    """CONCATENATE over a range, in the order given."""
    from gridspark.functions.values import as_text

    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], as_text(v).column.alias("v"))))
    return Value(F.array_join(F.transform(rows, lambda r: r["v"]), ""), "text", _error(v))
