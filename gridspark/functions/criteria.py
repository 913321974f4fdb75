"""Criteria of SUMIF and COUNTIF (``">=25"``, ``"<>R"``, a number, ...) as predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.values import NUMBER, Value, parse_number

#: Comparisons a criterion may begin with; the longest that fits is read.
COMPARISONS = {
    "<>": lambda a, b: a != b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "=": lambda a, b: a == b,
}


def criteria(v: Value, criterion: str | float | bool | None) -> Column:
    """Whether each value meets the criterion; never null.

    A number compares with numbers and with texts that spell one; of other
    values only ``<>`` is true.  A text compares without case; a number never
    equals one.  There are no wildcards.
    """
    if criterion is None:
        meets = v.column.isNull() if v.kind == "boolean" else v.column.isNull() | (v.column == {"text": "", "number": 0.0}[v.kind])
    elif isinstance(criterion, str):
        meets = _TEXTS[v.kind](v.column, *_read(criterion))
    else:
        meets = _SAME.get((v.kind, "boolean" if isinstance(criterion, bool) else "number"), _never)(v.column, F.lit(criterion))
    return F.coalesce(meets, F.lit(False))


def _never(cell: Column, wanted: Column) -> Column:
    return F.lit(False)


#: By kind of cell and of a criterion that is no text.
_SAME = {
    ("number", "number"): lambda cell, wanted: cell == wanted,
    ("text", "number"): lambda cell, wanted: _spelt(cell) == wanted,
    ("boolean", "boolean"): lambda cell, wanted: cell == wanted,
}


def _spelt(cell: Column) -> Column:
    return F.when(cell != "", parse_number(cell))


def _read(criterion: str) -> tuple[str, str, float | None]:
    """(comparison, operand, the number that the operand spells) of a criterion's text."""
    bare = criterion.lstrip()
    sign = next((o for o in COMPARISONS if bare.startswith(o)), "")
    operand = bare[len(sign) :].lstrip() if sign else criterion
    spelt = operand.strip() or "0"
    return sign or "=", operand, float(spelt) if operand and re.search(NUMBER, spelt) else None


def _rule(as_number, as_text):
    """How cells of a kind meet a text: by numbers where the text spells one, else by texts; nulls meet an empty operand."""

    def meets(cell: Column, sign: str, operand: str, wanted: float | None) -> Column:
        unlike, test = F.lit(sign == "<>"), COMPARISONS[sign]
        if wanted is not None:
            return F.coalesce(test(as_number(cell), F.lit(wanted)), unlike)
        by_text = unlike if as_text is None else test(F.lower(as_text(cell)), F.lit(operand.lower()))
        return F.when(cell.isNull(), F.lit(operand == "" and sign in ("=", "<=", ">="))).otherwise(by_text)

    return meets


_TEXTS = {
    "number": _rule(lambda c: c, None),
    "text": _rule(_spelt, lambda c: c),
    "boolean": _rule(lambda c: F.lit(None).cast("double"), lambda c: c.cast("string")),
}
