"""Cell values as columns: numbers, texts, booleans, and errors beside them.

A ``Value`` pairs a column with a column that holds an error code where the
value has none.  Formulas that cannot fail carry no error column at all, so
typed tables pay nothing for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The error codes of spreadsheets.
ERRORS = ("#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#NULL!")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


@dataclass(frozen=True)
class Value:
    """kind is 'number', 'text' or 'boolean'; ``error`` is null where the value stands."""

    column: Column
    kind: str
    error: Column | None = None

    def plain(self) -> Column:
        """The value, null where there is an error."""
        return self.column if self.error is None else F.when(self.error.isNull(), self.column)

    def shown(self) -> Column:
        """As text: the error code where there is one."""
        text = as_text(self).column
        return text if self.error is None else F.coalesce(self.error, text)


def first_error(*values: Value | Column | None) -> Column | None:
    """The leftmost error of the operands."""
    found = [v.error if isinstance(v, Value) else v for v in values]
    found = [e for e in found if e is not None]
    return F.coalesce(*found) if found else None


def number(c: Column | float) -> Value:
    return Value(c.cast("double") if isinstance(c, Column) else F.lit(float(c)), "number")


def text(c: Column | str) -> Value:
    return Value(c if isinstance(c, Column) else F.lit(c), "text")


def boolean(c: Column | bool) -> Value:
    return Value(c if isinstance(c, Column) else F.lit(c), "boolean")


def parse_number(c: Column) -> Column:
    """The number a text spells, null if none: blank is 0, and ``1d``, ``inf`` and ``NaN`` spell nothing."""
    t = F.trim(c)
    return F.when(t == "", F.lit(0.0)).when(t.rlike(NUMBER), t.try_cast("double"))


def number_text(c: Column) -> Column:
    """A number as text: to 15 significant digits, with an exponent from 1e21 on and below 1e-6 only."""
    short = F.format_string("%.14e", c).cast("double")
    plain = F.regexp_replace(short.cast("decimal(38,21)").cast("string"), r"\.?0+$", "")
    mantissa, exponent = F.substring_index(short.cast("string"), "E", 1), F.substring_index(short.cast("string"), "E", -1)
    scientific = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.when(exponent.startswith("-"), F.lit("e")).otherwise(F.lit("e+")), exponent)
    far = (F.abs(short) >= 1e21) | ((F.abs(short) < 1e-6) & (short != 0))
    small_whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(small_whole, c.cast("bigint").cast("string")).when(far, scientific).when(F.abs(short) >= 1e15, short.cast("decimal(38,0)").cast("string")).otherwise(plain)


def as_number(v: Value) -> Value:
    """Null is 0, a boolean 1 or 0, a text what it spells, else #VALUE!."""
    if v.kind == "number":
        return Value(F.coalesce(v.column, F.lit(0.0)), "number", v.error)
    if v.kind == "boolean":
        return Value(F.coalesce(v.column.cast("double"), F.lit(0.0)), "number", v.error)
    parsed = F.coalesce(parse_number(v.column), F.when(v.column.isNull(), F.lit(0.0)))
    return Value(parsed, "number", first_error(v, F.when(parsed.isNull(), F.lit("#VALUE!"))))


def as_text(v: Value) -> Value:
    """Null is the empty text, a boolean TRUE or FALSE."""
    if v.kind == "number":
        c = number_text(v.column)
    elif v.kind == "boolean":
        c = F.when(v.column, F.lit("TRUE")).when(~v.column, F.lit("FALSE"))
    else:
        c = v.column
    return Value(F.coalesce(c, F.lit("")), "text", v.error)


def as_boolean(v: Value) -> Value:
    """Null is FALSE, a number whether it is not 0; of texts only TRUE and FALSE."""
    if v.kind == "boolean":
        return Value(F.coalesce(v.column, F.lit(False)), "boolean", v.error)
    if v.kind == "number":
        return Value(F.coalesce(v.column != 0, F.lit(False)), "boolean", v.error)
    upper = F.upper(F.coalesce(v.column, F.lit("FALSE")))
    known = F.when(upper == "TRUE", F.lit(True)).when((upper == "FALSE") | (upper == ""), F.lit(False))
    return Value(known, "boolean", first_error(v, F.when(known.isNull(), F.lit("#VALUE!"))))
