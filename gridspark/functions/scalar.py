"""Operators and scalar functions of formulas, as columns with errors as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.values import Value, as_boolean, as_number, as_text, boolean, first_error


def _numeric(c: Column, *operands: Value, error: Column | None = None) -> Value:
    return Value(c, "number", first_error(*operands, error))


def _code(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))


def arithmetic(op: str, left: Value, right: Value) -> Value:
    """+ - * / ^ on numbers; the left operand's error comes first."""
    a, b = as_number(left), as_number(right)
    x, y = a.column, b.column
    if op == "+":
        return _numeric(x + y, a, b)
    if op == "-":
        return _numeric(x - y, a, b)
    if op == "*":
        return _numeric(x * y, a, b)
    if op == "/":
        return _numeric(F.try_divide(x, y), a, b, error=_code(y == 0, "#DIV/0!"))
    if op == "^":
        return power(a, b)
    raise ValueError(op)


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def power(base: Value, exponent: Value) -> Value:
    a, b = as_number(base), as_number(exponent)
    out = F.pow(a.column, b.column)
    return _numeric(F.when(finite(out), out), a, b, error=_code(~finite(out), "#NUM!"))


def percent(v: Value) -> Value:
    a = as_number(v)
    return _numeric(a.column / 100, a)


def negative(v: Value) -> Value:
    a = as_number(v)
    return _numeric(-a.column, a)


def joined(*values: Value) -> Value:
    """& and CONCATENATE: nulls are empty."""
    texts = [as_text(v) for v in values]
    return Value(F.concat(*[t.column for t in texts]), "text", first_error(*texts))


_RANK = {"number": 0, "text": 1, "boolean": 2}
_OPS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _zero(v: Value) -> Column:
    empty = {"number": F.lit(0.0), "text": F.lit(""), "boolean": F.lit(False)}[v.kind]
    return F.coalesce(v.column, empty)


def compare(op: str, left: Value, right: Value) -> Value:
    """Numbers come before texts before booleans; texts compare without case; null is the number 0."""
    e = first_error(left, right)
    if left.kind == right.kind:
        fold = F.lower if left.kind == "text" else lambda c: c
        null_l, null_r = left.column.isNull(), right.column.isNull()
        same = _OPS[op](fold(_zero(left)), fold(_zero(right)))
        if left.kind == "number":
            return Value(same, "boolean", e)
        # A null is the number 0, which ranks below any text or boolean.
        ranked = _OPS[op](F.when(null_l, F.lit(0)).otherwise(F.lit(1)), F.when(null_r, F.lit(0)).otherwise(F.lit(1)))
        return Value(F.when(null_l | null_r, ranked).otherwise(same), "boolean", e)
    rank = lambda v: F.when(v.column.isNull(), F.lit(0)).otherwise(F.lit(_RANK[v.kind]))
    both_null = left.column.isNull() & right.column.isNull()
    numeric = lambda v: F.when(v.column.isNull(), F.lit(0.0)) if v.kind != "number" else _zero(v)
    return Value(F.when(both_null, _OPS[op](F.lit(0), F.lit(0))).when(rank(left) == rank(right), _OPS[op](numeric(left), numeric(right))).otherwise(_OPS[op](rank(left), rank(right))), "boolean", e)


def equal_values(left: Value, right: Value) -> Column:
    """The looser equality of lookups and SWITCH: null, 0 and '' are one, and a number equals the text that spells it."""
    if left.kind == right.kind == "text":
        return F.lower(F.coalesce(left.column, F.lit(""))) == F.lower(F.coalesce(right.column, F.lit("")))
    if left.kind == right.kind:
        return _zero(left) == _zero(right)
    if "boolean" in (left.kind, right.kind):
        return F.lit(False)
    return F.coalesce(as_number(left).column == as_number(right).column, F.lit(False))


def choose(condition: Value, then: Value, otherwise: Value | None = None) -> Value:
    """IF: only the chosen branch's error counts."""
    c, other = as_boolean(condition), otherwise if otherwise is not None else boolean(False)
    if then.kind != other.kind:
        then, other = as_text(then), as_text(other)
    branch = F.when(c.column, then.error if then.error is not None else F.lit(None)).otherwise(other.error if other.error is not None else F.lit(None)).cast("string")
    error = None if c.error is None and then.error is None and other.error is None else first_error(c, branch)
    return Value(F.when(c.column, then.column).otherwise(other.column), then.kind, error)


def _same_kind(values: list[Value]) -> list[Value]:
    """Results of one kind; mixed kinds become texts."""
    return values if len({v.kind for v in values}) == 1 else [as_text(v) for v in values]


def _error_of(v: Value) -> Column:
    return (v.error if v.error is not None else F.lit(None)).cast("string")


def _first_hit(tests: list[tuple[Column, Column]], results: list[Value], rest: Value) -> Value:
    """The result of the first test (hit, error) that hits; an error of a test before it, or of the result, is the outcome."""
    *results, rest = _same_kind([*results, rest])
    out, error = rest.column, _error_of(rest)
    for (hit, bad), then in reversed(list(zip(tests, results, strict=True))):
        out = F.when(hit, then.column).otherwise(out)
        error = F.when(bad.isNotNull(), bad).when(hit, _error_of(then)).otherwise(error)
    return Value(out, rest.kind, error)


def _no_match(like: Value) -> Value:
    return Value(F.lit(None).cast({"number": "double", "text": "string", "boolean": "boolean"}[like.kind]), like.kind, F.lit("#N/A"))


def first_true(pairs: list[tuple[Value, Value]]) -> Value:
    """IFS: #N/A where no condition holds; what follows the first that does is not looked at."""
    if not pairs:
        raise ValueError("IFS needs a condition")
    tests = [(F.coalesce(c.column, F.lit(False)), _error_of(c)) for c in (as_boolean(c) for c, _ in pairs)]
    return _first_hit(tests, [then for _, then in pairs], _no_match(pairs[0][1]))


def switch(v: Value, cases: list[tuple[Value, Value]], default: Value | None = None) -> Value:
    """SWITCH: the first equal case; the default, or #N/A."""
    if not cases:
        raise ValueError("SWITCH needs a case")
    found = _first_hit([(equal_values(v, case), _error_of(case)) for case, _ in cases], [then for _, then in cases], default if default is not None else _no_match(cases[0][1]))
    return Value(found.column, found.kind, first_error(v, found))


def if_error(v: Value, fallback: Value, only: str | None = None) -> Value:
    """IFERROR; with ``only='#N/A'`` IFNA.  Texts that start with # are errors."""
    if v.error is None and v.kind != "text":
        return v
    bad = F.lit(False) if v.error is None else (v.error.isNotNull() if only is None else F.coalesce(v.error == only, F.lit(False)))
    if v.kind == "text" and only is None:
        bad = bad | F.coalesce(v.column.startswith("#"), F.lit(False))
    fallback = fallback if fallback.kind == v.kind else (as_text(fallback) if v.kind == "text" else as_number(fallback))
    rest = None if only is None or v.error is None else F.when(~bad, v.error)
    return Value(F.when(bad, fallback.column).otherwise(v.column), v.kind, first_error(rest, fallback) if only else fallback.error)


def negate(v: Value) -> Value:
    b = as_boolean(v)
    return Value(~b.column, "boolean", b.error)


def all_of(*values: Value) -> Value:
    """AND; FALSE of nothing."""
    out = [as_boolean(v) for v in values] or [boolean(False)]
    c = out[0].column
    for b in out[1:]:
        c = c & b.column
    return Value(c, "boolean", first_error(*out))


def any_of(*values: Value) -> Value:
    """OR; #VALUE! of nothing."""
    out = [as_boolean(v) for v in values] or [Value(F.lit(None).cast("boolean"), "boolean", F.lit("#VALUE!"))]
    c = out[0].column
    for b in out[1:]:
        c = c | b.column
    return Value(c, "boolean", first_error(*out))


def _down(x: Column) -> Column:
    """The floor as a double; numbers of 2**53 and more are whole already, and Spark's floor ends at a long's bounds."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _up(x: Column) -> Column:
    return -_down(-x)


def _scaled(x: Value, digits: Value) -> tuple[Value, Value, Column]:
    a, d = as_number(x), as_number(digits)
    return a, d, F.pow(F.lit(10.0), F.floor(d.column))


def round_half_up(x: Value, digits: Value) -> Value:
    """ROUND: halves go up, on the binary product, so that -2.5 gives -2 and 1.005 to two digits 1."""
    a, d, f = _scaled(x, digits)
    return _numeric(_down(a.column * f + 0.5) / f, a, d)


def round_away(x: Value, digits: Value) -> Value:
    a, d, f = _scaled(x, digits)
    s = a.column * f
    return _numeric(F.when(a.column >= 0, _up(s)).otherwise(_down(s)) / f, a, d)


def round_to_zero(x: Value, digits: Value) -> Value:
    a, d, f = _scaled(x, digits)
    s = a.column * f
    return _numeric(F.when(a.column >= 0, _down(s)).otherwise(_up(s)) / f, a, d)


def absolute(v: Value) -> Value:
    a = as_number(v)
    return _numeric(F.abs(a.column), a)


def square_root(v: Value) -> Value:
    a = as_number(v)
    return _numeric(F.when(a.column >= 0, F.sqrt(a.column)), a, error=_code(a.column < 0, "#NUM!"))


def modulo(n: Value, d: Value) -> Value:
    """MOD: takes the divisor's sign."""
    a, b = as_number(n), as_number(d)
    q = _down(F.try_divide(a.column, b.column))
    return _numeric(a.column - q * b.column, a, b, error=_code(b.column == 0, "#DIV/0!"))


def integer(v: Value) -> Value:
    a = as_number(v)
    return _numeric(_down(a.column), a)


def left(s: Value, count: Value) -> Value:
    t, n = as_text(s), as_number(count)
    return Value(F.when(n.column >= 0, F.substring(t.column, F.lit(1), F.floor(n.column).cast("int"))), "text", first_error(t, n, _code(n.column < 0, "#VALUE!")))


def right(s: Value, count: Value) -> Value:
    t, n = as_text(s), as_number(count)
    k = F.floor(n.column).cast("int")
    start = F.greatest(F.length(t.column) - k + 1, F.lit(1))
    return Value(F.when(k <= 0, F.lit("")).otherwise(F.substring(t.column, start, k)), "text", first_error(t, n, _code(n.column < 0, "#VALUE!")))


def middle(s: Value, start: Value, count: Value) -> Value:
    t, a, n = as_text(s), as_number(start), as_number(count)
    bad = (a.column < 1) | (n.column < 0)
    return Value(F.when(~bad, F.substring(t.column, F.floor(a.column).cast("int"), F.floor(n.column).cast("int"))), "text", first_error(t, a, n, _code(bad, "#VALUE!")))


def length(s: Value) -> Value:
    t = as_text(s)
    return _numeric(F.length(t.column).cast("double"), t)


def trim(s: Value) -> Value:
    t = as_text(s)
    return Value(F.trim(F.regexp_replace(t.column, " +", " ")), "text", t.error)


def upper(s: Value) -> Value:
    t = as_text(s)
    return Value(F.upper(t.column), "text", t.error)


def lower(s: Value) -> Value:
    t = as_text(s)
    return Value(F.lower(t.column), "text", t.error)
