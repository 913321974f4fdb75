"""Formula texts as Spark expressions over the columns of a table.

``formula("=ROUND([price]*2,1)", schema)`` builds a ``Value`` from column
functions, so that Catalyst plans it like any other expression.  References
name columns: ``[name]``, or the letters of a column's place (``B`` or ``B2``:
the current row).  Whole columns (``B:B``, ``[name]`` inside an aggregate)
become Spark aggregates.  Several columns (``A:C``) count as one range.  Rows
of a range (``A2:B9``) and the first match of a VLOOKUP need ``row``, the column
with the row numbers from 1: without it they are #VALUE!.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import scalar as s
from gridspark.functions.references import column_index
from gridspark.functions.values import Value, boolean, first_error, number, text
from gridspark.operators import aggregates as a

_TOKENS = re.compile(
    r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"]|"")*")|(?P<err>\#(?:DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|NULL!))
    |(?P<name>\[[^\]]+\])|(?P<ref>\$?[A-Za-z]{1,3}(?:\$?\d+)?(?::\$?[A-Za-z]{1,3}(?:\$?\d+)?)?(?![A-Za-z0-9_(]))
    |(?P<word>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op><=|>=|<>|[-+*/^&=<>%(),]))""",
    re.X,
)
_KINDS = {"string": "text", "boolean": "boolean"}

#: Binary operators, loosest first; ^ groups to the right.
_LEVELS = (("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/"))

Build = Callable[..., Value]
SCALAR: dict[str, Build] = {
    "IF": s.choose, "NOT": s.negate, "IFERROR": s.if_error, "IFNA": lambda v, f: s.if_error(v, f, only="#N/A"),
    "IFS": lambda *x: s.first_true(list(zip(x[::2], x[1::2], strict=True))),
    "SWITCH": lambda v, *x: s.switch(v, list(zip(x[: len(x) // 2 * 2 : 2], x[1::2], strict=True)), x[-1] if len(x) % 2 else None),
    "ROUND": s.round_half_up, "ROUNDUP": s.round_away, "ROUNDDOWN": s.round_to_zero, "ABS": s.absolute, "SQRT": s.square_root, "POWER": s.power,
    "MOD": s.modulo, "INT": s.integer, "LEFT": lambda t, n=None: s.left(t, n or number(1)), "RIGHT": lambda t, n=None: s.right(t, n or number(1)),
    "MID": s.middle, "LEN": s.length, "TRIM": s.trim, "UPPER": s.upper, "LOWER": s.lower, "CONCATENATE": s.joined, "CONCAT": s.joined,
    "AND": s.all_of, "OR": s.any_of,
}
AGGREGATE: dict[str, Build] = {"SUM": a.total, "AVERAGE": a.average, "MIN": a.least, "MAX": a.greatest, "COUNT": a.count, "COUNTA": a.count_all}


class FormulaError(ValueError):
    """The text is no formula that this library knows."""


@dataclass(frozen=True)
class _Range:
    """The values of a range, a column each; which rows are in it, and its first row, where it doesn't have all."""

    columns: list[Value]
    inside: Column | None = None
    first: int = 1


def _failed(code: str) -> Value:
    return Value(F.lit(None).cast("double"), "number", F.lit(code))


class _Reader:
    def __init__(self, source: str, df: DataFrame, row: str | None = None) -> None:
        self.tokens: list[tuple[str, str]] = []
        body = source[1:] if source.startswith("=") else source
        at = 0
        while body[at:].strip():
            m = _TOKENS.match(body, at)
            if not m:
                raise FormulaError(f"unexpected {body[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.columns, self.kinds, self.row, self.session = 0, df.columns, dict(df.dtypes), row, df.sparkSession

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else ""

    def take(self, op: str) -> None:
        if self.peek() != op:
            raise FormulaError(f"{op} expected")
        self.at += 1

    def binary(self, level: int = 0) -> Value:
        if level == len(_LEVELS):
            return self.power()
        left = self.binary(level + 1)
        while (op := self.peek()) in _LEVELS[level]:
            self.at += 1
            right = self.binary(level + 1)
            left = s.compare(op, left, right) if level == 0 else s.joined(left, right) if op == "&" else s.arithmetic(op, left, right)
        return left

    def power(self) -> Value:
        base = self.unary()
        if self.peek() == "^":
            self.at += 1
            return s.arithmetic("^", base, self.power())
        return base

    def unary(self) -> Value:
        if self.peek() in ("-", "+"):
            sign = self.peek()
            self.at += 1
            v = self.unary()
            return s.negative(v) if sign == "-" else v
        v = self.primary()
        while self.peek() == "%":
            self.at += 1
            v = s.percent(v)
        return v

    def column(self, name: str) -> Value:
        if name not in self.kinds:
            return _failed("#REF!")
        kind = _KINDS.get(self.kinds[name], "number")
        c = F.col(f"`{name}`")
        return Value(c.cast("double") if kind == "number" else c, kind)

    def placed(self, place: int) -> Value:
        return self.column(self.columns[place] if place < len(self.columns) else "")

    def range(self) -> _Range | None:
        """A range, if one is next and is a whole argument."""
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        after = self.tokens[self.at + 1][1] if self.at + 1 < len(self.tokens) else ""
        if kind != "ref" or ":" not in token or after not in (",", ")"):
            return None
        self.at += 1
        ends = [re.fullmatch(r"\$?([A-Za-z]+)(?:\$?(\d+))?", end) for end in token.split(":")]
        places, rows = sorted(column_index(m[1]) for m in ends), [int(m[2]) for m in ends if m[2]]
        found = [self.placed(i) for i in range(places[0], places[1] + 1)]
        if not rows:
            return _Range(found)
        if len(rows) == 1 or self.row is None:
            raise FormulaError("rows of a range need the column of row numbers")
        inside = F.col(f"`{self.row}`").between(min(rows), max(rows))
        return _Range([Value(F.when(inside, v.column), v.kind, None if v.error is None else F.when(inside, v.error)) for v in found], inside, min(rows))

    def look_up(self, arguments: list, raw: list[tuple[str, str]]) -> Value:
        """VLOOKUP of a constant in a range: what stands in the first row whose first cell is equal."""
        if not 3 <= len(arguments) <= 4 or not isinstance(arguments[1], _Range) or self.row is None or raw[2][0] != "num" or (len(arguments) == 4 and raw[3][1].upper() not in ("TRUE", "1")):
            return _failed("#VALUE!")
        wanted, cells, index = arguments[0], arguments[1].columns, int(float(raw[2][1]))
        if not 1 <= index <= len(cells):
            return _failed("#VALUE!" if index < 1 else "#REF!")
        hit = F.when(s.equal_values(wanted, cells[0]) & cells[0].column.isNotNull(), F.col(f"`{self.row}`"))
        result = F.min_by(F.struct(cells[index - 1].column.alias("v"), (cells[index - 1].error if cells[index - 1].error is not None else F.lit(None)).cast("string").alias("e")), hit)
        missing = F.when(F.min(hit).isNull(), F.lit("#N/A"))
        return Value(result["v"], cells[index - 1].kind, F.coalesce(F.first(wanted.error, ignorenulls=True) if wanted.error is not None else F.lit(None), missing, result["e"]))

    def primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise FormulaError("unexpected end")
        kind, token = self.tokens[self.at]
        if token == "(":
            self.at += 1
            v = self.binary()
            self.take(")")
            return v
        self.at += 1
        if kind == "num":
            return number(float(token))
        if kind == "str":
            return text(token[1:-1].replace('""', '"'))
        if kind == "err":
            return Value(F.lit(None).cast("double"), "number", F.lit(token))
        if kind == "name":
            return self.column(token[1:-1])
        if token.upper() in ("TRUE", "FALSE") and self.peek() != "(":
            return boolean(token.upper() == "TRUE")
        if kind == "ref":
            if ":" in token:
                raise FormulaError("a range stands where a value is expected")
            return self.placed(column_index(re.match(r"\$?([A-Za-z]+)", token)[1]))
        if kind == "word" and self.peek() == "(":
            return self.call(token.upper())
        raise FormulaError(f"unexpected {token!r}")

    def call(self, name: str) -> Value:
        self.take("(")
        arguments, raw, spans = [], [], []
        while self.peek() != ")":
            raw.append(self.tokens[self.at])
            began = self.at
            some = self.range()
            arguments.append(self.binary() if some is None else some)
            spans.append(self.tokens[began : self.at])
            if self.peek() == ",":
                self.at += 1
        self.take(")")
        flat = [v for x in arguments for v in (x.columns if isinstance(x, _Range) else [x])]
        ranged = len(flat) != len(arguments) or any(isinstance(x, _Range) for x in arguments)
        if name == "VLOOKUP":
            return self.look_up(arguments, raw)
        if name in ("SUMIF", "COUNTIF"):
            return self.conditional(name, [x if isinstance(x, _Range) else _Range([x]) for x in arguments], spans)
        if ranged and name in ("AND", "OR"):
            each = [(a.every if name == "AND" else a.some)(v) for v in flat]
            return (s.all_of if name == "AND" else s.any_of)(*each)
        if ranged and name in ("CONCAT", "CONCATENATE") and len(flat) == 1 and self.row is not None:
            return a.joined(flat[0], F.col(f"`{self.row}`"))
        if ranged and name not in AGGREGATE:
            return _failed("#VALUE!")
        arguments = flat
        build = AGGREGATE.get(name) or SCALAR.get(name)
        if build is None:
            return _failed("#NAME?")
        try:
            return build(*arguments)
        except (TypeError, ValueError):
            return _failed("#VALUE!")

    def constant(self, v: Value, tokens: list[tuple[str, str]]) -> tuple[str | float | bool | None, str | None]:
        """(value, error) of an argument without references, computed on one local row: no job."""
        if any(kind in ("name", "ref") for kind, _ in tokens):
            return None, "#VALUE!"
        error = F.lit(None) if v.error is None else v.error
        return tuple(self.session.sql("SELECT * FROM VALUES (0) AS one(x)").select(v.plain(), error.cast("string")).first())

    def conditional(self, name: str, ranges: list[_Range], spans: list[list[tuple[str, str]]]) -> Value:
        """SUMIF and COUNTIF by a constant: ranges of several columns pair column by column.

        Rows pair by position, so that a summed range must start in the row
        that the tested one starts in: one row of the table has both values.
        """
        if not 2 <= len(ranges) <= (3 if name == "SUMIF" else 2) or len(ranges[1].columns) != 1:
            return _failed("#VALUE!")
        criterion, error = self.constant(ranges[1].columns[0], spans[1])
        if error is not None:
            return _failed(error)
        tested, summed = ranges[0], ranges[2] if len(ranges) == 3 else ranges[0]
        if tested.first != summed.first:
            return _failed("#VALUE!")
        parts = [a.count_if(v, criterion, tested.inside) if name == "COUNTIF" else a.sum_if(v, criterion, w, tested.inside) for v, w in zip(tested.columns, summed.columns, strict=False)]
        total = parts[0].column
        for part in parts[1:]:
            total = total + part.column
        return Value(total, "number", first_error(*parts))


def formula(source: str, df: DataFrame, *, row: str | None = None) -> Value:
    """The formula as a Value over ``df``'s columns; aggregates in it make it an aggregate expression.

    What is no formula gives #VALUE!, an unknown function #NAME?.
    """
    try:
        reader = _Reader(source, df, row)
        v = reader.binary()
        if reader.at < len(reader.tokens):
            raise FormulaError("something follows the formula")
    except FormulaError:
        return _failed("#VALUE!")
    return v


def with_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """``df`` with a column per formula, null on error, and its error code in ``name_error`` where it can fail."""
    made = {n: formula(f, df) for n, f in formulas.items()}
    return df.withColumns({k: c for n, v in made.items() for k, c in ((n, v.plain()), *([(f"{n}_error", v.error)] if v.error is not None else []))})


def aggregate_formulas(df: DataFrame, formulas: dict[str, str], by: list[str] | None = None, *, row: str | None = None, errors: bool = True) -> DataFrame:
    """One row per group with a column per aggregate formula, null on error, and its error code in ``name_error`` where it can fail."""
    made = {n: formula(f, df, row=row) for n, f in formulas.items()}
    columns = [c for n, v in made.items() for c in (v.plain().alias(n), *([v.error.alias(f"{n}_error")] if errors and v.error is not None else []))]
    return df.groupBy(*(by or [])).agg(*columns)
