"""Expressions of conditional-format rules as predicates over the cell that is tested.

A rule's formula is relocated to every cell of its range, so that whatever
reference it writes means the cell itself.  Forms that rules don't know are
false and never fail: a rule that can't be read formats nothing.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.values import parse_number
from gridspark.plans.formula import _TOKENS

_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Cell:
    """The tested cell: text, kind (number, string, inlineStr, boolean, error, empty), row and column from 1."""

    value: Column
    kind: Column
    row: Column
    column: Column

    @property
    def text(self) -> Column:
        return F.coalesce(self.value, F.lit(""))

    @property
    def number(self) -> Column:
        """What the cell counts as: TRUE 1, FALSE 0, an empty text 0, null for texts that spell no number."""
        flag = F.when(self.text == "TRUE", F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(self.kind == "boolean", flag).otherwise(parse_number(self.text))

    @property
    def blank(self) -> Column:
        return F.coalesce(self.kind == "empty", F.lit(True)) | (self.text == "")


# Trees are tuples: ("call", name, trees), ("compare", op, tree, tree), ("ref",), ("num", float), ("str", text).
Tree = tuple


class _Unread(ValueError):
    pass


def _tree(source: str) -> Tree:
    tokens, at, body = [], 0, source.strip().removeprefix("=")
    while body[at:].strip():
        m = _TOKENS.match(body, at)
        if not m:
            raise _Unread
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.reverse()

    def next_is(op: str) -> bool:
        return bool(tokens) and tokens[-1] == ("op", op)

    def one() -> Tree:
        if not tokens:
            raise _Unread
        kind, token = tokens.pop()
        if kind == "num":
            return "num", float(token)
        if kind == "str":
            return "str", token[1:-1].replace('""', '"')
        if kind == "op" and token in "+-" and tokens and tokens[-1][0] == "num":
            return "num", float(token + tokens.pop()[1])
        if kind == "ref" and token.strip("$")[-1].isdigit() and ":" not in token:
            return ("ref",)
        if kind in ("word", "ref") and next_is("("):
            tokens.pop()
            inside = []
            while not next_is(")"):
                inside.append(whole())
                if next_is(","):
                    tokens.pop()
                elif not next_is(")"):
                    raise _Unread
            tokens.pop()
            return "call", token.upper(), inside
        raise _Unread

    def whole() -> Tree:
        left = one()
        if tokens and tokens[-1][0] == "op" and tokens[-1][1] in _COMPARE:
            return "compare", tokens.pop()[1], left, one()
        return left

    tree = whole()
    if tokens:
        raise _Unread
    return tree


def _holds(tree: Tree, cell: Cell) -> Column:
    axis = {"ROW": cell.row, "COLUMN": cell.column}
    match tree:
        case ("call", "AND" | "OR" as name, [_, *_] as parts):
            return reduce(operator.and_ if name == "AND" else operator.or_, [_holds(p, cell) for p in parts])
        case ("call", "NOT", [part]):
            return ~F.coalesce(_holds(part, cell), F.lit(False))
        case ("call", "ISEVEN" | "ISODD" as name, [("call", "ROW" | "COLUMN" as of, [])]):
            return axis[of] % 2 == int(name == "ISODD")
        case ("call", "ISEVEN" | "ISODD" as name, [("ref",)]):
            # The fraction is left out, and the sign makes no difference.
            return F.floor(F.abs(cell.number)) % 2 == int(name == "ISODD")
        case ("call", "ISNUMBER", [("ref",)]):
            return cell.kind.isin("number", "boolean")
        case ("call", "ISBLANK", [("ref",)]):
            return cell.blank
        case ("call", "ISERROR", [("ref",)]):
            return cell.kind == "error"
        case ("call", "ISNUMBER", [("call", "SEARCH", [_, *_]) as search]):
            return _holds(search, cell)
        case ("call", "SEARCH", [("str", text), ("ref",), *_]):
            return F.contains(F.lower(cell.text), F.lit(text.lower()))
        case ("compare", op, ("call", "SEARCH", [("str", _), ("ref",), *_]) as search, ("num", least)):
            # A place that is found counts as found, whichever it is.
            found = {">": least >= 0, ">=": least >= 0, "=": least >= 1}
            return ~_holds(search, cell) if op == "<>" else _holds(search, cell) & F.lit(found.get(op, False))
        case ("compare", "=" | "<>" as op, ("call", "MOD", [("call", "ROW" | "COLUMN" as of, []), ("num", every)]), ("num", rest)) if every:
            # For a negative divisor, the remainder is that of its size shifted as the divisor says.
            left = F.pmod(axis[of], F.lit(int(abs(every)))) if every > 0 else (axis[of] % int(every) + int(every)) % int(every)
            return _COMPARE[op](left, F.lit(rest))
        case ("compare", "=" | "<>" as op, ("call", "LEFT" | "RIGHT" as side, [("ref",), *more]), ("str", text)) if not more or (len(more) == 1 and more[0][0] == "num" and more[0][1] >= 0):
            n = F.lit(int(more[0][1]) if more else 1)
            return _COMPARE[op]((F.left if side == "LEFT" else F.right)(cell.text, n), F.lit(text))
        case ("compare", op, ("ref",), ("num", literal)):
            return _COMPARE[op](cell.number, F.lit(literal))
    return F.lit(False)


def rule_expression(source: str, cell: Cell) -> Column:
    """Whether the rule's formula holds for the cell, never null; false where the formula has no form that rules know."""
    try:
        tree = _tree(source)
    except _Unread:
        return F.lit(False)
    return F.coalesce(_holds(tree, cell), F.lit(False))
