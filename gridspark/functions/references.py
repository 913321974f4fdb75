"""Cell references: letters and numbers, A1 and R1C1, ranges; on the driver and as columns."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Range(NamedTuple):
    """An inclusive rectangle, 0-based."""

    col: int
    row: int
    end_col: int
    end_row: int


def column_index(letters: str) -> int:
    out = 0
    for c in letters.upper():
        out = out * 26 + ord(c) - 64
    return out - 1


def column_letters(index: int) -> str:
    out, n = "", index + 1
    while n:
        n, digit = divmod(n - 1, 26)
        out = chr(65 + digit) + out
    return out


def parse_range(text: str) -> Range | None:
    """``B2:D5`` or ``B2``, corners in any order, dollar signs ignored; None if it is neither."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?", text.strip())
    if not m:
        return None
    cols = [column_index(m[1]), column_index(m[3] or m[1])]
    rows = [int(m[2]) - 1, int(m[4] or m[2]) - 1]
    return Range(min(cols), min(rows), max(cols), max(rows))


def parse_ranges(text: str) -> list[Range]:
    return [r for part in text.split() if (r := parse_range(part))]


def letters_column(index: Column) -> Column:
    """Letters of a 0-based column number, up to three."""
    letter = lambda c: F.chr(F.lit(65) + c)
    one, two, three = index, index - 26, index - 702
    return (
        F.when(index < 26, letter(one % 26))
        .when(index < 702, F.concat(letter(F.floor(two / 26) % 26), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676) % 26), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def index_column(letters: Column) -> Column:
    """The 0-based number of a column's letters."""
    codes = F.transform(F.split(F.upper(letters), ""), F.ascii)
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), lambda a, c: a * 26 + c - 64) - 1


_A1 = re.compile(r"(?<![A-Za-z0-9_])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])")


def _axis(name: str, letter: str) -> str:
    """R or C, and how far from the anchor (in brackets) or which (bare) it is; the anchor's own if neither."""
    return rf"{letter}(?:\[(?P<{name}_by>-?\d+)\]|(?P<{name}_at>\d+))?"


_R1C1 = re.compile(rf"\b{_axis('row', 'R')}{_axis('col', 'C')}(?![\w(\[])", re.A)


def a1_to_r1c1(formula: str, row: int, col: int) -> str:
    """Rewrites references relative to the 0-based anchor."""

    def moved(m: re.Match) -> str:
        r, c = int(m[4]) - 1, column_index(m[2])
        return f"R{r + 1 if m[3] else f'[{r - row}]'}C{c + 1 if m[1] else f'[{c - col}]'}"

    return _A1.sub(moved, formula)


def r1c1_to_a1(formula: str, row: int, col: int) -> str:
    def axis(m: re.Match, name: str, anchor: int) -> tuple[str, int]:
        fixed = m[f"{name}_at"]
        return ("", anchor + int(m[f"{name}_by"] or 0)) if fixed is None else ("$", int(fixed) - 1)

    def moved(m: re.Match) -> str:
        (fixed_r, r), (fixed_c, c) = axis(m, "row", row), axis(m, "col", col)
        return m[0] if r < 0 or c < 0 else f"{fixed_c}{column_letters(c)}{fixed_r}{r + 1}"

    return _R1C1.sub(moved, formula)
