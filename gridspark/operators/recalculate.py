"""Recalculation of sheets: formulas in cells, over the values that the sheet has.

Formulas that differ only in what they refer to and in their numbers have one
shape (filled-down formulas do), which is compiled once to a column expression.
What a formula refers to comes by joins: cells by their place, sums and counts
of ranges from a summed-area table, other ranges by stripes of rows.  All
formulas see the values from before the pass, as in a single pass over a sheet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import scalar as s
from gridspark.functions.values import ERRORS, Value, as_boolean, as_text, boolean, first_error, number_text, parse_number
from gridspark.operators.range_criteria import read_criterion
from gridspark.operators.rectangles import STRIPE, rectangle_sums
from gridspark.operators.stage import folder, partitions, written
from gridspark.plans import formula as reader

#: Shapes compiled into one plan; more are evaluated in as many further ones.
SHAPES = 40

#: In sheets of so many rows at most, COUNTIF and SUMIF compare the cells of each range; in larger ones, criteria are met once.
NEAR = 256
#: Rows of a block: sums run down within it, and from block to block.
BLOCK = 4096
#: Ranges of so many places at most meet their cells by place.
PLACES = 64

# Marks that stand for references and numbers in a shape.
_CELL, _AREA, _NUMBER = "\x01", "\x02", "\x03"
_UNQUOTED = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
_PLACE = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]*"
_AREA_RE = rf"(?<![A-Za-z0-9_.$]){_PLACE}\s*:\s*{_PLACE}(?![A-Za-z0-9_(.]){_UNQUOTED}"
_CELL_RE = rf"(?<![A-Za-z0-9_.$:]){_PLACE}(?![A-Za-z0-9_(.:]){_UNQUOTED}"
_NUMBER_RE = rf"(?<![A-Za-z0-9_.$#])(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z0-9_.(:]){_UNQUOTED}"

_KEY = ["sheet", "row", "col"]
_SUMS = ("SUM", "AVERAGE", "COUNT", "COUNTA")
_CALLS = ("SUMIF", "COUNTIF", "VLOOKUP")
_LAYERS = ["num", "n", "numbers", "filled", "bad"]

#: Sums of a summed-area table are differences of large ones: they are exact for numbers of so many ten-thousandths,
#: up to this sum over a sheet.  Other numbers are added up from the cells of their range.
UNIT = 10_000.0
EXACT = float(1 << 53)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written once, or kept in the session where there is no shared folder."""
    return written(df) if folder(df.sparkSession) else df.persist()


def typed(kind: Column, value: Column) -> Column:
    """A cell as struct(kind, num, txt, flag); kinds are empty, number, text, boolean and error."""
    plain = F.coalesce(value, F.lit(""))
    spelt = F.when(F.trim(plain) != "", parse_number(plain))
    code = reduce(lambda c, e: F.when(F.upper(plain).startswith(e[:4]), F.lit(e)).otherwise(c), reversed(ERRORS), F.lit("#VALUE!"))
    is_error = (kind == "error") | (kind.isin("string", "inlineStr", "text") & plain.startswith("#"))
    what = (
        F.when(is_error, "error").when(kind == "number", F.when(spelt.isNull(), "empty").otherwise("number"))
        .when(kind == "boolean", "boolean").when(kind.isin("string", "inlineStr", "text"), "text").otherwise("empty")
    )
    return F.struct(
        what.alias("kind"), F.when(what == "number", spelt).alias("num"),
        F.when(what == "error", code).when(what == "text", plain).alias("txt"),
        F.when(what == "boolean", F.upper(plain).isin("TRUE", "1")).alias("flag"),
    )


def _numeric(v: Column) -> Column:
    """What a cell of a range counts as, null if nothing."""
    return F.when(v["kind"] == "number", v["num"]).when(v["kind"] == "boolean", v["flag"].cast("double")).when((v["kind"] == "text") & (v["txt"] != ""), parse_number(v["txt"]))


def _truth(v: Column) -> Column:
    return F.when(v["kind"] == "boolean", v["flag"]).when(v["kind"] == "number", v["num"] != 0).when(F.upper(v["txt"]) == "TRUE", F.lit(True)).when(F.upper(v["txt"]) == "FALSE", F.lit(False))


def _shown(v: Column) -> Column:
    return F.when(v["kind"] == "number", number_text(v["num"])).when(v["kind"] == "boolean", F.when(v["flag"], "TRUE").otherwise("FALSE")).otherwise(F.coalesce(v["txt"], F.lit("")))


def _equal(a: Column, b: Column) -> Column:
    """The looser equality of lookups, between cells of any kinds."""
    number = lambda v: F.when(v["kind"] == "number", v["num"]).when(v["kind"] == "empty", F.lit(0.0)).when(v["kind"] == "text", parse_number(v["txt"]))
    texts = (a["kind"] == "text") & (b["kind"] == "text")
    flags = (a["kind"] == "boolean") | (b["kind"] == "boolean")
    both = F.when(texts, F.lower(a["txt"]) == F.lower(b["txt"])).when(flags, (a["kind"] == b["kind"]) & (a["flag"] == b["flag"])).otherwise(number(a) == number(b))
    return F.coalesce(both, F.lit(False))


def _criterion(c: Column) -> Column:
    """What a criterion that is a cell itself asks for, read once for all cells that it meets."""
    sign, operand, wanted = read_criterion(c["txt"])
    return F.struct(c["kind"].alias("kind"), c["num"].alias("num"), c["flag"].alias("flag"), sign.alias("sign"), F.lower(operand).alias("operand"), wanted.alias("wanted"))


def _tested(v: Column) -> Column:
    """What criteria compare of a cell."""
    kind = v["kind"]
    spelt = F.when(kind == "number", v["num"]).when((kind == "text") & (v["txt"] != ""), parse_number(v["txt"]))
    cell = F.when(kind == "boolean", F.when(v["flag"], "true").otherwise("false")).when(kind == "text", F.lower(v["txt"]))
    return F.struct(kind.alias("kind"), spelt.alias("spelt"), cell.alias("cell"), v["flag"].alias("flag"))


def _meets(tested: Column, criterion: Column) -> Column:
    """Whether a cell (null: none there) meets a criterion, both as read above."""
    kind, spelt, cell = F.coalesce(tested["kind"], F.lit("empty")), tested["spelt"], tested["cell"]
    sign, operand, wanted = criterion["sign"], criterion["operand"], criterion["wanted"]

    def compared(a: Column, b: Column) -> Column:
        return F.when(sign == "=", a == b).when(sign == "<>", a != b).when(sign == "<", a < b).when(sign == "<=", a <= b).when(sign == ">", a > b).otherwise(a >= b)

    unlike = sign == "<>"
    by_number = F.coalesce(compared(spelt, wanted), unlike)
    by_text = F.when(kind == "empty", (operand == "") & sign.isin("=", "<=", ">=")).when(kind == "number", unlike).otherwise(compared(cell, operand))
    text = F.when(wanted.isNotNull(), by_number).otherwise(by_text)
    same = F.when(criterion["kind"] == "number", spelt == criterion["num"]).when(criterion["kind"] == "boolean", (kind == "boolean") & (tested["flag"] == criterion["flag"]))
    blank = (kind == "empty") | ((kind == "number") & (spelt == 0)) | ((kind == "text") & (cell == ""))
    return F.coalesce(F.when(criterion["kind"] == "text", text).when(criterion["kind"] == "empty", blank).otherwise(same), F.lit(False))


def lexed(rows: DataFrame, formula: str) -> DataFrame:
    """``rows`` with (shape, areas, singles, numbers) of a formula's text; quoted texts stay in the shape.

    A step a column, so that each text is searched once.
    """
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ranges = F.col(formula).contains(":")
    rows = rows.withColumns({"areas": F.when(ranges, found(F.col(formula), _AREA_RE)).otherwise(F.array().cast("array<string>")), "__bare": F.when(ranges, F.regexp_replace(formula, _AREA_RE, _AREA)).otherwise(F.col(formula))})
    rows = rows.withColumns({"singles": found(F.col("__bare"), _CELL_RE), "__barer": F.regexp_replace("__bare", _CELL_RE, _CELL)}).drop("__bare")
    return rows.withColumns({"numbers": found(F.col("__barer"), _NUMBER_RE), "shape": F.regexp_replace("__barer", _NUMBER_RE, _NUMBER)}).drop("__barer")


def _column(letters: Column) -> Column:
    """The number of a column, from 0, by its letters, of which there are three at most."""
    upper, place = F.upper(letters), lambda i: F.ascii(F.substring(F.upper(letters), i, 1)) - 64
    two = place(1) * 26 + place(2)
    return (F.when(F.length(upper) == 1, place(1)).when(F.length(upper) == 2, two).otherwise(two * 26 + place(3)) - 1).cast("long")


def _place(text: Column) -> tuple[Column, Column]:
    """(row, column) of a reference, from 0."""
    return F.regexp_extract(text, r"(\d+)$", 1).cast("long") - 1, _column(F.regexp_extract(text, r"^\$?([A-Za-z]+)", 1))


def _boxes(areas: Column) -> Column:
    """Corners of ranges, from 0; a step a transform, so that each text is searched once."""
    halves = F.transform(areas, lambda t: F.struct(*[F.regexp_extract(t, rf"^({_PLACE})\s*:\s*({_PLACE})$", k).alias(n) for k, n in ((1, "a"), (2, "b"))]))
    ends = F.transform(halves, lambda x: F.struct(*[c.alias(n + m) for n in "ab" for c, m in zip(_place(x[n]), "rc", strict=True)]))
    return F.transform(ends, lambda x: F.struct(F.least(x["ar"], x["br"]).alias("r1"), F.least(x["ac"], x["bc"]).alias("c1"), F.greatest(x["ar"], x["br"]).alias("r2"), F.greatest(x["ac"], x["bc"]).alias("c2")))


def _value(cell: Column, kind: str) -> Value:
    """A cell of a kind that is known when the plan is made."""
    if kind == "error":
        return Value(F.lit(None).cast("double"), "number", cell["txt"])
    if kind == "empty":
        return Value(F.lit(None).cast("double"), "number")
    return Value(cell[{"number": "num", "text": "txt", "boolean": "flag"}[kind]], kind)


def _as_cell(v: Value) -> Column:
    """A value as struct(kind, num, txt, flag); null is empty."""
    if isinstance(v, _Mixed):
        return v.cell
    none = F.when(v.column.isNull(), F.lit("empty")).otherwise(F.lit(v.kind))
    kind = none if v.error is None else F.when(v.error.isNotNull(), F.lit("error")).otherwise(none)
    null = {"num": F.lit(None).cast("double"), "txt": F.lit(None).cast("string"), "flag": F.lit(None).cast("boolean")}
    own = null | {{"number": "num", "text": "txt", "boolean": "flag"}[v.kind]: v.plain()}
    if v.error is not None:
        own["txt"] = F.coalesce(v.error, own["txt"])
    return F.struct(kind.alias("kind"), *[c.alias(n) for n, c in own.items()])


@dataclass(frozen=True)
class _Mixed(Value):
    """A value whose kind differs by row: a text where one kind is wanted, ``cell`` as it is."""

    cell: Column | None = None


def _mixed(cell: Column) -> _Mixed:
    is_error = cell["kind"] == "error"
    return _Mixed(F.when(~is_error, _shown(cell)), "text", F.when(is_error, cell["txt"]), cell)


def _failed_cell(code: Column) -> Column:
    return F.struct(F.lit("error").alias("kind"), F.lit(None).cast("double").alias("num"), code.alias("txt"), F.lit(None).cast("boolean").alias("flag"))


def _first_case(cases: list[tuple[Value | Column, Value]], rest: Column) -> Column:
    """The cell of the first case that holds; a condition's error ends the search."""
    out = rest
    for condition, then in reversed(cases):
        if isinstance(condition, Value):
            b = as_boolean(condition)
            hit, bad = F.coalesce(b.column, F.lit(False)), b.error
        else:
            hit, bad = condition, None
        out = F.when(hit, _as_cell(then)).otherwise(out)
        out = out if bad is None else F.when(bad.isNotNull(), _failed_cell(bad)).otherwise(out)
    return out


def _choices(name: str, x: list[Value]) -> Column | None:
    """IF and its kin where results are of several kinds; None where there is nothing to choose."""
    if name == "IF" and 2 <= len(x) <= 3:
        return _first_case([(x[0], x[1])], _as_cell(x[2] if len(x) == 3 else boolean(False)))
    if name in ("IFERROR", "IFNA") and len(x) == 2:
        c = _as_cell(x[0])
        bad = (c["kind"] == "error") & (F.lit(name == "IFERROR") | (c["txt"] == "#N/A"))
        return F.when(bad, _as_cell(x[1])).otherwise(c)
    if name == "IFS" and len(x) >= 2 and len(x) % 2 == 0:
        return _first_case(list(zip(x[::2], x[1::2], strict=True)), _failed_cell(F.lit("#N/A")))
    if name == "SWITCH" and len(x) >= 3:
        wanted = _as_cell(x[0])
        pairs = list(zip(x[1 : len(x) // 2 * 2 : 2], x[2::2], strict=False))
        out = _as_cell(x[-1]) if len(x) % 2 == 0 else _failed_cell(F.lit("#N/A"))
        for case, then in reversed(pairs):
            c = _as_cell(case)
            out = F.when(c["kind"] == "error", c).when(_equal(wanted, c), _as_cell(then)).otherwise(out)
        return F.when(wanted["kind"] == "error", wanted).otherwise(out)
    return None


class _Area:
    def __init__(self, index: int) -> None:
        self.index = index


class _Shape(reader._Reader):
    """Compiles a shape over the columns ``cells``, ``numbers``, ``states`` and ``answers`` of a row.

    ``uses`` tells what each area is used for; ``calls`` what is asked of cells
    of ranges: (function, areas, arguments).
    """

    def __init__(self, shape: str, kinds: list[str], answers: list[str] | None) -> None:
        self.tokens: list[tuple[str, str]] = []
        body, at = shape.lstrip().removeprefix("="), 0
        marks = {_CELL: "cell", _AREA: "area", _NUMBER: "constant"}
        while body[at:].strip():
            at += len(body[at:]) - len(body[at:].lstrip())
            if body[at] in marks:
                self.tokens.append((marks[body[at]], body[at]))
                at += 1
                continue
            m = reader._TOKENS.match(body, at)
            if not m:
                raise reader.FormulaError(f"unexpected {body[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.kinds_of, self.answers = 0, kinds, answers
        self.next = {"cell": 0, "area": 0, "constant": 0}
        self.uses: dict[int, set[str]] = {}
        self.calls: list[tuple[str, list[int], list[Value]]] = []

    def slot(self, kind: str) -> int:
        self.at += 1
        self.next[kind] += 1
        return self.next[kind] - 1

    def primary(self) -> Value:
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "cell":
            i = self.slot(kind)
            return _value(F.get("cells", F.lit(i)), self.kinds_of[i])
        if kind == "constant":
            return Value(F.get("numbers", F.lit(self.slot(kind))), "number")
        if kind == "area":
            return self.first_of(_Area(self.slot(kind)))
        if kind in ("ref", "name"):
            raise reader.FormulaError(f"unexpected {token!r}")
        return super().primary()

    def range(self) -> _Area | None:
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
        after = self.tokens[self.at + 1][1] if self.at + 1 < len(self.tokens) else ""
        return _Area(self.slot(kind)) if kind == "area" and after in (",", ")", "") else None

    def asked(self, name: str, areas: list[_Area], arguments: list[Value]) -> Value:
        self.calls.append((name, [x.index for x in areas], arguments))
        place = len(self.calls) - 1
        return _value(F.get("answers", F.lit(place)), "number" if self.answers is None else self.answers[place])

    def first_of(self, area: _Area) -> Value:
        """A range where one value is wanted: its first cell."""
        return self.asked("FIRST", [area], [])

    def state(self, x: _Area | Value, what: str) -> dict[str, Column]:
        if isinstance(x, _Area):
            self.uses.setdefault(x.index, set()).add(what)
            return {n: F.col("states")[x.index][n] for n in (*_LAYERS, "least", "greatest", "every", "some", "text", "error")}
        c = _as_cell(x)
        n, kind = _numeric(c), c["kind"]
        return {
            "num": F.coalesce(n, F.lit(0.0)), "n": n.isNotNull().cast("double"), "numbers": (kind == "number").cast("double"),
            "filled": (~((kind == "empty") | ((kind == "text") & (c["txt"] == "")) | (kind == "error"))).cast("double"),
            "bad": (kind == "error").cast("double"), "least": n, "greatest": n, "every": _truth(c), "some": _truth(c), "text": as_text(x).column, "error": F.when(kind == "error", c["txt"]),
        }

    def call(self, name: str) -> Value:
        self.take("(")
        arguments: list[_Area | Value] = []
        while self.peek() != ")":
            some = self.range()
            arguments.append(self.binary() if some is None else some)
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != ")":
                raise reader.FormulaError(") expected")
        self.take(")")
        areas = [x for x in arguments if isinstance(x, _Area)]
        if name in _CALLS:
            return self.conditional(name, arguments)
        if name in reader.AGGREGATE:
            return self.total(name, arguments)
        if areas and name in ("AND", "OR"):
            return self.logical(name, arguments)
        if areas and name in ("CONCAT", "CONCATENATE"):
            parts = [self.state(x, "text") for x in arguments]
            return Value(F.concat(*[F.coalesce(p["text"], F.lit("")) for p in parts]), "text", first_error(*[p["error"] for p in parts]))
        if areas:
            return reader._failed("#VALUE!")
        build = reader.SCALAR.get(name)
        if build is None:
            return reader._failed("#NAME?")
        if name in ("IF", "IFERROR", "IFNA", "IFS", "SWITCH"):
            cell = _choices(name, arguments)
            return reader._failed("#VALUE!") if cell is None else _mixed(cell)
        try:
            return build(*arguments)
        except (TypeError, ValueError):
            return reader._failed("#VALUE!")

    def total(self, name: str, arguments: list[_Area | Value]) -> Value:
        parts = [self.state(x, "sums" if name in _SUMS else "cells") for x in arguments]
        added = lambda k: reduce(lambda a, b: a + b, [p[k] for p in parts], F.lit(0.0))
        error = first_error(*[p["error"] for p in parts])
        if name == "COUNT":
            return Value(reduce(lambda a, b: a + b, [F.when(p["bad"] > 0, F.lit(0.0)).otherwise(p["numbers"]) for p in parts], F.lit(0.0)), "number")
        if name == "COUNTA":
            return Value(reduce(lambda a, b: a + b, [F.when(p["bad"] > 0, F.lit(1.0)).otherwise(p["filled"]) for p in parts], F.lit(0.0)), "number")
        if name == "SUM":
            return Value(added("num"), "number", error)
        if name == "AVERAGE":
            return Value(F.try_divide(added("num"), added("n")), "number", first_error(error, F.when(added("n") == 0, F.lit("#DIV/0!"))))
        k, pick = ("least", F.least) if name == "MIN" else ("greatest", F.greatest)
        found = [p[k] for p in parts]
        best = pick(*found) if len(found) > 1 else found[0] if found else F.lit(0.0)
        return Value(F.coalesce(best, F.lit(0.0)), "number", error)

    def logical(self, name: str, arguments: list[_Area | Value]) -> Value:
        k, join = ("every", s.all_of) if name == "AND" else ("some", s.any_of)
        each = []
        for x in arguments:
            if isinstance(x, Value):
                each.append(x)
                continue
            p = self.state(x, "cells")
            none = F.when(p[k].isNull(), F.lit("#VALUE!")) if name == "OR" else None
            each.append(Value(F.coalesce(p[k], F.lit(False)), "boolean", first_error(p["error"], none)))
        return join(*each)

    def conditional(self, name: str, arguments: list[_Area | Value]) -> Value:
        before = len(self.calls)
        areas = [i for i, x in enumerate(arguments) if isinstance(x, _Area)]
        wanted = {"COUNTIF": ([0], 2, 2), "SUMIF": ([0, 2][: len(arguments) - 1], 2, 3), "VLOOKUP": ([1], 3, 4)}[name]
        if areas != wanted[0] or not wanted[1] <= len(arguments) <= wanted[2] or before != len(self.calls):
            return reader._failed("#VALUE!")
        return self.asked(name, [arguments[i] for i in areas], [x for x in arguments if isinstance(x, Value)])


def compiled(shape: str, kinds: list[str], answers: list[str] | None = None) -> tuple[Value, _Shape | None]:
    """(value, what it uses) of a shape whose cells have these kinds; what is no formula gives #VALUE!."""
    try:
        made = _Shape(shape, kinds, answers)
        v = made.binary()
        if made.at < len(made.tokens):
            raise reader.FormulaError("something follows the formula")
    except (reader.FormulaError, IndexError):
        return reader._failed("#VALUE!"), None
    return v, made


def _chosen(made: list[tuple[Column, Column]], kind: str) -> Column:
    """The expression of the first condition that holds."""
    out = F.lit(None).cast(kind)
    for condition, c in reversed(made):
        out = F.when(condition, c).otherwise(out)
    return out


_CELL_KIND = "struct<kind:string,num:double,txt:string,flag:boolean>"
_ASK = f"struct<call:int,name:string,area:int,other:int,first:{_CELL_KIND},second:{_CELL_KIND},third:{_CELL_KIND}>"


def _striped(rows: DataFrame, known: DataFrame, first: Column, last: Column) -> DataFrame:
    """``rows`` once for each stripe of their range, as far down as their sheet has cells."""
    used = known.groupBy("sheet").agg(F.max("row").alias("__used"))
    clipped = rows.join(used, "sheet").where(first <= F.col("__used"))
    return clipped.withColumn("stripe", F.explode(F.sequence(F.floor(first / STRIPE), F.floor(F.least(last, F.col("__used")) / STRIPE)))).drop("__used")


def _covered(rows: DataFrame, by: list[str], first: Column, last: Column) -> DataFrame:
    """(by, stripe) of the stripes that the ranges of a group touch, each once: where more ranges have begun than ended."""
    step = lambda at, n: F.struct(F.floor(at / STRIPE).alias("stripe"), F.lit(n).alias("open"))
    ends = rows.select(*by, F.explode(F.array(step(first, 1), step(last + STRIPE, -1))).alias("at")).groupBy(*by, "at.stripe").agg(F.sum("at.open").alias("open"))
    down = Window.partitionBy(*by).orderBy("stripe")
    spans = ends.select(*by, "stripe", F.sum("open").over(down).alias("open"), F.lead("stripe").over(down).alias("until")).where("open > 0")
    return spans.select(*by, F.explode(F.sequence(F.col("stripe"), F.col("until") - 1)).alias("stripe"))


def _equal_to(criterion: Column) -> Column:
    """What a cell that meets a criterion of equality has among its keys; null for other criteria, and those that blanks meet."""
    kind, wanted, operand = criterion["kind"], criterion["wanted"], criterion["operand"]
    number = lambda n: F.concat(F.lit("n"), (n + F.lit(0.0)).cast("string"))
    text = F.when(wanted.isNotNull(), number(wanted)).when(operand != "", F.concat(F.lit("t"), operand))
    return F.when(kind == "number", number(criterion["num"])).when(kind == "boolean", F.concat(F.lit("b"), criterion["flag"].cast("string"))).when((kind == "text") & (criterion["sign"] == "="), text)


def _equals(tested: Column) -> Column:
    number, text, flag = F.concat(F.lit("n"), (tested["spelt"] + F.lit(0.0)).cast("string")), F.concat(F.lit("t"), tested["cell"]), F.concat(F.lit("b"), tested["flag"].cast("string"))
    return F.array_compact(F.array(number, text, flag))


_MET = ["hits", "there", "num", "odd", "bad", "most"]


def _met_once(asks: DataFrame, known: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, call, hits, there, num, odd, bad, most) of COUNTIF and SUMIF (key, ask, a, b, asked, blank), both ranges of one width.

    Ranges of the same columns with the same criterion are a set.  The cells
    that meet the criterion are found once a set, those equal to a value by
    it; a range is the difference of two sums down the set's rows.  Numbers
    are ten-thousandths; ``odd`` counts those that are none, ``bad`` errors.
    """
    at, to = F.col("a.r1") - F.col("b.r1"), F.col("a.c1") - F.col("b.c1")
    sets = asks.select(*_KEY, F.col("ask.call").alias("call"), "asked", "blank", "a", F.col("b.r1").alias("lo"), F.least(F.col("b.r2"), F.col("a.r2") - at).alias("hi"), F.col("b.c1").alias("c1"), F.col("b.c2").alias("c2"), at.alias("dr"), to.alias("dc"), _equal_to(F.col("asked")).alias("key"), (F.col("ask.name") == "SUMIF").alias("sums"))
    sets = _kept(sets.withColumn("set", F.to_json(F.struct("asked", "c1", "c2", "dr", "dc"))))
    used = known.groupBy("sheet").agg(F.max("row").alias("used"))
    by = ["sheet", "set", "asked", "blank", "key", "c1", "c2", "dr", "dc"]
    own, equal = (F.col("dr") == 0) & (F.col("dc") == 0), F.col("key").isNotNull()
    # What is searched for equal values are the tested cells, otherwise the summed ones.
    shift = F.when(equal, F.col("dr")).otherwise(F.lit(0))
    clipped = sets.join(used, "sheet").select(*by, (F.col("lo") + shift).alias("from"), F.least(F.col("hi") + shift, "used").alias("till")).where("`from` <= till")
    covered = _kept(_covered(clipped, by, F.col("from"), F.col("till")))
    one = cells.select("sheet", "r", "c", "v", "w", "stripe")
    tested = cells.select("sheet", F.col("r").alias("tr"), F.col("c").alias("tc"), "w")
    there = ["sheet", "set", "asked", "blank", "r", "v", "w"]
    parts = []
    for by_value, same in [(r[0], r[1]) for r in covered.select(equal, own).distinct().collect()]:
        some = covered.where((equal == by_value) & (own == same))
        if by_value:
            keyed = one.select("*", F.explode(_equals(F.col("w"))).alias("key"))
            found = some.join(keyed.hint("merge"), ["sheet", "key", "stripe"]).where((F.col("c") - F.col("dc")).between(F.col("c1"), F.col("c2")))
            if not same:
                moved = found.drop("v").withColumns({"r": F.col("r") - F.col("dr"), "c": F.col("c") - F.col("dc")})
                found = moved.join(one.select("sheet", "r", "c", "v").hint("merge"), ["sheet", "r", "c"])
        else:
            found = some.join(one.hint("merge"), ["sheet", "stripe"]).where(F.col("c").between(F.col("c1"), F.col("c2")))
            if not same:
                moved = found.drop("w").withColumns({"tr": F.col("r") + F.col("dr"), "tc": F.col("c") + F.col("dc")})
                found = moved.join(tested.hint("merge"), ["sheet", "tr", "tc"], "left")
        parts.append(found.select(*there))
    hit = _meets(F.col("w"), F.col("asked")) & ~F.coalesce(F.col("w.kind") == "error", F.lit(False))
    units, whole = _in_units(_numeric(F.col("v")))
    layers = {
        "hits": hit.cast("double"), "there": F.lit(1.0), "num": F.when(hit & whole, units).otherwise(0.0), "odd": (hit & ~whole).cast("double"), "bad": (hit & (F.col("v.kind") == "error")).cast("double"),
    }
    bad = known.where("v.kind = 'error'")
    errors = not bad.isEmpty()
    # Errors among tested cells fail a sum wherever they are in their range: a set of their own for each width of it.
    tests = F.to_json(F.struct(F.col("a.c1").alias("errors"), F.col("a.c2").alias("to")))
    none = {n: F.lit(0.0) for n in ("hits", "there", "num", "odd")}
    if errors:
        widths = sets.where("sums").select("sheet", tests.alias("set"), F.col("a.c1").alias("c1"), F.col("a.c2").alias("c2")).distinct()
        amiss = widths.join(bad.select("sheet", "row", "col"), "sheet").where("col BETWEEN c1 AND c2").select("sheet", "set", F.col("row").alias("r"), *[c.alias(n) for n, c in (none | {"bad": F.lit(1.0)}).items()])
    met = [p.where(hit | F.col("blank")).select("sheet", "set", "r", *[c.alias(n) for n, c in layers.items()]) for p in parts] + ([amiss] if errors else [])
    point = lambda name, r, sign: F.struct(name.alias("set"), r.alias("r"), F.lit(sign).alias("sign"))
    points = F.array(point(F.col("set"), F.col("hi"), 1.0), point(F.col("set"), F.col("lo") - 1, -1.0))
    if errors:
        points = F.when(F.col("sums"), F.concat(points, F.array(point(tests, F.col("a.r2"), 1.0), point(tests, F.col("a.r1") - 1, -1.0)))).otherwise(points)
    wanted = sets.select(*_KEY, "call", F.explode(points).alias("at")).select("sheet", "at.set", "at.r", "at.sign", F.struct("row", "col", "call").alias("of")).where("r >= 0")
    names = _MET[:-1]
    zeros = {n: F.lit(0.0) for n in names}
    nothing = wanted.limit(0).select("sheet", "set", "r", *[c.alias(n) for n, c in zeros.items()])
    met = reduce(DataFrame.unionByName, met or [nothing]).withColumn("block", F.floor(F.col("r") / BLOCK))
    every = met.withColumns({"sign": F.lit(None).cast("double"), "of": F.lit(None).cast("struct<row:bigint,col:bigint,call:int>")}).unionByName(wanted.withColumns(zeros | {"block": F.floor(F.col("r") / BLOCK)}))
    down = Window.partitionBy("sheet", "set", "block").orderBy("r").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = every.select("sheet", "set", "block", "sign", "of", *[F.sum(n).over(down).alias(n) for n in names]).where("of IS NOT NULL")
    # Blocks before: as many as a set's rows have blocks of cells or of ends.
    totals = met.select("sheet", "set", "block", *names, F.abs("num").alias("most")).unionByName(wanted.select("sheet", "set", F.floor(F.col("r") / BLOCK).alias("block"), *[F.lit(0.0).alias(n) for n in _MET]))
    totals = totals.groupBy("sheet", "set", "block").agg(*[F.sum(n).alias(n) for n in _MET])
    before = Window.partitionBy("sheet", "set").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("sheet", "set", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"{n}_ahead") for n in names], F.sum("most").over(Window.partitionBy("sheet", "set")).alias("most"))
    placed = upto.join(ahead.hint("merge"), ["sheet", "set", "block"])
    return placed.groupBy("sheet", "of").agg(*[F.sum(F.col("sign") * (F.col(n) + F.col(f"{n}_ahead"))).alias(n) for n in names], F.max("most").alias("most")).select("sheet", "of.*", *_MET)


def _in_units(numeric: Column) -> tuple[Column, Column]:
    """(ten-thousandths of a number, 0 if there is none; whether they are the number exactly)."""
    number = F.coalesce(numeric, F.lit(0.0))
    units = F.floor(number * UNIT + 0.5).cast("double")
    return units, (F.abs(number) < EXACT / UNIT / UNIT) & (units / UNIT == number)


def _range_states(areas: DataFrame, known: DataFrame) -> DataFrame:
    """(key, area, state) of areas (key, area, r1, c1, r2, c2, whether their cells are wanted and not only sums, and their texts).

    Small ranges meet their cells by place; of larger ones, sums come from a
    summed-area table and the rest from stripes of rows.
    """
    v, place, box = F.col("v"), F.struct("r", "c"), ["sheet", "row", "col", "end_row", "end_col"]
    units, whole = _in_units(_numeric(v))
    layers = {
        "num": F.when(whole, units).otherwise(0.0), "n": _numeric(v).isNotNull().cast("double"), "numbers": (v["kind"] == "number").cast("double"),
        "filled": (v["kind"].isin("number", "boolean") | ((v["kind"] == "text") & (v["txt"] != ""))).cast("double"), "bad": (v["kind"] == "error").cast("double"), "odd": (~whole).cast("double"),
    }
    # Only CONCAT needs a range's texts together: they are one cell's text in the end.
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("texts"), F.struct("r", "c", _shown(v).alias("t"))))), lambda x: x["t"]), "")
    own = [
        F.sum(_numeric(v)).alias("added"), F.min(_numeric(v)).alias("least"), F.max(_numeric(v)).alias("greatest"), F.bool_and(_truth(v)).alias("every"), F.bool_or(_truth(v)).alias("some"),
        texts.alias("text"), F.min_by(v["txt"], F.when(v["kind"] == "error", place)).alias("error"),
    ]
    rects = areas.select(F.col("sheet"), F.col("r1").alias("row"), F.col("c1").alias("col"), F.col("r2").alias("end_row"), F.col("c2").alias("end_col"), "wanted", "texts").groupBy(*box).agg(F.max("wanted").alias("wanted"), F.max("texts").alias("texts"))
    rects = rects.withColumn("near", (F.col("end_row") - F.col("row") + 1) * (F.col("end_col") - F.col("col") + 1) <= PLACES)
    cells = known.select("sheet", F.col("row").alias("r"), F.col("col").alias("c"), "v")
    near = rects.where("near").withColumn("r", F.explode(F.sequence("row", "end_row"))).withColumn("c", F.explode(F.sequence("col", "end_col"))).join(cells.hint("merge"), ["sheet", "r", "c"], "left")
    there = {n: F.sum(F.when(v.isNotNull(), c).otherwise(0.0)) for n, c in layers.items()} | {"most": F.sum(F.when(v.isNotNull(), F.abs(layers["num"])).otherwise(0.0))}
    small = near.groupBy(*box).agg(*[c.alias(n) for n, c in there.items()], *own)

    layered = known.select(*_KEY, *[c.alias(n) for n, c in layers.items()])
    sheets = layered.groupBy("sheet").agg(F.sum(F.abs("num")).alias("most"))
    sums = _kept(rectangle_sums(layered, rects.where("NOT near"), [*_LAYERS, "odd"]).join(sheets, "sheet", "left"))
    apart = (F.col("odd") > 0) | F.coalesce(F.col("most") >= EXACT, F.lit(False))
    # The cells of a range themselves: where their order or extremes count, and for the code of an error.
    open_ = sums.where(F.col("wanted") | apart | (F.col("bad") > 0)).select(*box, "texts")
    inside = _striped(open_, known, F.col("row"), F.col("end_row")).join(cells.withColumn("stripe", F.floor(F.col("r") / STRIPE)).hint("merge"), ["sheet", "stripe"]).where("r BETWEEN row AND end_row AND c BETWEEN col AND end_col")
    large = sums.join(inside.groupBy(*box).agg(*own), box, "left").select(small.columns)
    num = F.when(apart, F.coalesce("added", F.lit(0.0))).otherwise(F.col("num") / UNIT)
    full = small.unionByName(large).withColumn("num", num).select(*box, F.struct(*_LAYERS, "least", "greatest", "every", "some", "text", "error").alias("state"))
    keyed = full.select(F.col("sheet"), *[F.col(a).alias(b) for a, b in (("row", "r1"), ("col", "c1"), ("end_row", "r2"), ("end_col", "c2"))], "state")
    return areas.join(keyed.hint("merge"), ["sheet", "r1", "c1", "r2", "c2"]).select(*_KEY, "area", "state")


def _answers(asks: DataFrame, known: DataFrame) -> DataFrame:
    """(key, call, v) of what is asked of the cells of ranges (key, ask, a: the area's corners, b: the other's).

    Cells and formulas meet by merges: what grows with a sheet is not broadcast.
    What many formulas ask alike, lookups and first cells, is looked for once;
    so is what meets a criterion, but in small sheets.
    """
    cells = known.select("sheet", F.col("row").alias("r"), F.col("col").alias("c"), "v", _tested(F.col("v")).alias("w"), F.floor(F.col("row") / STRIPE).alias("stripe"))
    key = [*_KEY, "ask", "a", "b"]

    def within(rows: DataFrame, area: str) -> DataFrame:
        met = _striped(rows, known, F.col(f"{area}.r1"), F.col(f"{area}.r2")).join(cells.hint("merge"), ["sheet", "stripe"])
        return met.where(F.col("r").between(F.col(f"{area}.r1"), F.col(f"{area}.r2")) & F.col("c").between(F.col(f"{area}.c1"), F.col(f"{area}.c2"))).drop("stripe")

    def width(area: str) -> Column:
        return F.col(f"{area}.c2") - F.col(f"{area}.c1") + 1

    def order(area: str) -> Column:
        return (F.col("r") - F.col(f"{area}.r1")) * width(area) + F.col("c") - F.col(f"{area}.c1")

    name, crit = F.col("ask.name"), F.col("ask.first")
    as_number = lambda n: F.struct(F.lit("number").alias("kind"), n.cast("double").alias("num"), F.lit(None).cast("string").alias("txt"), F.lit(None).cast("boolean").alias("flag"))
    failed = _failed_cell

    blank = _meets(_tested(F.lit(None).cast(_CELL_KIND)), F.col("asked"))
    size = (F.col("a.r2") - F.col("a.r1") + 1) * width("a")
    code = F.when(crit["kind"] == "error", crit["txt"])
    conditional = asks.where(name.isin("COUNTIF", "SUMIF")).withColumn("asked", _criterion(crit)).withColumn("blank", blank)
    # Sheets where criteria are met once: in small ones, and for ranges that pair in another way, cells are compared one by one.
    large = known.groupBy("sheet").agg(F.max("row").alias("__used")).where(F.col("__used") >= NEAR).select("sheet")
    summable = code.isNull() & (width("a") == width("b"))
    first = conditional.where(summable).join(large, "sheet", "left_semi")
    apart, once_met = conditional, None
    if not first.isEmpty():
        sums = _kept(_met_once(first, known, cells))
        clean = (name == "COUNTIF") | ((F.col("bad") == 0) & (F.col("odd") == 0) & (F.col("most") < EXACT))
        both = conditional.withColumn("call", F.col("ask.call")).join(sums.hint("merge"), [*_KEY, "call"], "left")
        total = F.when(name == "COUNTIF", F.col("hits") + F.when(F.col("blank"), size - F.col("there")).otherwise(0.0)).otherwise(F.col("num") / UNIT)
        once_met = both.where(F.col("hits").isNotNull() & clean).select(*_KEY, "call", as_number(total).alias("v"))
        apart = both.where(F.col("hits").isNull() | ~clean).select(*conditional.columns)

    # COUNTIF: the cells that are there, and those that are not where a blank meets.
    counted = apart.where(name == "COUNTIF")
    hits = within(counted, "a").groupBy(*_KEY, "ask.call").agg(F.count_if((F.col("v.kind") != "error") & _meets(F.col("w"), F.col("asked"))).alias("hits"), F.count("*").alias("there"))
    counts = counted.withColumn("call", F.col("ask.call")).join(hits.hint("merge"), [*_KEY, "call"], "left").select(
        *_KEY, "call", F.when(crit["kind"] == "error", failed(crit["txt"])).otherwise(as_number(F.coalesce("hits", F.lit(0)) + F.when(F.col("blank"), size - F.coalesce("there", F.lit(0))).otherwise(0))).alias("v"))

    # SUMIF: the summed cells with the tested ones in the same place of their range, and errors among the tested.
    summed = apart.where(name == "SUMIF")
    beside = within(summed, "b").withColumn("i", order("b"))
    tested = cells.select("sheet", F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("w").alias("t"))
    paired = beside.withColumns({"tr": F.col("a.r1") + F.floor(F.col("i") / width("a")), "tc": F.col("a.c1") + F.col("i") % width("a")}).where("tr <= a.r2").join(tested.hint("merge"), ["sheet", "tr", "tc"], "left")
    met = _meets(F.col("t"), F.col("asked")) & ~F.coalesce(F.col("t.kind") == "error", F.lit(False))
    sums = paired.groupBy(*_KEY, "ask.call").agg(F.sum(F.when(met, _numeric(F.col("v")))).alias("total"), F.min(F.when(met & (F.col("v.kind") == "error"), F.struct("i", "v.txt"))).alias("bad"))
    probes = within(summed, "a").where("v.kind = 'error'").groupBy(*_KEY, "ask.call").agg(F.min(F.struct(order("a").alias("i"), F.col("v.txt"))).alias("probe"))
    first_bad = F.least("bad", "probe")
    totals = summed.withColumn("call", F.col("ask.call")).join(sums.hint("merge"), [*_KEY, "call"], "left").join(probes.hint("merge"), [*_KEY, "call"], "left").select(
        *_KEY, "call", F.when(crit["kind"] == "error", failed(crit["txt"])).when(first_bad.isNotNull(), failed(first_bad["txt"])).otherwise(as_number(F.coalesce("total", F.lit(0.0)))).alias("v"))

    # VLOOKUP: the first row of the range whose first cell is equal, then the cell beside it.
    looked = asks.where(name == "VLOOKUP").withColumn("index", F.floor(F.col("ask.second.num")))
    exact = F.col("ask.third").isNull() | F.coalesce(F.col("ask.third.flag"), F.col("ask.third.num") != 0, F.lit(False))
    wrong = F.when(crit["kind"] == "error", crit["txt"]).when(F.col("ask.second.kind") == "error", F.col("ask.second.txt")).when(F.col("index").isNull() | (F.col("index") < 1) | ~exact, F.lit("#VALUE!")).when(F.col("index") > width("a"), F.lit("#REF!"))
    # Equal searches of one column have one key: its corners, and what is looked for as text.
    search = ["sheet", "k", "wanted"]
    keys = looked.withColumns({"k": F.struct(F.col("a.r1").alias("r1"), F.col("a.c1").alias("c1"), F.col("a.r2").alias("r2"), F.col("a.c1").alias("c2")), "wanted": F.to_json(crit)})
    once = keys.groupBy(*search).agg(F.first(crit).alias("crit"))
    hit = within(once, "k").where((F.col("v.kind") == "error") | _equal(F.col("crit"), F.col("v"))).groupBy(*search).agg(F.min(F.struct("r", F.when(F.col("v.kind") == "error", F.col("v.txt")).alias("bad"))).alias("hit"))
    found = keys.withColumn("call", F.col("ask.call")).join(hit.hint("merge"), search, "left")
    target = cells.select("sheet", F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("v").alias("t"))
    fetched = found.withColumns({"tr": F.col("hit.r"), "tc": F.col("a.c1") + F.col("index") - 1}).join(target.hint("merge"), ["sheet", "tr", "tc"], "left")
    empty = typed(F.lit("empty"), F.lit(None).cast("string"))
    lookups = fetched.select(*_KEY, "call", F.when(wrong.isNotNull(), failed(wrong)).when(F.col("hit").isNull(), failed(F.lit("#N/A"))).when(F.col("hit.bad").isNotNull(), failed(F.col("hit.bad"))).otherwise(F.coalesce(F.col("t"), empty)).alias("v"))

    # The first cell of a range, or the first error in it.
    firsts = asks.where(name == "FIRST")
    some = within(firsts.select("sheet", "a").distinct(), "a").withColumn("at", F.struct("r", "c"))
    best = some.groupBy("sheet", "a").agg(F.min_by("v", F.when((F.col("v.kind") == "error") | ((F.col("r") == F.col("a.r1")) & (F.col("c") == F.col("a.c1"))), F.struct((F.col("v.kind") != "error").alias("x"), "at"))).alias("v"))
    tops = firsts.withColumn("call", F.col("ask.call")).join(best.hint("merge"), ["sheet", "a"], "left").select(*_KEY, "call", F.coalesce("v", empty).alias("v"))
    out = counts.unionByName(totals).unionByName(lookups).unionByName(tops)
    return out if once_met is None else out.unionByName(once_met)


def recalculate(cells: DataFrame, *, force: bool = False) -> DataFrame:
    """``cells`` (sheet, row, col, kind, value, formula) with the formulas' values and kinds; rows and columns count from 0.

    Only formula cells without a value are computed, or with ``force`` all.
    Kinds are number, string (or inlineStr), boolean, error, and empty.  A
    formula sees what cells held before.  Numbers are written to 15 digits.
    Absent cells are blank; null formulas are none.  Criteria of SUMIF and
    COUNTIF and arguments of VLOOKUP may be computed, but from no other range.
    """
    spark, keep = cells.sparkSession, _kept
    cells = keep(cells)
    base = cells.select(F.col("sheet").cast("string").alias("sheet"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "kind", "value", "formula")
    known = keep(base.where("kind <> 'empty'").select(*_KEY, typed(F.col("kind"), F.col("value")).alias("v")))
    due = (F.length(F.coalesce("formula", F.lit(""))) > 0) & (F.lit(force) | (F.coalesce("value", F.lit("")) == ""))
    # Formulas are read in as many tasks as there are rows for, whatever the files they come from.
    found = lexed(base.where(due).select(*_KEY, "formula").repartition(partitions(spark, cells.count()), *_KEY), "formula")
    boxes = F.when(F.size("areas") > 0, _boxes(F.col("areas")))
    todo = keep(found.select(*_KEY, "shape", boxes.alias("boxes"), "singles", F.transform("numbers", lambda n: n.try_cast("double")).alias("numbers")))

    row, col = _place(F.col("text"))
    single = todo.select(*_KEY, F.posexplode("singles").alias("i", "text")).select(*_KEY, "i", row.alias("r"), col.alias("c"))
    there = single.join(known.select("sheet", F.col("row").alias("r"), F.col("col").alias("c"), "v").hint("merge"), ["sheet", "r", "c"], "left")
    empty = typed(F.lit("empty"), F.lit(None).cast("string"))
    by_key = there.groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("v", empty).alias("v")))), lambda x: x["v"]).alias("cells"))
    ready = keep(todo.join(by_key.hint("merge"), _KEY, "left").withColumn("kinds", F.array_join(F.transform(F.coalesce("cells", F.array().cast(f"array<{_CELL_KIND}>")), lambda x: x["kind"]), ",")))

    # A shape and the kinds of its cells: as many as there are different formulas, whatever the number of cells.
    signatures = [(r.shape, r.kinds) for r in ready.select("shape", "kinds").distinct().collect()]
    made = {x: compiled(x[0], x[1].split(",") if x[1] else [])[1] for x in signatures}
    is_ = lambda x: (F.col("shape") == x[0]) & (F.col("kinds") == x[1])
    wanted = {}
    for (text, _), m in made.items():
        for i, uses in (m.uses if m else {}).items():
            cells_too, texts = wanted.get((text, i), (False, False))
            wanted[text, i] = cells_too or uses != {"sums"}, texts or "text" in uses
    if wanted:
        uses = spark.createDataFrame([(t, i, *w) for (t, i), w in wanted.items()], "shape string, area int, wanted boolean, texts boolean")
        used = ready.select(*_KEY, "shape", F.posexplode("boxes").alias("area", "box")).join(F.broadcast(uses), ["shape", "area"]).select(*_KEY, "area", "box.*", "wanted", "texts")
        states = _range_states(used, known)
        filled = states.groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("area", "state"))).alias("states"))
        ready = ready.join(filled.hint("merge"), _KEY, "left")

    asking = [x for x, m in made.items() if m and m.calls]
    if asking:
        null = F.lit(None).cast(_CELL_KIND)

        def asks_of(x: tuple[str, str]) -> Column:
            out = []
            for n, (name, some, arguments) in enumerate(made[x].calls):
                given = [_as_cell(v) for v in arguments]
                out.append(F.struct(F.lit(n).alias("call"), F.lit(name).alias("name"), F.lit(some[0]).alias("area"), F.lit(some[-1]).alias("other"), *[(given[k] if k < len(given) else null).alias(c) for k, c in enumerate(("first", "second", "third"))]))
            return F.array(*out).cast(f"array<{_ASK}>")

        def batch(some: list[tuple[str, str]]) -> DataFrame:
            mine = spark.createDataFrame(some, "shape string, kinds string")
            return ready.join(F.broadcast(mine), ["shape", "kinds"], "left_semi").select(*_KEY, "boxes", F.explode(_chosen([(is_(x), asks_of(x)) for x in some], f"array<{_ASK}>")).alias("ask"))

        asks = reduce(DataFrame.unionByName, [batch(asking[i : i + SHAPES]) for i in range(0, len(asking), SHAPES)])
        asks = keep(asks.select(*_KEY, "ask", F.col("boxes")[F.col("ask.area")].alias("a"), F.col("boxes")[F.col("ask.other")].alias("b")))
        answers = _answers(asks, known).groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("call", "v"))), lambda x: x["v"]).alias("answers"))
        ready = keep(ready.join(answers.hint("merge"), _KEY, "left"))
        kinds_of = F.array_join(F.transform(F.coalesce("answers", F.array().cast(f"array<{_CELL_KIND}>")), lambda x: x["kind"]), ",")
        ready = ready.withColumn("found", kinds_of)
    else:
        ready = ready.withColumn("found", F.lit(""))

    final = [(r.shape, r.kinds, r.found) for r in ready.select("shape", "kinds", "found").distinct().collect()] if asking else [(*x, "") for x in signatures]

    def evaluated(some: list[tuple[str, str, str]]) -> DataFrame:
        mine = spark.createDataFrame(some, "shape string, kinds string, found string")
        values = [(is_(x) & (F.col("found") == x[2]), _as_cell(compiled(x[0], x[1].split(",") if x[1] else [], x[2].split(",") if x[2] else [])[0])) for x in some]
        return ready.join(F.broadcast(mine), ["shape", "kinds", "found"], "left_semi").select(*_KEY, _chosen(values, _CELL_KIND).alias("v"))

    if not final:
        return cells
    results = reduce(DataFrame.unionByName, [evaluated(final[i : i + SHAPES]) for i in range(0, len(final), SHAPES)])
    v = F.col("v")
    infinite = (v["kind"] == "number") & (F.isnan(v["num"]) | (F.abs(v["num"]) == float("inf")))
    is_error = (v["kind"] == "error") | infinite | ((v["kind"] == "text") & v["txt"].startswith("#"))
    named = results.select(*[F.col(k).alias(f"__{k}") for k in _KEY], F.when(infinite, "#NUM!").otherwise(_shown(v)).alias("__value"), F.when(is_error, "error").when(v["kind"].isin("text", "empty"), "string").otherwise(v["kind"]).alias("__kind"))
    same = [F.col(k).cast("string" if k == "sheet" else "long") == F.col(f"__{k}") for k in _KEY]
    joined = cells.join(named.hint("merge"), same, "left")
    new = {"kind": F.coalesce("__kind", "kind"), "value": F.coalesce("__value", "value")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in cells.columns])
