"""A sheet as it is shown: every place of its rectangle, with what stands there and how.

The dense grid is a table, one row per place, that any number of tasks hold; its
side tables are joined by place or, for ranges, by stripe (see ``grid``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators import grid


def spine(sheets: DataFrame, *, by: list[str], rows: str = "rows", cols: str = "cols") -> DataFrame:
    """(by, row, col): every place, from 0, of sheets with that many rows and columns; empty sheets have none.

    Stripes of rows are dealt out to tasks before they expand, so that one large
    sheet isn't one task's work.
    """
    height = 1024
    sized = sheets.where((F.col(rows) > 0) & (F.col(cols) > 0)).select(*by, F.col(rows).alias("__rows"), F.col(cols).alias("__cols"))
    stripes = sized.withColumn("__from", F.explode(F.sequence(F.lit(0), (F.col("__rows") - 1).cast("int"), F.lit(height)))).repartition(*by, "__from")
    last = F.least(F.col("__from") + height, F.col("__rows")) - 1
    each = stripes.withColumn("row", F.explode(F.sequence(F.col("__from"), last.cast("int"))))
    return each.withColumn("col", F.explode(F.sequence(F.lit(0), (F.col("__cols") - 1).cast("int")))).select(*by, "row", "col")


def dense(sheets: DataFrame, cells: DataFrame, *, by: list[str], merges: DataFrame | None = None, sides: dict[str, DataFrame] | None = None, ranges: dict[str, DataFrame] | None = None) -> DataFrame:
    """The places of each sheet with its cells, null where there is none.

    ``merges`` (by, row, col, end_row, end_col) take out the places they cover
    and give their first place ``row_span`` and ``col_span`` (1 elsewhere).
    ``sides`` are tables by place, with at most one row each (comments, links,
    styles): their other columns come along as a struct under their name.
    ``ranges`` give a flag under their name: whether some range holds the place.
    The joins by place share one shuffle of the grid; ranges and merges, which
    meet it by stripe, take one more each.
    """
    place = [*by, "row", "col"]
    out = spine(sheets, by=by)
    for name, r in (ranges or {}).items():
        held = grid.in_ranges(out, r, by=by, how="left_semi").select(*place).withColumn(name, F.lit(True))
        out = out.join(held, place, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if merges is not None:
        out = grid.without_merged(out, merges, by=by)
        spans = merges.groupBy(*place).agg(F.max(F.col("end_row") - F.col("row") + 1).alias("row_span"), F.max(F.col("end_col") - F.col("col") + 1).alias("col_span"))
        out = out.join(spans, place, "left").withColumns({s: F.coalesce(s, F.lit(1)) for s in ("row_span", "col_span")})
    out = out.join(cells, place, "left")
    for name, side in (sides or {}).items():
        more = [c for c in side.columns if c not in place]
        out = out.join(side.select(*place, F.struct(*more).alias(name)), place, "left")
    return out


def with_hidden(places: DataFrame, *, by: list[str], rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """``hidden``: whether the place lies in a hidden row (by, row) or in hidden columns (by, first_col, last_col)."""
    hidden, out = F.lit(False), places
    if rows is not None:
        out = out.join(rows.select(*by, "row").distinct().withColumn("__hidden_row", F.lit(True)), [*by, "row"], "left")
        hidden = hidden | F.col("__hidden_row").isNotNull()
    if columns is not None:
        each = columns.select(*by, F.explode(F.sequence("first_col", "last_col")).alias("col")).distinct()
        out = out.join(each.withColumn("__hidden_col", F.lit(True)), [*by, "col"], "left")
        hidden = hidden | F.col("__hidden_col").isNotNull()
    return out.withColumn("hidden", hidden).drop("__hidden_row", "__hidden_col")


def visible(sheets: DataFrame, state: str = "state") -> DataFrame:
    """Sheets that are shown; a sheet without a state is."""
    return sheets.where(F.coalesce(F.col(state), F.lit("visible")) == "visible")


def frozen(row: Column, col: Column, x_split: Column, y_split: Column) -> Column:
    """both, row, col or null: which frozen panes hold the place; null splits freeze nothing."""
    in_x, in_y = F.coalesce(col < x_split, F.lit(False)), F.coalesce(row < y_split, F.lit(False))
    return F.when(in_x & in_y, F.lit("both")).when(in_y, F.lit("row")).when(in_x, F.lit("col"))


def filter_header(row: Column, col: Column, *, first_row: Column, first_col: Column, last_col: Column) -> Column:
    """Whether the place is in the header row of the sheet's filter."""
    return F.coalesce((row == first_row) & col.between(first_col, last_col), F.lit(False))


def displayed(value: Column, kind: Column, formula: Column, formatted: Column, *, formulas: bool = False) -> Column:
    """struct(text, numeric, formula): what a cell shows.

    Numbers show as their format says, all else as it is; a formula without a
    value shows itself, as every formula does where ``formulas`` is set.
    """
    empty = F.coalesce(value, F.lit("")) == ""
    as_formula = formula.isNotNull() & (empty | F.lit(formulas))
    numeric = F.coalesce(kind == "number", F.lit(False)) & ~as_formula
    text = F.when(as_formula, F.concat(F.lit("="), formula)).when(numeric & ~empty, F.coalesce(formatted, value)).otherwise(F.coalesce(value, F.lit("")))
    return F.struct(text.alias("text"), numeric.alias("numeric"), as_formula.alias("formula"))


def input_values(cells: DataFrame, *, by: list[str], ranges: DataFrame) -> DataFrame:
    """(by, control, values): what a list control offers, the filled cells of its range in reading order.

    ``ranges`` are (by, control, row, col, end_row, end_col).  A control's list
    is one row, as a form shows it.
    """
    filled = grid.in_ranges(cells.where(F.coalesce(F.col("value"), F.lit("")) != "").select(*by, "row", "col", "value"), ranges, by=by)
    listed = F.array_sort(F.collect_list(F.struct("row", "col", "value")))
    return filled.groupBy(*by, F.col("range_control").alias("control")).agg(F.transform(listed, lambda x: x["value"]).alias("values"))


def with_updates(places: DataFrame, updates: DataFrame, *, by: list[str], text: str = "text") -> DataFrame:
    """Shown places with the texts that controls set: (by, row, col, new), one a place.

    What a control shows changes, the cells behind it don't; a place that isn't
    shown gets nothing.
    """
    place = [*by, "row", "col"]
    joined = places.join(updates.select(*place, F.struct("new").alias("__set")), place, "left")
    return joined.withColumn(text, F.when(F.col("__set").isNotNull(), F.col("__set.new")).otherwise(F.col(text))).select(*places.columns)


# The types of form controls as files name them, lower-cased, and their kinds.
CONTROLS = {
    "button": "button", "checkbox": "checkbox", "radio": "radio", "drop": "combo", "combobox": "combo", "list": "list", "listbox": "list", "scroll": "scrollbar",
    "scrollbar": "scrollbar", "spin": "spinner", "spinner": "spinner", "groupbox": "groupBox", "label": "label", "dialog": "dialog",
}


def control_kind(object_type: Column) -> Column:
    """The kind of a form control; unknown for any other type, or none."""
    known = F.create_map(*[F.lit(x) for pair in CONTROLS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(object_type)), F.lit("unknown"))


def ruby(text: Column, runs: Column) -> Column:
    """array<struct<text, phonetic>>: the text cut at its phonetic runs (array<struct<start, end, phonetic>>, ends exclusive).

    Runs are clipped to the text and taken by their start; one that begins
    inside an earlier one is left out.  What no run covers has a null phonetic.
    """
    size = F.length(text)
    inside = lambda c: F.greatest(F.lit(0), F.least(c.cast("int"), size))
    placed = F.transform(F.coalesce(runs, F.array().cast("array<struct<start:int,end:int,phonetic:string>>")), lambda r, i: F.struct(inside(r["start"]).alias("start"), i.alias("at"), inside(r["end"]).alias("end"), r["phonetic"].alias("phonetic")))
    sound = F.array_sort(F.filter(placed, lambda r: r["end"] > r["start"]))
    piece = lambda a, b, p: F.struct(F.substring(text, a + 1, b - a).alias("text"), p.cast("string").alias("phonetic"))
    start = F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<text:string,phonetic:string>>").alias("parts"))

    def step(state: Column, r: Column) -> Column:
        plain = F.when(r["start"] > state["to"], F.array(piece(state["to"], r["start"], F.lit(None)))).otherwise(start["parts"])
        taken = F.struct(r["end"].alias("to"), F.concat(state["parts"], plain, F.array(piece(r["start"], r["end"], r["phonetic"]))).alias("parts"))
        return F.when(r["start"] < state["to"], state).otherwise(taken)

    def rest(state: Column) -> Column:
        return F.when(state["to"] < size, F.array_append(state["parts"], piece(state["to"], size, F.lit(None)))).otherwise(state["parts"])

    return F.when(text.isNotNull(), F.aggregate(sound, start, step, rest))


def ruby_html(parts: Column) -> Column:
    """The parts of ``ruby`` as HTML."""
    one = lambda p: F.when(p["phonetic"].isNull(), grid.escaped(p["text"])).otherwise(F.concat(F.lit("<ruby>"), grid.escaped(p["text"]), F.lit("<rt>"), grid.escaped(p["phonetic"]), F.lit("</rt></ruby>")))
    return F.array_join(F.transform(parts, one), "")


def table_rows(places: DataFrame, *, by: list[str], text: str = "text", classes: Column | None = None) -> DataFrame:
    """(by, row, html): each row of the dense grid as a table row, places in order, spans written where they exceed 1."""
    span = lambda n, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.lit("")) if c in places.columns else F.lit("")
    named = F.lit("") if classes is None else F.when(classes != "", F.concat(F.lit(' class="'), grid.escaped(classes), F.lit('"'))).otherwise(F.lit(""))
    td = F.concat(F.lit("<td"), span("rowspan", "row_span"), span("colspan", "col_span"), F.coalesce(named, F.lit("")), F.lit(">"), grid.escaped(F.col(text)), F.lit("</td>"))
    tds = F.array_sort(F.collect_list(F.struct(F.col("col"), td.alias("td"))))
    return places.groupBy(*by, "row").agg(F.concat(F.lit("<tr>"), F.array_join(F.transform(tds, lambda t: t["td"]), ""), F.lit("</tr>")).alias("html"))
