"""Themes, cell styles and conditional formats of packages, resolved by joins and array functions.

What is small in every workbook (its theme, its named styles) travels as one
array or map a workbook; cells join their style by (workbook, style_index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.styles import font_family, hex_colour, indexed_colour, tinted
from gridspark.sources.xlsx import Workbooks, _bounds, _read

# The colour slots of a theme in the order of their numbers, and what the first four are by default.
SLOTS = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
DEFAULTS = ("#ffffff", "#000000", "#e7e6e6", "#44546a")

#: Named styles may rest on each other this often.
MOST_HOPS = 8

_C = "struct<srgbClr:struct<_val:string>,sysClr:struct<_val:string,_lastClr:string>>"
_FACE = "struct<latin:struct<_typeface:string>>"
_THEME = f"themeElements struct<clrScheme:struct<{','.join(f'{s}:{_C}' for s in SLOTS)}>,fontScheme:struct<majorFont:{_FACE},minorFont:{_FACE}>>"

_COLOUR = "struct<_rgb:string,_theme:int,_indexed:int,_tint:double>"
_VAL = "struct<_val:string>"
_FONT = f"struct<b:{_VAL},i:{_VAL},strike:{_VAL},u:{_VAL},vertAlign:{_VAL},sz:struct<_val:double>,color:{_COLOUR},name:{_VAL}>"
_FILL = f"struct<patternFill:struct<_patternType:string,fgColor:{_COLOUR},bgColor:{_COLOUR}>,gradientFill:struct<_type:string,_degree:double,stop:array<struct<_position:double,color:{_COLOUR}>>>>"
_EDGE = f"struct<_style:string,color:{_COLOUR}>"
_BORDER = f"struct<left:{_EDGE},right:{_EDGE},top:{_EDGE},bottom:{_EDGE}>"
_ALIGNMENT = "struct<_horizontal:string,_vertical:string,_wrapText:string,_indent:int,_textRotation:int>"
_XF = f"struct<_numFmtId:int,_fontId:int,_fillId:int,_borderId:int,_xfId:int,_applyNumberFormat:string,_applyFont:string,_applyFill:string,_applyBorder:string,_applyAlignment:string,alignment:{_ALIGNMENT}>"
_STYLES = f"fonts struct<font:array<{_FONT}>>, fills struct<fill:array<{_FILL}>>, borders struct<border:array<{_BORDER}>>, cellStyleXfs struct<xf:array<{_XF}>>, cellXfs struct<xf:array<{_XF}>>, dxfs struct<dxf:array<struct<font:{_FONT},fill:{_FILL},border:{_BORDER}>>>"

_CFVO = "array<struct<_type:string,_val:string>>"
_RULE = f"struct<_type:string,_priority:int,_dxfId:int,_operator:string,_text:string,_rank:int,_percent:string,_bottom:string,_aboveAverage:string,_equalAverage:string,_stdDev:int,_timePeriod:string,formula:array<string>,colorScale:struct<cfvo:{_CFVO},color:array<{_COLOUR}>>,dataBar:struct<cfvo:{_CFVO},color:{_COLOUR}>,iconSet:struct<_iconSet:string,_reverse:string,cfvo:{_CFVO}>>"
_RULES = f"conditionalFormatting array<struct<_sqref:string,cfRule:array<{_RULE}>>>"

#: Parts of an xf and the attribute that says that it sets them itself.
_PARTS = {"_numFmtId": "_applyNumberFormat", "_fontId": "_applyFont", "_fillId": "_applyFill", "_borderId": "_applyBorder"}


def _yes(c: Column) -> Column:
    return F.coalesce(c.isin("1", "true"), F.lit(False))


def theme(books: Workbooks) -> DataFrame:
    """(workbook, slot, name, colour, major_font, minor_font): a theme's twelve colours by number."""
    read = _read(books.parts, r"^xl/theme/theme1\.xml$", _THEME)

    def shown(name: str, default: str | None) -> Column:
        c = F.col("x.themeElements.clrScheme")[name]
        system = F.coalesce(hex_colour(c["sysClr"]["_lastClr"]), F.when(c["sysClr"]["_val"] == "windowText", F.lit("#000000")).when(c["sysClr"]["_val"] == "window", F.lit("#ffffff")))
        return F.coalesce(hex_colour(c["srgbClr"]["_val"]), system, F.lit(default))

    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(n).alias("name"), shown(n, DEFAULTS[i] if i < 4 else None).alias("colour")) for i, n in enumerate(SLOTS)])
    fonts = [F.col(f"x.themeElements.fontScheme.{f}Font.latin._typeface").alias(f"{f}_font") for f in ("major", "minor")]
    return read.select("workbook", F.explode(slots).alias("s"), *fonts).select("workbook", "s.*", "major_font", "minor_font")


def with_theme(books: Workbooks, rows: DataFrame) -> DataFrame:
    """``rows`` with a column theme: its workbook's colours by slot, null where it has no theme."""
    maps = theme(books).groupBy("workbook").agg(F.map_from_entries(F.collect_list(F.struct("slot", "colour"))).alias("theme"))
    return rows.join(maps, "workbook", "left")


def colour(ref: Column, themed: Column) -> Column:
    """``#rrggbb`` of a colour element; theme and legacy colours are tinted, written ones are not."""
    palette = F.split(F.lit(" ".join(indexed_colour(i) for i in range(64))), " ")  # folds to one literal
    base = F.when(ref["_theme"].isNotNull(), F.try_element_at(themed, ref["_theme"])).otherwise(F.get(palette, ref["_indexed"]))
    return F.when(ref["_rgb"].isNotNull(), hex_colour(ref["_rgb"])).otherwise(tinted(base, ref["_tint"]))


def _styles(books: Workbooks) -> DataFrame:
    # ``<b/>`` would read as nothing: its value is written out first.
    written = books.parts.withColumn("content", F.regexp_replace("content", r"<(\w+:)?(b|i|strike|u)\s*/>", '<$1$2 val="1"/>'))
    return with_theme(books, _read(written, r"^xl/styles\.xml$", _STYLES))


def _font(f: Column, themed: Column) -> Column:
    on = lambda c: F.coalesce(~c["_val"].isin("0", "false", "none"), F.lit(False))
    return F.struct(on(f["b"]).alias("bold"), on(f["i"]).alias("italic"), on(f["strike"]).alias("strike"), on(f["u"]).alias("underline"), f["vertAlign"]["_val"].alias("vertical"), f["sz"]["_val"].alias("size"), colour(f["color"], themed).alias("colour"), f["name"]["_val"].alias("name"))


def _fill(f: Column, themed: Column, *, differential: bool = False) -> Column:
    """Pattern, colours and gradient stops; a differential fill without a foreground is solid in its background."""
    front, back = colour(f["patternFill"]["fgColor"], themed), colour(f["patternFill"]["bgColor"], themed)
    pattern = F.coalesce(f["patternFill"]["_patternType"], F.lit("none"))
    if differential:
        pattern = F.when(front.isNull() & back.isNotNull() & (pattern == "none"), F.lit("solid")).otherwise(pattern)
        front = F.coalesce(front, back)
    stops = F.transform(f["gradientFill"]["stop"], lambda s: F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["_position"])).alias("position"), colour(s["color"], themed).alias("colour")))
    return F.struct(pattern.alias("pattern"), front.alias("front"), back.alias("back"), F.pmod(F.coalesce(f["gradientFill"]["_degree"], F.lit(0.0)), F.lit(360.0)).alias("degree"), stops.alias("stops"))


def _border(b: Column, themed: Column) -> Column:
    return F.struct(*[F.struct(b[side]["_style"].alias("line"), colour(b[side]["color"], themed).alias("colour")).alias(side) for side in ("left", "right", "top", "bottom")])


def css(font: Column, fill: Column, border: Column) -> Column:
    """The declarations of a style; stripes and gradients show their first colour's shape only as far as CSS names it."""
    said = lambda test, text: F.when(test, text)
    edge = lambda side: said(border[side]["line"].isNotNull() & (border[side]["line"] != "none"), F.concat(F.lit(f"border-{side}:"), F.when(border[side]["line"].isin("medium", "mediumDashed"), F.lit("2px")).when(border[side]["line"].isin("thick", "double"), F.lit("3px")).otherwise(F.lit("1px")), F.lit(" "), F.when(border[side]["line"].contains("ash"), F.lit("dashed")).when(border[side]["line"] == "dotted", F.lit("dotted")).when(border[side]["line"] == "double", F.lit("double")).otherwise(F.lit("solid")), F.lit(" "), F.coalesce(border[side]["colour"], F.lit("#000000"))))
    stops = F.array_join(F.transform(fill["stops"], lambda s: F.concat(F.coalesce(s["colour"], F.lit("#ffffff")), F.lit(" "), F.round(s["position"] * 100, 2).cast("string"), F.lit("%"))), ", ")
    decoration = F.concat_ws(" ", said(font["underline"], F.lit("underline")), said(font["strike"], F.lit("line-through")))
    return F.concat_ws(
        ";", said(font["bold"], F.lit("font-weight:bold")), said(font["italic"], F.lit("font-style:italic")), said(decoration != "", F.concat(F.lit("text-decoration:"), decoration)), said(font["size"].isNotNull(), F.concat(F.lit("font-size:"), font["size"].cast("string"), F.lit("pt"))),
        F.concat(F.lit("font-family:"), font_family(font["name"])), F.concat(F.lit("color:"), font["colour"]), said(F.size(fill["stops"]) > 1, F.concat(F.lit("background:linear-gradient("), F.round(fill["degree"] + 90, 2).cast("string"), F.lit("deg, "), stops, F.lit(")"))),
        said(~fill["pattern"].isin("none", "gray125"), F.concat(F.lit("background-color:"), fill["front"])), *[edge(side) for side in ("left", "right", "top", "bottom")],
    )


def _effective(own: Column, named: Column) -> Column:
    """An xf with what its chain of named styles adds, at most MOST_HOPS of them, none twice."""
    fields = lambda x: [x[p].alias(p) for p in _PARTS] + [_yes(x[a]).alias(a) for a in (*_PARTS.values(), "_applyAlignment")] + [x["alignment"].alias("alignment"), F.coalesce(x["_xfId"], F.lit(-1)).alias("next")]
    start = F.struct(*fields(own), F.array().cast("array<int>").alias("seen"))

    def hop(x: Column, _: Column) -> Column:
        base = F.get(named, F.greatest(x["next"], F.lit(0)))
        merged = F.struct(
            *[F.when(x[a], x[p]).otherwise(F.coalesce(F.nullif(base[p], F.lit(0)), x[p])).alias(p) for p, a in _PARTS.items()],
            *[(x[a] | _yes(base[a])).alias(a) for a in (*_PARTS.values(), "_applyAlignment")],
            F.when(x["_applyAlignment"], x["alignment"]).otherwise(base["alignment"]).alias("alignment"), F.coalesce(base["_xfId"], F.lit(-1)).alias("next"), F.array_append(x["seen"], x["next"]).alias("seen"),
        )
        ends = (x["next"] < 0) | (x["next"] >= F.coalesce(F.size(named), F.lit(0))) | F.array_contains(x["seen"], x["next"])
        return F.when(ends, x).otherwise(merged)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_HOPS)), start, hop)


def styles(books: Workbooks) -> DataFrame:
    """(workbook, style_index, format_id, font, fill, border, alignment, css) of each cell style, its named styles merged in."""
    xfs = _styles(books).select("workbook", "theme", "x", F.posexplode("x.cellXfs.xf").alias("style_index", "own"))
    found = xfs.withColumn("e", _effective(F.col("own"), F.col("x.cellStyleXfs.xf")))
    picked = lambda items, at: F.get(F.col(items), F.coalesce(F.col("e")[at], F.lit(0)))
    looks = found.select("workbook", "style_index", F.col("e._numFmtId").alias("format_id"), _font(picked("x.fonts.font", "_fontId"), F.col("theme")).alias("font"), _fill(picked("x.fills.fill", "_fillId"), F.col("theme")).alias("fill"), _border(picked("x.borders.border", "_borderId"), F.col("theme")).alias("border"), F.col("e.alignment").alias("alignment"))
    return looks.withColumn("css", css(F.col("font"), F.col("fill"), F.col("border")))


def differential_styles(books: Workbooks) -> DataFrame:
    """(workbook, dxf_id, font, fill, border, css): what conditional formats put over a cell's style."""
    found = _styles(books).select("workbook", "theme", F.posexplode("x.dxfs.dxf").alias("dxf_id", "d"))
    looks = found.select("workbook", "dxf_id", _font(F.col("d.font"), F.col("theme")).alias("font"), _fill(F.col("d.fill"), F.col("theme"), differential=True).alias("fill"), _border(F.col("d.border"), F.col("theme")).alias("border"))
    return looks.withColumn("css", css(F.col("font"), F.col("fill"), F.col("border")))


def rules(books: Workbooks) -> DataFrame:
    """One row a conditional format and range: the range, what the rule says, its stops and colours, and the CSS of its style."""
    read = _read(books.parts, r"^xl/worksheets/[^/]+\.xml$", _RULES).join(books.sheets().select("workbook", "part", "sheet_index", "sheet"), ["workbook", "part"])
    each = with_theme(books, read.select("workbook", "sheet_index", "sheet", F.posexplode("x.conditionalFormatting").alias("block", "f"))).select("*", F.posexplode("f.cfRule").alias("place", "r"))
    ranges = each.withColumn("ref", F.explode(F.split(F.trim("f._sqref"), r"\s+")))
    stops = F.coalesce(F.col("r.colorScale.cfvo"), F.col("r.dataBar.cfvo"), F.col("r.iconSet.cfvo"))
    scale = F.transform("r.colorScale.color", lambda c: colour(c, F.col("theme")))
    said = ranges.select(
        "workbook", "sheet_index", "sheet", "block", "place", *_bounds(F.col("ref")), F.col("r._type").alias("type"), F.col("r._priority").alias("priority"), F.col("r._dxfId").alias("dxf_id"), F.col("r._operator").alias("operator"), F.col("r._text").alias("text"), F.coalesce("r._rank", F.lit(10)).alias("rank"),
        _yes(F.col("r._percent")).alias("percent"), _yes(F.col("r._bottom")).alias("bottom"), (~F.coalesce(F.col("r._aboveAverage").isin("0", "false"), F.lit(False))).alias("above"), _yes(F.col("r._equalAverage")).alias("inclusive"), F.col("r._stdDev").alias("deviations"), F.col("r._timePeriod").alias("period"), F.col("r.formula").alias("formulas"),
        F.transform(stops, lambda s: F.struct(s["_type"].alias("kind"), s["_val"].try_cast("double").alias("value"))).alias("stops"), F.coalesce(scale, F.when(F.col("r.dataBar").isNotNull(), F.array(colour(F.col("r.dataBar.color"), F.col("theme"))))).alias("colours"), F.col("r.iconSet._iconSet").alias("icons"), _yes(F.col("r.iconSet._reverse")).alias("reverse"),
    )
    return said.join(differential_styles(books).select("workbook", "dxf_id", "css"), ["workbook", "dxf_id"], "left")
