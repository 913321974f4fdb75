"""Workbook packages as DataFrames.

A package is a zip of XML parts.  Spark lists and reads the files
(``binaryFile``, so any store that Spark reads), a small helper unzips the
parts asked for, and Spark's XML functions and joins do the rest: shared
strings, formats and relations are resolved by joins, not by a reader's memory.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.references import index_column
from gridspark.operators import grid

#: A part beyond this size, unpacked, is refused: packages are not trusted.
MOST_BYTES = 512 << 20

_CELL = "struct<_r:string,_t:string,_s:int,v:string,f:string,is:struct<t:string,r:array<struct<t:string>>>>"
_SHEET = f"sheetPr struct<outlinePr:struct<_summaryBelow:string,_summaryRight:string>>, sheetFormatPr struct<_outlineLevelRow:int,_outlineLevelCol:int>, sheetData struct<row:array<struct<_r:int,_hidden:string,_ht:double,_outlineLevel:int,_collapsed:string,c:array<{_CELL}>>>>, mergeCells struct<mergeCell:array<struct<_ref:string>>>, cols struct<col:array<struct<_min:int,_max:int,_width:double,_hidden:string>>>, autoFilter struct<_ref:string>, dataValidations struct<dataValidation:array<struct<_type:string,_sqref:string,formula1:string>>>, "
_SHEET += "hyperlinks struct<hyperlink:array<struct<_ref:string,_id:string,_location:string,_tooltip:string,_display:string>>>, sheetViews struct<sheetView:array<struct<_showGridLines:string,_zoomScale:int,_rightToLeft:string,pane:struct<_state:string,_xSplit:double,_ySplit:double>>>>, "
_SHEET += "rowBreaks struct<brk:array<struct<_id:int>>>, colBreaks struct<brk:array<struct<_id:int>>>, sheetProtection struct<_sheet:string>, headerFooter struct<oddHeader:string,oddFooter:string>"
_STRINGS = "si array<struct<t:string,r:array<struct<t:string>>>>"
_BOOK = "workbookPr struct<_date1904:string>, sheets struct<sheet:array<struct<_name:string,_id:string,_state:string>>>, definedNames struct<definedName:array<struct<_name:string,_localSheetId:int,_hidden:string,_VALUE:string>>>"
_RELATIONS = "Relationship array<struct<_Id:string,_Target:string,_Type:string>>"
_STYLES = "numFmts struct<numFmt:array<struct<_numFmtId:int,_formatCode:string>>>, cellXfs struct<xf:array<struct<_numFmtId:int,_fontId:int,_fillId:int,_borderId:int>>>"
_TABLE = "_name string, _ref string, _headerRowCount int, _totalsRowCount int, tableColumns struct<tableColumn:array<struct<_name:string>>>"

_RUNS = "t:string,r:array<struct<t:string>>"
_COMMENTS = f"authors struct<author:array<string>>, commentList struct<comment:array<struct<_ref:string,_authorId:int,text:struct<{_RUNS}>>>>"
_PERSONS = "person array<struct<_id:string,_displayName:string>>"
_THREADED = "threadedComment array<struct<_ref:string,_id:string,_personId:string,_dT:string,_parentId:string,text:string>>"
_SLICERS = "slicer array<struct<_name:string,_caption:string,_cache:string,_columnCount:int,_showCaption:string>>"
_SLICER_CACHE = "_name string, _sourceName string, data struct<tabular:struct<items:struct<i:array<struct<_n:string,_s:string>>>>>"
_POINTS = "ptLst struct<pt:array<struct<_modelId:string,_type:string,t:struct<p:array<struct<r:array<struct<t:string>>>>>>>>, cxnLst struct<cxn:array<struct<_type:string,_srcId:string,_destId:string,_srcOrd:int>>>"
_CACHE = "pt:array<struct<_idx:int,v:string>>"
_SERIES = f"ser:array<struct<idx:struct<_val:int>,tx:struct<strRef:struct<strCache:struct<{_CACHE}>>,v:string>,cat:struct<strRef:struct<strCache:struct<{_CACHE}>>,numRef:struct<numCache:struct<{_CACHE}>>>,xVal:struct<numRef:struct<numCache:struct<{_CACHE}>>>,val:struct<numRef:struct<numCache:struct<{_CACHE}>>>,yVal:struct<numRef:struct<numCache:struct<{_CACHE}>>>>>"

# The chart elements of a plot area and the kinds they stand for.
CHARTS = {"barChart": "bar", "lineChart": "line", "pieChart": "pie", "doughnutChart": "doughnut", "scatterChart": "scatter", "areaChart": "area", "radarChart": "radar"}
_CHART = "chart struct<plotArea:struct<" + ",".join(f"{name}:struct<barDir:struct<_val:string>,grouping:struct<_val:string>,{_SERIES}>" for name in CHARTS) + ">>"


#: What reading a member raises where it is damaged, encrypted or compressed in an unknown way.
DAMAGED = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError)


def damage(e: Exception) -> str:
    return "encrypted" if isinstance(e, RuntimeError) and not isinstance(e, NotImplementedError) else "damaged"


def parts(spark: SparkSession, path: str, wanted: str = r"\.(xml|rels)$") -> DataFrame:
    """(workbook, part, content) of the parts whose name matches; an encrypted or broken file has one row with ``error``, and so has a damaged member.

    A file is unpacked in one task, part by part; a DOCTYPE is refused.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    pattern = re.compile(wanted)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(workbook: str, part: str | None, content: str | None, error: str | None) -> pd.DataFrame:
            return pd.DataFrame({"workbook": [workbook], "part": [part], "content": [content], "error": [error]})

        for batch in batches:
            for workbook, data in zip(batch["path"], batch["content"], strict=True):
                if bytes(data[:4]) == b"\xd0\xcf\x11\xe0":
                    yield row(workbook, None, None, "encrypted")
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as package:
                        for entry in package.infolist():
                            if pattern.search(entry.filename):
                                if entry.file_size > MOST_BYTES:
                                    yield row(workbook, entry.filename, None, "too large")
                                    continue
                                try:
                                    content = package.read(entry).decode("utf-8-sig", "replace")
                                except DAMAGED as e:
                                    yield row(workbook, entry.filename, None, damage(e))
                                    continue
                                yield row(workbook, entry.filename, None if "<!DOCTYPE" in content[:1000] else content, "doctype" if "<!DOCTYPE" in content[:1000] else None)
                except DAMAGED:
                    yield row(workbook, None, None, "not a package")

    return files.mapInPandas(unpack, "workbook string, part string, content string, error string")


def _read(part_rows: DataFrame, name: str, schema: str) -> DataFrame:
    """(workbook, part, x) for the parts whose name matches."""
    found = part_rows.where(F.col("part").rlike(name) & F.col("content").isNotNull())
    return found.select("workbook", "part", F.from_xml("content", F.lit(schema), {"mode": "PERMISSIVE", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}).alias("x"))


def _bounds(ref: Column) -> list[Column]:
    """col, row, end_col, end_row of ``A1:B2`` or ``A1``."""
    clean = F.replace(ref, F.lit("$"), F.lit(""))
    first, last = F.split_part(clean, F.lit(":"), F.lit(1)), F.element_at(F.split(clean, ":"), -1)
    letters = lambda c: index_column(F.regexp_extract(c, "^([A-Za-z]+)", 1))
    digits = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("int") - 1
    cols, rows = (letters(first), letters(last)), (digits(first), digits(last))
    return [F.least(*cols).alias("col"), F.least(*rows).alias("row"), F.greatest(*cols).alias("end_col"), F.greatest(*rows).alias("end_row")]


def _text(t: Column, runs: Column) -> Column:
    return F.coalesce(t, F.array_join(F.transform(runs, lambda r: F.coalesce(r["t"], F.lit(""))), ""), F.lit(""))


class Workbooks:
    """The packages at a path: each member is a lazy DataFrame keyed by workbook."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.parts = parts(spark, path)

    def errors(self) -> DataFrame:
        return self.parts.where("error is not null").select("workbook", "part", "error")

    def sheets(self) -> DataFrame:
        """(workbook, sheet_index, sheet, state, part, date1904) in workbook order."""
        book = _read(self.parts, r"^xl/workbook\.xml$", _BOOK)
        named = book.select("workbook", F.coalesce(F.col("x.workbookPr._date1904").isin("1", "true"), F.lit(False)).alias("date1904"), F.posexplode("x.sheets.sheet").alias("sheet_index", "s"))
        targets = _read(self.parts, r"^xl/_rels/workbook\.xml\.rels$", _RELATIONS).select("workbook", F.explode("x.Relationship").alias("r"))
        targets = targets.select("workbook", F.col("r._Id").alias("id"), F.when(F.col("r._Target").startswith("/"), F.substr("r._Target", F.lit(2))).otherwise(F.concat(F.lit("xl/"), F.regexp_replace("r._Target", r"^\./", ""))).alias("part"))
        joined = named.withColumn("id", F.col("s._id")).join(targets, ["workbook", "id"], "left")
        fallback = F.concat(F.lit("xl/worksheets/sheet"), (F.col("sheet_index") + 1).cast("string"), F.lit(".xml"))
        return joined.select("workbook", "sheet_index", F.col("s._name").alias("sheet"), F.coalesce("s._state", F.lit("visible")).alias("state"), F.coalesce("part", fallback).alias("part"), "date1904")

    def strings(self) -> DataFrame:
        """(workbook, index, text) of the shared strings."""
        found = _read(self.parts, r"^xl/sharedStrings\.xml$", _STRINGS).select("workbook", F.posexplode("x.si").alias("index", "s"))
        return found.select("workbook", "index", _text(F.col("s.t"), F.col("s.r")).alias("text"))

    def _sheet_parts(self) -> DataFrame:
        read = _read(self.parts, r"^xl/worksheets/[^/]+\.xml$", _SHEET)
        return read.join(self.sheets().select("workbook", "part", "sheet_index", "sheet"), ["workbook", "part"])

    def cells(self) -> DataFrame:
        """(workbook, sheet_index, sheet, row, col, kind, value, formula, style_index), 0-based, one row per cell present."""
        rows = self._sheet_parts().select("workbook", "sheet_index", "sheet", F.posexplode("x.sheetData.row").alias("p", "r"))
        cells = rows.select("workbook", "sheet_index", "sheet", (F.coalesce("r._r", F.col("p") + 1) - 1).alias("row"), F.explode("r.c").alias("c"))
        place = F.when(F.col("c._r").isNull(), F.lit(0)).otherwise(index_column(F.regexp_extract("c._r", "^([A-Za-z]+)", 1)))
        typed = cells.select("workbook", "sheet_index", "sheet", "row", place.cast("int").alias("col"), F.coalesce("c._t", F.lit("n")).alias("t"), F.col("c.v").alias("v"), F.col("c.f").alias("formula"), F.coalesce("c._s", F.lit(0)).alias("style_index"), _text(F.col("c.is.t"), F.col("c.is.r")).alias("inline"))
        shared = self.strings().withColumnRenamed("text", "shared")
        looked = typed.withColumn("index", F.when(F.col("t") == "s", F.col("v").try_cast("int"))).join(shared, ["workbook", "index"], "left")
        value = (
            F.when(F.col("t") == "s", F.coalesce("shared", F.lit("")))
            .when(F.col("t") == "inlineStr", F.col("inline"))
            .when(F.col("t") == "b", F.when(F.col("v").isin("1", "true"), F.lit("TRUE")).otherwise(F.lit("FALSE")))
            .otherwise(F.coalesce("v", F.lit("")))
        )
        kind = (
            F.when(F.col("t").isin("s", "str"), F.lit("string"))
            .when(F.col("t") == "inlineStr", F.lit("inlineStr"))
            .when(F.col("t") == "b", F.lit("boolean"))
            .when(F.col("t") == "e", F.lit("error"))
            .when(F.col("v").isNull(), F.lit("empty"))
            .otherwise(F.lit("number"))
        )
        return looked.select("workbook", "sheet_index", "sheet", "row", "col", kind.alias("kind"), value.alias("value"), "formula", "style_index")

    def _ranges(self, each: Column, ref: str, *more: Column) -> DataFrame:
        found = self._sheet_parts().select("workbook", "sheet_index", "sheet", F.explode(each).alias("m"))
        return found.select("workbook", "sheet_index", "sheet", *_bounds(F.col(f"m.{ref}")), *more)

    def rows(self) -> DataFrame:
        """(workbook, sheet_index, sheet, row, height, hidden, level, collapsed) of the rows that are written, 0-based; heights in points, null where usual."""
        on = lambda c: F.coalesce(c.isin("1", "true"), F.lit(False))
        found = self._sheet_parts().select("workbook", "sheet_index", "sheet", F.posexplode("x.sheetData.row").alias("p", "r"))
        return found.select("workbook", "sheet_index", "sheet", (F.coalesce("r._r", F.col("p") + 1) - 1).alias("row"), F.col("r._ht").alias("height"), on(F.col("r._hidden")).alias("hidden"), F.coalesce("r._outlineLevel", F.lit(0)).alias("level"), on(F.col("r._collapsed")).alias("collapsed"))

    def outlines(self) -> DataFrame:
        """(workbook, sheet_index, sheet, max_row_level, max_col_level, summary_below, summary_right); with ``rows`` the input of ``outline.groups``."""
        on = lambda c: ~F.coalesce(c.isin("0", "false"), F.lit(False))
        most = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
        form, shown = F.col("x.sheetFormatPr"), F.col("x.sheetPr.outlinePr")
        return self._sheet_parts().select("workbook", "sheet_index", "sheet", most(form["_outlineLevelRow"]).alias("max_row_level"), most(form["_outlineLevelCol"]).alias("max_col_level"), on(shown["_summaryBelow"]).alias("summary_below"), on(shown["_summaryRight"]).alias("summary_right"))

    def recalculated(self, *, force: bool = False) -> DataFrame:
        """``cells`` with the values that their formulas have (see ``recalculate``): those without a cached one, or with ``force`` all."""
        from gridspark.operators.recalculate import recalculate

        cells = self.cells()
        own = F.concat_ws("|", "workbook", F.col("sheet_index").cast("string"))
        done = recalculate(cells.withColumnRenamed("sheet", "name").withColumn("sheet", own), force=force)
        return done.drop("sheet").withColumnRenamed("name", "sheet").select(*cells.columns)

    def merges(self) -> DataFrame:
        return self._ranges(F.col("x.mergeCells.mergeCell"), "_ref")

    def validations(self) -> DataFrame:
        """List validations, one row a range: options where the list is literal, else null."""
        listed = self._sheet_parts().select("workbook", "sheet_index", "sheet", F.explode("x.dataValidations.dataValidation").alias("m")).where(F.col("m._type") == "list")
        literal = F.col("m.formula1").rlike('^".*"$')
        options = F.when(literal, F.split(F.regexp_replace("m.formula1", '^"|"$', ""), ","))
        return listed.select("workbook", "sheet_index", "sheet", options.alias("options"), F.explode(F.split(F.trim("m._sqref"), r"\s+")).alias("ref")).select("workbook", "sheet_index", "sheet", *_bounds(F.col("ref")), "options")

    def widths(self) -> DataFrame:
        """(workbook, sheet, first, last, width, hidden) of column runs, 0-based."""
        found = self._sheet_parts().select("workbook", "sheet_index", "sheet", F.explode("x.cols.col").alias("m"))
        return found.select("workbook", "sheet_index", "sheet", (F.col("m._min") - 1).alias("first"), (F.col("m._max") - 1).alias("last"), F.col("m._width").alias("width"), F.coalesce(F.col("m._hidden").isin("1", "true"), F.lit(False)).alias("hidden"))

    def defined_names(self) -> DataFrame:
        found = _read(self.parts, r"^xl/workbook\.xml$", _BOOK).select("workbook", F.explode("x.definedNames.definedName").alias("n"))
        return found.select("workbook", F.col("n._name").alias("name"), F.col("n._localSheetId").alias("sheet_index"), F.col("n._VALUE").alias("refers_to"), F.coalesce(F.col("n._hidden") == "1", F.lit(False)).alias("hidden"))

    def formats(self) -> DataFrame:
        """(workbook, style_index, format_id, format_code), the code null for built-in formats."""
        styles = _read(self.parts, r"^xl/styles\.xml$", _STYLES)
        xfs = styles.select("workbook", F.posexplode("x.cellXfs.xf").alias("style_index", "f")).select("workbook", "style_index", F.col("f._numFmtId").alias("format_id"))
        codes = styles.select("workbook", F.explode("x.numFmts.numFmt").alias("n")).select("workbook", F.col("n._numFmtId").alias("format_id"), F.col("n._formatCode").alias("format_code"))
        return xfs.join(codes, ["workbook", "format_id"], "left").select("workbook", "style_index", "format_id", "format_code")

    def tables(self) -> DataFrame:
        """(workbook, part, table, ref, header_rows, totals_rows, columns)."""
        found = _read(self.parts, r"^xl/tables/[^/]+\.xml$", _TABLE)
        return found.select("workbook", "part", F.col("x._name").alias("table"), F.col("x._ref").alias("ref"), F.coalesce("x._headerRowCount", F.lit(1)).alias("header_rows"), F.coalesce("x._totalsRowCount", F.lit(0)).alias("totals_rows"), F.col("x.tableColumns.tableColumn._name").alias("columns"))

    def relations(self) -> DataFrame:
        """(workbook, source, id, type, target): what each part refers to, targets as names of parts."""
        found = _read(self.parts, r"_rels/[^/]+\.rels$", _RELATIONS).select("workbook", F.regexp_replace("part", r"_rels/([^/]+)\.rels$", "$1").alias("source"), F.explode("x.Relationship").alias("r"))
        target = F.concat(F.regexp_replace("source", r"[^/]*$", ""), F.regexp_replace("r._Target", r"^\./", ""))
        for _ in range(6):  # no part lies deeper
            target = F.regexp_replace(target, r"[^/]+/\.\./", "")
        target = F.when(F.col("r._Target").startswith("/"), F.substr("r._Target", F.lit(2))).when(F.col("r._Target").contains("://"), F.col("r._Target")).otherwise(target)
        return found.select("workbook", "source", F.col("r._Id").alias("id"), F.regexp_extract("r._Type", "([^/]*)$", 1).alias("type"), target.alias("target"), F.col("r._Target").alias("written"))

    def _of_sheets(self, found: DataFrame) -> DataFrame:
        """``found`` (workbook, part, ...) with the sheet whose relations name the part."""
        held = self.relations().select("workbook", F.col("source"), F.col("target").alias("part"))
        sheets = self.sheets().select("workbook", F.col("part").alias("source"), "sheet_index", "sheet")
        return found.join(held, ["workbook", "part"]).join(sheets, ["workbook", "source"]).drop("part", "source")

    def comments(self) -> DataFrame:
        """(workbook, sheet_index, sheet, col, row, author, text) of plain comments; an unknown or empty author is null."""
        found = _read(self.parts, r"(^|/)comments?[^/]*\.xml$", _COMMENTS).select("workbook", "part", F.col("x.authors.author").alias("authors"), F.explode("x.commentList.comment").alias("c"))
        author = F.nullif(F.get(F.col("authors"), F.col("c._authorId")), F.lit(""))
        col, row = _bounds(F.col("c._ref"))[:2]
        rows = found.select("workbook", "part", col, row, author.alias("author"), _text(F.col("c.text.t"), F.col("c.text.r")).alias("text"))
        return self._of_sheets(rows).select("workbook", "sheet_index", "sheet", "col", "row", "author", "text")

    def threaded_comments(self) -> DataFrame:
        """(workbook, sheet_index, sheet, col, row, id, parent_id, date, author, text): the input of ``hierarchy.threads``."""
        persons = _read(self.parts, r"(^|/)persons?/[^/]+\.xml$", _PERSONS).select("workbook", F.explode("x.person").alias("p")).select("workbook", F.col("p._id").alias("person"), F.col("p._displayName").alias("author")).dropDuplicates(["workbook", "person"])
        found = _read(self.parts, r"(^|/)threadedComment[^/]*\.xml$", _THREADED).select("workbook", "part", F.explode("x.threadedComment").alias("c")).where("c._ref is not null and c._id is not null")
        col, row = _bounds(F.col("c._ref"))[:2]
        rows = found.select("workbook", "part", col, row, F.col("c._id").alias("id"), F.col("c._parentId").alias("parent_id"), F.col("c._dT").alias("date"), F.col("c._personId").alias("person"), F.coalesce("c.text", F.lit("")).alias("text"))
        named = self._of_sheets(rows).join(persons, ["workbook", "person"], "left")
        return named.select("workbook", "sheet_index", "sheet", "col", "row", "id", "parent_id", "date", F.nullif(F.col("author"), F.lit("")).alias("author"), "text")

    def hyperlinks(self) -> DataFrame:
        """(workbook, sheet_index, sheet, cell_col, cell_row, target, location, tooltip, display, safe), one row per linked cell."""
        found = self._sheet_parts().select("workbook", "part", "sheet_index", "sheet", F.explode("x.hyperlinks.hyperlink").alias("h"))
        ranges = found.withColumn("ref", F.explode(F.split(F.trim("h._ref"), r"\s+"))).select("workbook", F.col("part").alias("source"), "sheet_index", "sheet", *_bounds(F.col("ref")), F.col("h._id").alias("id"), *[F.nullif(F.col(f"h._{c}"), F.lit("")).alias(c) for c in ("location", "tooltip", "display")])
        targets = self.relations().select("workbook", "source", "id", F.col("written").alias("target"))
        cells = grid.expanded(ranges.join(targets, ["workbook", "source", "id"], "left"))
        return cells.select("workbook", "sheet_index", "sheet", "cell_col", "cell_row", "target", "location", "tooltip", "display", grid.safe_link(F.col("target")).alias("safe"))

    def views(self) -> DataFrame:
        """One row a sheet: frozen rows and columns, grid lines, zoom, direction, page breaks, protection."""
        view = F.get(F.col("x.sheetViews.sheetView"), 0)
        frozen = lambda axis: F.when(view["pane"]["_state"].isin("frozen", "frozenSplit"), F.coalesce(view["pane"][axis], F.lit(0.0))).otherwise(F.lit(0.0)).cast("int")
        on = lambda c, default: F.coalesce(c.isin("1", "true"), F.lit(default))
        breaks = lambda c: F.coalesce(F.transform(c, lambda b: b["_id"]), F.array().cast("array<int>"))
        return self._sheet_parts().select(
            "workbook", "sheet_index", "sheet", frozen("_ySplit").alias("frozen_rows"), frozen("_xSplit").alias("frozen_cols"), on(view["_showGridLines"], True).alias("grid_lines"), view["_zoomScale"].alias("zoom"),
            on(view["_rightToLeft"], False).alias("right_to_left"), breaks(F.col("x.rowBreaks.brk")).alias("row_breaks"), breaks(F.col("x.colBreaks.brk")).alias("col_breaks"), on(F.col("x.sheetProtection._sheet"), False).alias("protected"),
        )

    def header_footers(self) -> DataFrame:
        """(workbook, sheet_index, sheet, header, footer): left, centre and right zones, null where there is none."""
        zones = lambda c: F.when(c != "", grid.header_zones(c))
        return self._sheet_parts().select("workbook", "sheet_index", "sheet", zones(F.col("x.headerFooter.oddHeader")).alias("header"), zones(F.col("x.headerFooter.oddFooter")).alias("footer")).where("header is not null or footer is not null")

    def slicers(self) -> DataFrame:
        """(workbook, sheet_index, sheet, slicer, caption, cache, source, columns, show_caption, items, selected)."""
        named = lambda c: c["_n"].isNotNull() & (c["_n"] != "")
        caches = _read(self.parts, r"(^|/)slicerCaches/[^/]+\.xml$", _SLICER_CACHE).select("workbook", F.col("x._name").alias("cache"), F.col("x._sourceName").alias("source"), F.coalesce(F.filter("x.data.tabular.items.i", named), F.array().cast("array<struct<_n:string,_s:string>>")).alias("i"))
        found = _read(self.parts, r"(^|/)slicers/[^/]+\.xml$", _SLICERS).select("workbook", "part", F.explode("x.slicer").alias("s"))
        rows = found.where("s._name is not null and s._cache is not null").select("workbook", "part", F.col("s._name").alias("slicer"), F.nullif(F.col("s._caption"), F.lit("")).alias("caption"), F.col("s._cache").alias("cache"), F.col("s._columnCount").alias("columns"), (~F.coalesce(F.col("s._showCaption").isin("0", "false"), F.lit(False))).alias("show_caption"))
        joined = self._of_sheets(rows).join(caches, ["workbook", "cache"], "left")
        texts = lambda c: F.coalesce(F.transform(c, lambda i: i["_n"]), F.array().cast("array<string>"))
        return joined.select("workbook", "sheet_index", "sheet", "slicer", "caption", "cache", "source", "columns", "show_caption", texts(F.col("i")).alias("items"), texts(F.filter("i", lambda i: i["_s"].isin("1", "true"))).alias("selected"))

    def diagram_nodes(self) -> DataFrame:
        """(workbook, part, id, kind, text) of diagrams, without the points that only serve their layout."""
        found = _read(self.parts, r"(^|/)diagrams/data[^/]*\.xml$", _POINTS).select("workbook", "part", F.explode("x.ptLst.pt").alias("p"))
        lines = F.transform(F.col("p.t.p"), lambda p: F.array_join(F.transform(p["r"], lambda r: F.coalesce(r["t"], F.lit(""))), ""))
        kept = F.col("p._modelId").isNotNull() & ~F.coalesce(F.col("p._type").isin("pres", "parTrans", "sibTrans"), F.lit(False))
        return found.where(kept).select("workbook", "part", F.col("p._modelId").alias("id"), F.coalesce("p._type", F.lit("")).alias("kind"), F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("text"))

    def diagram_edges(self) -> DataFrame:
        """(workbook, part, src, dst, ord): parents and children of diagrams, with ``diagram_nodes`` the input of ``hierarchy.levels``."""
        found = _read(self.parts, r"(^|/)diagrams/data[^/]*\.xml$", _POINTS).select("workbook", "part", F.explode("x.cxnLst.cxn").alias("c"))
        return found.where(F.coalesce("c._type", F.lit("parOf")) == "parOf").select("workbook", "part", F.col("c._srcId").alias("src"), F.col("c._destId").alias("dst"), F.coalesce("c._srcOrd", F.lit(0)).alias("ord"))

    def chart_points(self) -> DataFrame:
        """(workbook, part, kind, grouping, series, name, idx, category, value): the cached points of charts; what is no number is null."""
        read = _read(self.parts, r"(^|/)charts/chart[^/]*\.xml$", _CHART)
        kinds = []
        for element, kind in CHARTS.items():
            plot = F.col("x.chart.plotArea")[element]
            shown = F.when(plot["barDir"]["_val"] == "bar", F.lit("bar")).otherwise(F.lit("column")) if kind == "bar" else F.lit(kind)
            kinds.append(F.struct(shown.alias("kind"), plot["grouping"]["_val"].alias("grouping"), plot["ser"].alias("ser")))
        plots = read.select("workbook", "part", F.explode(F.array(*kinds)).alias("k")).select("workbook", "part", "k.kind", "k.grouping", F.posexplode("k.ser").alias("at", "s"))
        first = lambda cache: F.get(cache["pt"], 0)["v"]
        categories = F.coalesce(F.col("s.cat.strRef.strCache.pt"), F.col("s.cat.numRef.numCache.pt"), F.col("s.xVal.numRef.numCache.pt"))
        values = F.coalesce(F.col("s.val.numRef.numCache.pt"), F.col("s.yVal.numRef.numCache.pt"))
        named = plots.select("workbook", "part", "kind", "grouping", F.coalesce("s.idx._val", "at").alias("series"), F.coalesce(first(F.col("s.tx.strRef.strCache")), F.col("s.tx.v")).alias("name"), F.map_from_entries(F.transform(categories, lambda p: F.struct(p["_idx"], p["v"]))).alias("c"), F.explode(values).alias("v"))
        return named.select("workbook", "part", "kind", "grouping", "series", "name", F.col("v._idx").alias("idx"), F.try_element_at("c", F.col("v._idx")).alias("category"), F.col("v.v").try_cast("double").alias("value"))

    def extents(self) -> DataFrame:
        """(workbook, sheet, max_row, max_col) over the cells present."""
        return self.cells().groupBy("workbook", "sheet_index", "sheet").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def range_to_table(cells: DataFrame, columns: list[str], *, first_row: int, last_row: int, first_col: int) -> DataFrame:
    """A rectangle of cells as a wide table, one row per sheet row; numbers as text until cast."""
    inside = cells.where(F.col("row").between(first_row, last_row) & F.col("col").between(first_col, first_col + len(columns) - 1))
    wide = inside.groupBy("workbook", "sheet", "row").pivot("col", list(range(first_col, first_col + len(columns)))).agg(F.first("value"))
    return wide.select("workbook", "sheet", "row", *[F.col(str(first_col + i)).alias(n) for i, n in enumerate(columns)])
