"""What lies over and beside the cells of packages: drawings, timelines, pivot ranges, spill anchors, media and embedded files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.sources.compound import streams_of
from gridspark.sources.xlsx import DAMAGED, Workbooks, _bounds, _read, damage

#: An embedded file or picture beyond this size is reported, not returned.
MOST_MEDIA = 32 << 20

# Media types by ending; a timeline's levels by number.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/emf", "wmf": "image/wmf"}
LEVELS = ("years", "quarters", "months", "days")

_CORNER = "struct<col:int,row:int,colOff:long,rowOff:long>"
_NAMED = "struct<cNvPr:struct<_id:int,_name:string,_descr:string>>"
_SHAPE = "spPr:struct<prstGeom:struct<_prst:string>>,txBody:struct<p:array<struct<r:array<struct<t:string>>>>>"
_ANCHOR = f"struct<from:{_CORNER},to:{_CORNER},pos:struct<_x:long,_y:long>,ext:struct<_cx:long,_cy:long>,pic:struct<nvPicPr:{_NAMED},blipFill:struct<blip:struct<_embed:string>>>,sp:struct<nvSpPr:{_NAMED},{_SHAPE}>,cxnSp:struct<nvCxnSpPr:{_NAMED},{_SHAPE}>,graphicFrame:struct<nvGraphicFramePr:{_NAMED},graphic:struct<graphicData:struct<chart:struct<_id:string>,relIds:struct<_dm:string>>>>>"
_ANCHORS = {"twoCellAnchor": "two cells", "oneCellAnchor": "one cell", "absoluteAnchor": "absolute"}
_TIMELINES = "timeline array<struct<_name:string,_caption:string,_cache:string,_level:string,_showHeader:string>>"
_TIMELINE_CACHE = "_name string, _sourceName string, state struct<selection:struct<_startDate:string,_endDate:string>,bounds:struct<_startDate:string,_endDate:string>>"
_BLOCKS = "struct<bk:array<struct<rc:struct<_t:int,_v:int>>>>"
_METADATA = f"metadataTypes struct<metadataType:array<struct<_name:string>>>, futureMetadata array<struct<_name:string,bk:array<struct<extLst:struct<ext:struct<dynamicArrayProperties:struct<_fDynamic:string>>>>>>>, cellMetadata {_BLOCKS}"


def drawings(books: Workbooks) -> DataFrame:
    """One row per anchored object of a sheet: how and where it is anchored (cells 0-based, lengths in EMU), kind, name, text, preset and the part it shows.

    Kinds are image, chart, diagram, shape and connector; an anchor that holds none of them has no row.
    """
    read = _read(books.parts, r"(^|/)drawings/drawing[^/]*\.xml$", ", ".join(f"{a} array<{_ANCHOR}>" for a in _ANCHORS))
    empty = F.array().cast(f"array<{_ANCHOR}>")
    tag = lambda mode: lambda d: F.struct(F.lit(mode).alias("anchor"), d.alias("d"))
    tagged = F.concat(*[F.transform(F.coalesce(F.col(f"x.{a}"), empty), tag(mode)) for a, mode in _ANCHORS.items()])
    rows = read.select("workbook", "part", F.posexplode(tagged).alias("place", "a")).select("workbook", "part", "place", "a.*")
    frame = F.col("d.graphicFrame.graphic.graphicData")
    kind = F.when(F.col("d.pic").isNotNull(), F.lit("image")).when(frame["chart"].isNotNull(), F.lit("chart")).when(frame["relIds"].isNotNull(), F.lit("diagram")).when(F.col("d.sp").isNotNull(), F.lit("shape")).when(F.col("d.cxnSp").isNotNull(), F.lit("connector"))
    name = F.coalesce(*[F.col(f"d.{x}.cNvPr._name") for x in ("pic.nvPicPr", "graphicFrame.nvGraphicFramePr", "sp.nvSpPr", "cxnSp.nvCxnSpPr")])
    lines = F.transform(F.coalesce(F.col("d.sp.txBody.p"), F.col("d.cxnSp.txBody.p")), lambda p: F.array_join(F.transform(p["r"], lambda r: F.coalesce(r["t"], F.lit(""))), ""))
    corner = [F.col(f"d.{c}.{f}").alias(n) for c, ends in (("from", ("col", "row", "col_offset", "row_offset")), ("to", ("end_col", "end_row", "end_col_offset", "end_row_offset"))) for f, n in zip(("col", "row", "colOff", "rowOff"), ends, strict=True)]
    said = rows.select(
        "workbook", "part", "place", "anchor", kind.alias("kind"), name.alias("name"), F.col("d.pic.nvPicPr.cNvPr._descr").alias("description"), *corner, F.col("d.pos._x").alias("x"), F.col("d.pos._y").alias("y"), F.col("d.ext._cx").alias("width"), F.col("d.ext._cy").alias("height"),
        F.coalesce("d.sp.spPr.prstGeom._prst", "d.cxnSp.spPr.prstGeom._prst").alias("preset"), F.array_join(lines, "\n").alias("text"), F.coalesce(F.col("d.pic.blipFill.blip._embed"), frame["chart"]["_id"], frame["relIds"]["_dm"]).alias("id"),
    ).where("kind is not null")
    targets = books.relations().select("workbook", F.col("source").alias("part"), "id", "target")
    return books._of_sheets(said.join(targets, ["workbook", "part", "id"], "left").drop("id"))


def timelines(books: Workbooks) -> DataFrame:
    """(workbook, sheet_index, sheet, timeline, caption, source, level, selected_from, selected_to, first, last): the input of ``pivot_filters.timeline``."""
    caches = _read(books.parts, r"(^|/)timelineCaches/[^/]+\.xml$", _TIMELINE_CACHE).select("workbook", F.col("x._name").alias("cache"), F.col("x._sourceName").alias("source"), *[F.col(f"x.state.{a}._{b}Date").alias(n) for a, b, n in (("selection", "start", "selected_from"), ("selection", "end", "selected_to"), ("bounds", "start", "first"), ("bounds", "end", "last"))])
    found = _read(books.parts, r"(^|/)timelines/[^/]+\.xml$", _TIMELINES).select("workbook", "part", F.explode("x.timeline").alias("t")).where("t._name is not null and t._cache is not null")
    spelt = F.lower("t._level")
    level = F.when(spelt.isin(*LEVELS), spelt).otherwise(F.get(F.array(*map(F.lit, LEVELS)), F.col("t._level").try_cast("int")))
    rows = found.select("workbook", "part", F.col("t._name").alias("timeline"), F.nullif(F.col("t._caption"), F.lit("")).alias("caption"), F.col("t._cache").alias("cache"), level.alias("level"))
    return books._of_sheets(rows).join(caches, ["workbook", "cache"], "left").select("workbook", "sheet_index", "sheet", "timeline", "caption", "source", "level", "selected_from", "selected_to", "first", "last")


def pivots(books: Workbooks) -> DataFrame:
    """(workbook, sheet_index, sheet, pivot, col, row, end_col, end_row): where pivot tables put their output."""
    found = _read(books.parts, r"(^|/)pivotTables/[^/]+\.xml$", "_name string, location struct<_ref:string>").where("x.location._ref is not null")
    return books._of_sheets(found.select("workbook", "part", F.coalesce("x._name", F.lit("")).alias("pivot"), *_bounds(F.col("x.location._ref"))))


def spill_blocks(books: Workbooks) -> DataFrame:
    """(workbook, cell_metadata, spills): which numbers of a cell's metadata (``cm``, from 1) mark dynamic arrays."""
    read = _read(books.parts, r"^xl/metadata\.xml$", _METADATA)
    blocks = read.select("workbook", "x", F.posexplode("x.cellMetadata.bk").alias("at", "b"))
    kind = F.get(F.col("x.metadataTypes.metadataType"), F.greatest(F.col("b.rc._t") - 1, F.lit(0)))["_name"]
    flags = F.get(F.filter("x.futureMetadata", lambda f: f["_name"] == "XLDAPR"), 0)["bk"]
    dynamic = F.get(flags, F.col("b.rc._v"))["extLst"]["ext"]["dynamicArrayProperties"]["_fDynamic"].isin("1", "true")
    return blocks.select("workbook", (F.col("at") + 1).alias("cell_metadata"), ((kind == "XLDAPR") & (F.col("b.rc._t") >= 1) & F.coalesce(dynamic, F.lit(False))).alias("spills"))


def extension_uris(books: Workbooks) -> DataFrame:
    """(workbook, sheet_index, sheet, uri, n): extensions of sheets."""
    read = _read(books.parts, r"^xl/worksheets/[^/]+\.xml$", "extLst struct<ext:array<struct<_uri:string>>>").join(books.sheets().select("workbook", "part", "sheet_index", "sheet"), ["workbook", "part"])
    return read.select("workbook", "sheet_index", "sheet", F.explode("x.extLst.ext._uri").alias("uri")).where("uri is not null").groupBy("workbook", "sheet_index", "sheet", "uri").agg(F.count("*").alias("n"))


def print_areas(books: Workbooks) -> DataFrame:
    """(workbook, sheet_index, col, row, end_col, end_row) of each rectangle that is printed."""
    named = books.defined_names().where("name = '_xlnm.Print_Area' and sheet_index is not null")
    each = named.withColumn("ref", F.explode(F.split("refers_to", ","))).select("workbook", "sheet_index", *_bounds(F.regexp_extract("ref", r"([^!]+)$", 1)))
    return each.where("col >= 0 and row >= 0")


def content_types(books: Workbooks) -> DataFrame:
    """(workbook, part, type) of the XML parts: the part's own entry, else that of its ending, else octet-stream."""
    read = _read(books.parts, r"^\[Content_Types\]\.xml$", "Default array<struct<_Extension:string,_ContentType:string>>, Override array<struct<_PartName:string,_ContentType:string>>")
    own = read.select("workbook", F.explode("x.Override").alias("o")).select("workbook", F.ltrim(F.col("o._PartName"), F.lit("/")).alias("part"), F.col("o._ContentType").alias("own"))
    ending = read.select("workbook", F.explode("x.Default").alias("d")).select("workbook", F.lower("d._Extension").alias("ending"), F.col("d._ContentType").alias("usual"))
    parts = books.parts.where("part is not null").select("workbook", "part", F.lower(F.regexp_extract("part", r"\.([^.]*)$", 1)).alias("ending"))
    return parts.join(own, ["workbook", "part"], "left").join(ending, ["workbook", "ending"], "left").select("workbook", "part", F.coalesce("own", "usual", F.lit("application/octet-stream")).alias("type"))


def binaries(spark: SparkSession, path: str, wanted: str = r"(^|/)(media|embeddings)/[^/]+$") -> DataFrame:
    """(workbook, part, type, data, error): pictures and embedded files; one beyond MOST_MEDIA has error ``too large`` and no data, a damaged or encrypted one says so."""
    pattern = re.compile(wanted)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for workbook, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    package = zipfile.ZipFile(io.BytesIO(data))
                except DAMAGED:  # ``xlsx.parts`` has a row for it
                    continue
                with package:
                    for entry in package.infolist():
                        if pattern.search(entry.filename):
                            content, error = None, "too large" if entry.file_size > MOST_MEDIA else None
                            try:
                                content = None if error else package.read(entry)
                            except DAMAGED as e:
                                error = damage(e)
                            yield pd.DataFrame({"workbook": [workbook], "part": [entry.filename], "data": [content], "error": [error]})

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "workbook string, part string, data binary, error string")
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return found.select("workbook", "part", F.try_element_at(kinds, F.lower(F.regexp_extract("part", r"\.([^.]*)$", 1))).alias("type"), "data", "error")


def compound_streams(data: Column) -> Column:
    """struct(clsid, streams) of embedded compound files; streams are null where the bytes are no such file."""

    @F.pandas_udf("struct<clsid:string,streams:array<struct<name:string,data:binary>>>")
    def read(files: pd.Series) -> pd.DataFrame:
        found = [streams_of(d) if d is not None else None for d in files]
        return pd.DataFrame({"clsid": [r and r[0] for r in found], "streams": [None if r is None else [{"name": n, "data": d} for n, d in r[1]] for r in found]})

    return read(data)
