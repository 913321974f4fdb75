"""Themes, styles, conditional formats, drawings, timelines, media and compound files of packages."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gridspark.sources import looks, objects
from gridspark.sources.compound import streams_of
from gridspark.sources.xlsx import Workbooks

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
M = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{R}"'


def relations(*rows):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{R}/{t}" Target="{to}"/>' for i, t, to in rows) + "</Relationships>"


def anchor(tag, inner, ends="<xdr:from><xdr:col>1</xdr:col><xdr:colOff>9525</xdr:colOff><xdr:row>2</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:to><xdr:col>3</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>4</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:to>"):
    return f"<xdr:{tag}>{ends}{inner}</xdr:{tag}>"


PARTS = {
    "[Content_Types].xml": '<Types><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="main"/></Types>',
    "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets><definedNames><definedName name="_xlnm.Print_Area" localSheetId="0">S!$A$1:$B$3,S!$D$4</definedName></definedNames></workbook>',
    "xl/_rels/workbook.xml.rels": relations(("rId1", "worksheet", "worksheets/sheet1.xml")),
    "xl/worksheets/sheet1.xml": f'<worksheet {M}><sheetData><row r="1"><c r="A1" s="1"><v>1</v></c></row></sheetData><conditionalFormatting sqref="A1:A9 C1"><cfRule type="top10" priority="2" dxfId="0" rank="3" bottom="1"/><cfRule type="colorScale" priority="1"><colorScale><cfvo type="min"/><cfvo type="percentile" val="50"/><color rgb="FFFF0000"/><color theme="4"/></colorScale></cfRule></conditionalFormatting>'
    '<extLst><ext uri="{a}"/><ext uri="{a}"/><ext uri="{b}"/></extLst></worksheet>',
    "xl/worksheets/_rels/sheet1.xml.rels": relations(("rId1", "drawing", "../drawings/drawing1.xml"), ("rId2", "timeline", "../timelines/timeline1.xml"), ("rId3", "pivotTable", "../pivotTables/pivotTable1.xml")),
    "xl/drawings/drawing1.xml": f'<xdr:wsDr xmlns:xdr="x" xmlns:a="a" xmlns:c="c" xmlns:r="{R}">'
    + anchor("twoCellAnchor", '<xdr:pic><xdr:nvPicPr><xdr:cNvPr id="2" name="Logo" descr="d"/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rId1"/></xdr:blipFill></xdr:pic>')
    + anchor("twoCellAnchor", '<xdr:graphicFrame><xdr:nvGraphicFramePr><xdr:cNvPr id="3" name="Chart"/></xdr:nvGraphicFramePr><a:graphic><a:graphicData uri="u"><c:chart r:id="rId2"/></a:graphicData></a:graphic></xdr:graphicFrame>')
    + anchor("oneCellAnchor", '<xdr:ext cx="100" cy="200"/><xdr:sp><xdr:nvSpPr><xdr:cNvPr id="4" name="Box"/></xdr:nvSpPr><xdr:spPr><a:prstGeom prst="rect"/></xdr:spPr><xdr:txBody><a:p><a:r><a:t>hello</a:t></a:r></a:p></xdr:txBody></xdr:sp>')
    + "</xdr:wsDr>",
    "xl/drawings/_rels/drawing1.xml.rels": relations(("rId1", "image", "../media/image1.png"), ("rId2", "chart", "../charts/chart1.xml")),
    "xl/timelines/timeline1.xml": '<timelines><timeline name="T" cache="C" level="2"/></timelines>',
    "xl/timelineCaches/timelineCache1.xml": '<timelineCacheDefinition name="C" sourceName="Day"><state><selection startDate="2024-01-01" endDate="2024-02-01"/><bounds startDate="2023-01-01" endDate="2025-01-01"/></state></timelineCacheDefinition>',
    "xl/pivotTables/pivotTable1.xml": '<pivotTableDefinition name="P"><location ref="C9:A3"/></pivotTableDefinition>',
    "xl/theme/theme1.xml": '<a:theme xmlns:a="a"><a:themeElements><a:clrScheme name="n"><a:dk1><a:sysClr val="windowText"/></a:dk1><a:accent1><a:srgbClr val="808080"/></a:accent1></a:clrScheme><a:fontScheme name="f"><a:majorFont><a:latin typeface="Big"/></a:majorFont><a:minorFont><a:latin typeface="Small"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>',
    "xl/styles.xml": f'<styleSheet {M}><fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="12"/><color theme="4" tint="-0.5"/><name val="Arial"/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor indexed="10"/></patternFill></fill></fills>'
    '<borders><border><left/></border><border><top style="thick"><color rgb="FF00FF00"/></top></border></borders><cellStyleXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/><xf numFmtId="9" fontId="0" fillId="1" borderId="1" xfId="1"/></cellStyleXfs>'
    '<cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="0" fontId="1" fillId="0" borderId="0" xfId="1" applyFont="1"/></cellXfs><dxfs><dxf><font><i/></font><fill><patternFill><bgColor rgb="FF123456"/></patternFill></fill></dxf></dxfs></styleSheet>',
    "xl/metadata.xml": f'<metadata {M}><metadataTypes><metadataType name="XLDAPR"/></metadataTypes><futureMetadata name="XLDAPR"><bk><extLst><ext uri="u"><xda:dynamicArrayProperties xmlns:xda="x" fDynamic="1"/></ext></extLst></bk></futureMetadata><cellMetadata><bk><rc t="1" v="0"/></bk><bk><rc t="1" v="5"/></bk></cellMetadata></metadata>',
    "xl/media/image1.png": b"\x89PNG",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    data, at = io.BytesIO(), tmp_path_factory.mktemp("looks")
    with zipfile.ZipFile(data, "w") as z:
        for name, content in PARTS.items():
            z.writestr(name, content)
    (at / "a.xlsx").write_bytes(data.getvalue())
    return str(at)


@pytest.fixture
def books(spark, folder):
    return Workbooks(spark, folder)


def test_theme_and_styles(books):
    rows = {r.slot: r for r in looks.theme(books).collect()}
    assert [rows[i].colour for i in range(6)] == ["#ffffff", "#000000", "#e7e6e6", "#44546a", "#808080", None] and rows[0].major_font == "Big"
    plain, bold = looks.styles(books).orderBy("style_index").collect()
    assert plain.css == 'font-size:11.0pt;font-family:"Calibri"' and plain.format_id == 0
    assert (bold.format_id, bold.font.bold, bold.font.colour, bold.fill.front, bold.border.top.line) == (9, True, "#404040", "#ff0000", "thick")
    assert bold.css == 'font-weight:bold;font-size:12.0pt;font-family:"Arial";color:#404040;background-color:#ff0000;border-top:3px solid #00ff00'
    assert [(r.fill.pattern, r.css) for r in looks.differential_styles(books).collect()] == [("solid", "font-style:italic;background-color:#123456")]


def test_rules(books):
    rows = looks.rules(books).orderBy("priority", "col").collect()
    assert [(r.type, r.col, r.end_row) for r in rows] == [("colorScale", 0, 8), ("colorScale", 2, 0), ("top10", 0, 8), ("top10", 2, 0)]
    assert [tuple(s) for s in rows[0].stops] == [("min", None), ("percentile", 50.0)] and rows[0].colours == ["#ff0000", "#808080"]
    assert (rows[2].rank, rows[2].bottom, rows[2].above, rows[2].css) == (3, True, True, "font-style:italic;background-color:#123456")


def test_objects(spark, books, folder):
    rows = objects.drawings(books).orderBy("place").collect()
    assert [(r.kind, r.anchor, r.name, r.target, r.text, r.preset) for r in rows] == [("image", "two cells", "Logo", "xl/media/image1.png", None, None), ("chart", "two cells", "Chart", "xl/charts/chart1.xml", None, None), ("shape", "one cell", "Box", None, "hello", "rect")]
    assert (rows[0].col, rows[0].row, rows[0].col_offset, rows[0].end_col, rows[2].width, rows[2].height) == (1, 2, 9525, 3, 100, 200)
    assert [tuple(r)[2:] for r in objects.timelines(books).collect()] == [("S", "T", None, "Day", "months", "2024-01-01", "2024-02-01", "2023-01-01", "2025-01-01")]
    assert [(r.pivot, r.col, r.row, r.end_col, r.end_row, r.sheet) for r in objects.pivots(books).collect()] == [("P", 0, 2, 2, 8, "S")]
    assert sorted((r.cell_metadata, r.spills) for r in objects.spill_blocks(books).collect()) == [(1, True), (2, False)]
    assert sorted((r.uri, r.n) for r in objects.extension_uris(books).collect()) == [("{a}", 2), ("{b}", 1)]
    assert sorted(tuple(r)[1:] for r in objects.print_areas(books).collect()) == [(0, 0, 0, 1, 2), (0, 3, 3, 3, 3)]
    types = {r.part: r.type for r in objects.content_types(books).collect()}
    assert types["xl/workbook.xml"] == "main" and types["xl/styles.xml"] == "application/xml" and types["xl/_rels/workbook.xml.rels"] == "application/octet-stream"
    assert [(r.part, r.type, bytes(r.data), r.error) for r in objects.binaries(spark, folder).collect()] == [("xl/media/image1.png", "image/png", b"\x89PNG", None)]


def compound():
    """A file of 512-byte sectors: 0 sector table, 1 directory, 2 small table, 3 small streams, 4 to 12 a long stream."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, 2, 1, end, 0, 0) + struct.pack("<108I", *[free] * 108)
    table = struct.pack("<128I", *[0xFFFFFFFD, end, end, end, *range(5, 13), end, *[free] * 115])
    entry = lambda name, kind, start, n, clsid=bytes(16): name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + bytes(12) + clsid + bytes(20) + struct.pack("<IQ", start, n)
    directory = entry("Root Entry", 5, 3, 64, bytes(range(16))) + entry("\x01Ole", 2, 0, 5) + entry("Package", 2, 4, 4600) + bytes(128)
    return head + table + directory + struct.pack("<128I", end, *[free] * 127) + b"small".ljust(512, b"\0") + bytes(range(256)) * 18


def test_compound_files(spark):
    data = compound()
    clsid, streams = streams_of(data)
    assert clsid == "03020100-0504-0706-0809-0a0b0c0d0e0f" and streams == [("\x01Ole", b"small"), ("Package", (bytes(range(256)) * 18)[:4600])]
    assert streams_of(b"PK") is None and streams_of(data[:600]) == (None, []) and streams_of(data[:40]) is None
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no")), (3, None)], "id int, data binary")
    rows = df.select("id", objects.compound_streams(F.col("data")).alias("c")).orderBy("id").collect()
    assert [s.name for s in rows[0].c.streams] == ["\x01Ole", "Package"] and [r.c.streams for r in rows[1:]] == [None, None]
