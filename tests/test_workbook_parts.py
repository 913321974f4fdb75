"""Comments, links, views, slicers, diagrams and charts of packages; fractions, colours and tints."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gridspark.functions import number_format as nf
from gridspark.functions import styles
from gridspark.operators import grid, hierarchy
from gridspark.sources.xlsx import Workbooks

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="' + R + '"'


def relations(*rows):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{R}/{t}" Target="{to}"/>' for i, t, to in rows) + "</Relationships>"


PARTS = {
    "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="Plan" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": relations(("rId1", "worksheet", "worksheets/sheet1.xml")),
    "xl/worksheets/sheet1.xml": f"""<worksheet {M}><sheetViews><sheetView showGridLines="0" zoomScale="85"><pane xSplit="1" ySplit="2" state="frozen"/></sheetView></sheetViews>
<sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData><sheetProtection sheet="1"/><hyperlinks><hyperlink ref="A1:B1" r:id="rId2" tooltip="t"/><hyperlink ref="C3" location="Plan!A1"/></hyperlinks>
<headerFooter><oddHeader>&amp;Lleft&amp;Cmid</oddHeader></headerFooter><rowBreaks><brk id="4"/></rowBreaks></worksheet>""",
    "xl/worksheets/_rels/sheet1.xml.rels": relations(("rId2", "hyperlink", "https://example.org/a"), ("rId3", "comments", "../comments1.xml"), ("rId4", "threadedComment", "../threadedComments/threadedComment1.xml"), ("rId5", "slicer", "/xl/slicers/slicer1.xml")),
    "xl/comments1.xml": f'<comments {M}><authors><author>Ann</author><author></author></authors><commentList><comment ref="B2" authorId="0"><text><r><t>two </t></r><r><t>runs</t></r></text></comment><comment ref="A1" authorId="7"><text><t>plain</t></text></comment></commentList></comments>',
    "xl/persons/person.xml": '<personList><person id="{P1}" displayName="Mina"/><person id="{P2}" displayName="Olaf"/></personList>',
    "xl/threadedComments/threadedComment1.xml": '<ThreadedComments><threadedComment ref="A1" dT="2024-01-01T00:00:00" personId="{P1}" id="{1}"><text>Is this the last count?</text></threadedComment><threadedComment ref="A1" dT="2024-01-02T00:00:00" personId="{P2}" id="{2}" parentId="{1}"><text>Not before Friday</text></threadedComment></ThreadedComments>',
    "xl/slicers/slicer1.xml": '<slicers xmlns="x"><slicer name="S" caption="Shade" cache="C" columnCount="2"/></slicers>',
    "xl/slicerCaches/slicerCache1.xml": '<slicerCacheDefinition xmlns="x" name="C" sourceName="Shade"><data><tabular><items><i n="amber" s="1"/><i n="teal"/></items></tabular></data></slicerCacheDefinition>',
    "xl/diagrams/data1.xml": '<dgm:dataModel xmlns:dgm="d" xmlns:a="a"><dgm:ptLst><dgm:pt modelId="0" type="doc"/>'
    + "".join(f'<dgm:pt modelId="{i}"><dgm:t><a:p><a:r><a:t>{t}</a:t></a:r></a:p></dgm:t></dgm:pt>' for i, t in ((1, "Orchard"), (2, "Apples"), (3, "Pears"), (4, "Conference")))
    + '<dgm:pt modelId="9" type="pres"/></dgm:ptLst><dgm:cxnLst><dgm:cxn srcId="0" destId="1" srcOrd="0"/><dgm:cxn srcId="1" destId="2" srcOrd="0"/><dgm:cxn srcId="1" destId="3" srcOrd="1"/><dgm:cxn srcId="3" destId="4" srcOrd="0"/><dgm:cxn type="presOf" srcId="1" destId="9"/></dgm:cxnLst></dgm:dataModel>',
    "xl/charts/chart1.xml": '<c:chartSpace xmlns:c="c"><c:chart><c:plotArea><c:barChart><c:barDir val="col"/><c:grouping val="stacked"/><c:ser><c:idx val="0"/><c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>Barley</c:v></c:pt></c:strCache></c:strRef></c:tx>'
    '<c:cat><c:strRef><c:strCache><c:pt idx="0"><c:v>Q1</c:v></c:pt><c:pt idx="2"><c:v>Q3</c:v></c:pt></c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache><c:pt idx="0"><c:v>37</c:v></c:pt><c:pt idx="1"><c:v>x</c:v></c:pt><c:pt idx="2"><c:v>5.5</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>',
}


@pytest.fixture
def books(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, xml in PARTS.items():
            z.writestr(name, xml)
    (tmp_path / "a.xlsx").write_bytes(data.getvalue())
    return Workbooks(spark, str(tmp_path))


def test_sheet_parts(books):
    assert sorted(tuple(r)[2:] for r in books.comments().collect()) == [("Plan", 0, 0, None, "plain"), ("Plan", 1, 1, "Ann", "two runs")]
    assert sorted((r.cell_col, r.cell_row, r.target, r.location, r.tooltip, r.safe) for r in books.hyperlinks().collect()) == [(0, 0, "https://example.org/a", None, "t", True), (1, 0, "https://example.org/a", None, "t", True), (2, 2, None, "Plan!A1", None, True)]
    assert [tuple(r)[3:] for r in books.views().collect()] == [(2, 1, False, 85, False, [4], [], True)]
    assert [(r.header.left, r.header.center, r.footer) for r in books.header_footers().collect()] == [("left", "mid", None)]
    assert [tuple(r)[2:] for r in books.slicers().collect()] == [("Plan", "S", "Shade", "C", "Shade", 2, True, ["amber", "teal"], ["amber"])]


def test_threads_and_trees(books):
    comments = books.threaded_comments()
    assert sorted((r.author, r.text) for r in comments.collect()) == [("Mina", "Is this the last count?"), ("Olaf", "Not before Friday")]
    assert [(r.text, [x.text for x in r.replies]) for r in hierarchy.threads(comments, ["sheet"]).collect()] == [("Is this the last count?", ["Not before Friday"])]
    levels = hierarchy.levels(books.diagram_nodes(), books.diagram_edges()).collect()
    texts = {r.id: r.text for r in books.diagram_nodes().collect()}
    assert sorted((r.level, texts[r.id]) for r in levels) == [(0, "Orchard"), (1, "Apples"), (1, "Pears"), (2, "Conference")]


def test_chart_points(books):
    assert [tuple(r)[2:] for r in books.chart_points().orderBy("idx").collect()] == [("column", "stacked", 0, "Barley", 0, "Q1", 37.0), ("column", "stacked", 0, "Barley", 1, None, None), ("column", "stacked", 0, "Barley", 2, "Q3", 5.5)]


@pytest.mark.parametrize(
    ("value", "code", "want"),
    [(0.4, "# ??/??", "0 2/5"), (-1.25, "# ?/?", "-1 1/4"), (3.14159265, "# ???/???", "3 16/113"), (1.25, "# ?/8", "1 2/8"), (2.99, "# ?/8", "3"), (4.0, "# ?/?", "4"), (0.0, "# ?/?", "0"), (12345678901.5, "# ?/?", "12345678901 1/2")],
)
def test_fractions(spark, value, code, want):
    assert spark.range(1).select(nf.format_code(F.lit(value), code)[0]).first()[0] == want


def test_styles(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    tint = lambda c, t: one(styles.tinted(F.lit(c), F.lit(t)))
    assert [tint("#4472c4", 0.0), tint("#808080", -0.5), tint("#808080", 1.0), tint("#ff0000", 0.5), tint("#0000ff", -0.5), tint("#00ff00", 0.5), tint("red", 0.5)] == ["#4472c4", "#404040", "#ffffff", "#ff8080", "#000080", "#80ff80", "red"]
    assert [one(styles.hex_colour(F.lit(x))) for x in ("FF00AA11", "00aa11", "red", "12345")] == ["#00aa11", "#00aa11", None, None]
    assert [one(styles.font_family(F.lit(x))) for x in (" Times New Roman ", "Arial; x", "")] == ['"Times New Roman"', None, None]
    assert one(nf.format_code(F.lit(1.0), "[Color 3]0")[1]) == "#ff0000" and one(styles.emu_to_pixels(F.lit(19050))) == 2
    assert [one(grid.safe_link(F.lit(x))) for x in ("https://a", "javascript:x", "java\tscript:x", "tel:1", "a/b:c", "#x", "", None, "file:///x")] == [True, False, False, True, True, True, True, True, False]


def test_damaged_members_have_a_row_each(spark, tmp_path):
    from gridspark.sources import objects

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in PARTS.items():
            z.writestr(name, xml)
        z.writestr("xl/media/image1.png", b"pixels" * 400)
    raw = bytearray(data.getvalue())
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        for name in ("xl/comments1.xml", "xl/media/image1.png"):
            entry = z.getinfo(name)
            at = entry.header_offset + 30 + len(entry.filename)
            raw[at : at + entry.compress_size] = b"\xff" * entry.compress_size
    (tmp_path / "a.xlsx").write_bytes(bytes(raw))
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04 cut short")
    books = Workbooks(spark, str(tmp_path))
    errors = {(r.workbook.rsplit("/", 1)[1], r.part, r.error) for r in books.errors().collect()}
    assert errors == {("a.xlsx", "xl/comments1.xml", "damaged"), ("b.xlsx", None, "not a package")}
    assert books.sheets().count() == 1
    assert [(r.part, r.data, r.error) for r in objects.binaries(spark, str(tmp_path)).collect()] == [("xl/media/image1.png", None, "damaged")]


def test_rows_outlines_and_formulas_of_a_package(spark, tmp_path):
    from gridspark.operators import outline

    row = lambda n, level, cells="", more="": f'<row r="{n}" outlineLevel="{level}"{more}>{cells}</row>'
    number = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    body = row(1, 1, number("A1", 4)) + row(2, 2, number("A2", 6.5), ' hidden="1" ht="21"') + row(3, 1, number("A3", -2)) + row(4, 0, '<c r="A4"><f>SUM(A1:A3)</f></c><c r="B4"><f>IF(A1&gt;3,A1*2,"low")</f><v>1</v></c>', ' collapsed="1"')
    sheet = f'<worksheet {M}><sheetPr><outlinePr summaryRight="0"/></sheetPr><sheetFormatPr outlineLevelRow="2"/><sheetData>{body}</sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            z.writestr(name, PARTS[name])
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "o.xlsx").write_bytes(data.getvalue())
    books = Workbooks(spark, str(tmp_path))
    assert [tuple(r)[3:] for r in books.rows().orderBy("row").collect()] == [(0, None, False, 1, False), (1, 21.0, True, 2, False), (2, None, False, 1, False), (3, None, False, 0, True)]
    assert [tuple(r)[3:] for r in books.outlines().collect()] == [(2, 0, True, False)]
    assert sorted(tuple(r)[1:] for r in outline.groups(books.rows(), by="sheet").collect()) == [(1, 0, 2, True), (2, 1, 1, False)]
    assert [r.hidden for r in outline.with_hidden(books.rows().drop("hidden")).orderBy("row").collect()] == [True, True, True, False]
    values = lambda df: {(r.row, r.col): (r.value, r.kind) for r in df.collect()}
    assert values(books.recalculated())[3, 0] == ("8.5", "number") and values(books.recalculated())[3, 1][0] == "1"
    assert values(books.recalculated(force=True))[3, 1] == ("8", "number")
